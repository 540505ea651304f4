"""Notices and texts of licences as they are published, and names that sentences about them use.

Each entry is (identifier of its sentences, text).  Sentences get the identifier with
their place after it, by the same splitting and normalising as the texts scanned.
"""

TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("APACHE", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-NAME", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-WARRANTY", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("ISC-WARRANTY", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("GPL2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL2-ONLY", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."""),
    ("GPL-WARRANTY", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL21", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("LGPL3", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("AGPL3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("MPL", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("UNLICENSE", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BOOST", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("ZLIB", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("CC-BY-TEXT", """This work is licensed under a Creative Commons Attribution 4.0 International License."""),
    ("CC-BY-SA-TEXT", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."""),
    ("CC-BY-NC-TEXT", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."""),
    ("SPDX", """SPDX-License-Identifier"""),
    ("RIGHTS", """All rights reserved."""),
)

#: Licence, and the names that sentences and tags give it.
NAMES = (
    ("MIT", ("MIT", "MIT License", "The MIT License", "Expat License", "MIT licence")),
    ("Apache-2.0", ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache Software License 2.0", "Apache 2.0")),
    ("BSD-2-Clause", ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License", "Modified BSD License")),
    ("ISC", ("ISC", "ISC License")),
    ("GPL-2.0-only", ("GPL-2.0", "GPL-2.0-only", "GPLv2", "GNU General Public License version 2", "GNU GPL v2")),
    ("GPL-2.0-or-later", ("GPL-2.0-or-later", "GPL-2.0+", "GPLv2+")),
    ("GPL-3.0-only", ("GPL-3.0", "GPL-3.0-only", "GPLv3", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3")),
    ("GPL-3.0-or-later", ("GPL-3.0-or-later", "GPL-3.0+", "GPLv3+")),
    ("LGPL-2.1-only", ("LGPL-2.1", "LGPL-2.1-only", "GNU Lesser General Public License version 2.1")),
    ("LGPL-3.0-only", ("LGPL-3.0", "LGPL-3.0-only", "GNU Lesser General Public License version 3")),
    ("AGPL-3.0-only", ("AGPL-3.0", "AGPL-3.0-only", "GNU Affero General Public License version 3")),
    ("MPL-2.0", ("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0")),
    ("Unlicense", ("Unlicense", "The Unlicense")),
    ("BSL-1.0", ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0")),
    ("Zlib", ("Zlib", "zlib License")),
    ("CC-BY-4.0", ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0")),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0")),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0")),
    ("CC0-1.0", ("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal")),
)

#: What may stand before and after a name in a sentence that says which licence holds.
SUBJECT = r"(?:this|the) (?:file|project|software|work|code|program|library|package|source code|repository|document|content|dataset|data)(?: is| are)? |(?:all )?(?:code|content|files|data) (?:is|are) |it is |"
VERB = r"(?:available|distributed|licen[sc]ed|published|released|made available|provided) under (?:the terms of )?(?:the |an? )?"
AFTER = r"(?: licen[sc]e)?(?: the license)?"

#: Places in normalised sentences that differ from notice to notice (a holder's name, which may have cut the sentence, or a wording), and the sentence of ``TEXTS`` that is meant.
SLOTS = (
    (r"^(?:neither the names? of .+|nor the names? of .+|the names? of .+) may (?:not )?be used to endorse or promote products derived from this software(?: without .*)?$",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (r"^(?:this software is provided by .+|and (?:its )?contributors) as is and any express(?:ed)? or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed$",
     "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    (r"either version (\d(?: \d)?) or at your option any later version$", r"either version \1 of the license or at your option any later version"),
)
