"""Operators that have SQL, on small awkward tables: defined results, no crashes, no Python in the plan."""

import random
import textwrap
from collections import Counter

import duckdb
import pytest

from corpusq.llm import decontaminate, license_scan, mix, perspectives, warc
from corpusq.llm.license_texts import TEXTS

DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, start long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 7, 8) for i, t, s in rows], DOC).repartition(3)


def agree(spark, sf, query, sql, tables, keys):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = con.sql(sql)
    at = [want.columns.index(k) for k in keys]
    got = sorted((tuple(str(r[k]) for k in keys) for r in query(spark, str(sf)).collect()))
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    return got


def write(df, sf, name):
    df.write.parquet(f"{sf}/{name}.parquet")


@pytest.fixture
def some_docs():
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40))), ["a", "b", "b", "b", "Z", None][i % 6]) for i in range(120)]
    return [*rows, (5, rows[5][1], "Z"), (5, rows[5][1], "Z"), (None, "null id here", "a"), (200, None, "a"), (201, "\t\x0b \r\n", "a"), (202, "x\x85y z", "a"), (203, None, "only nulls"), (204, "very long " * 20000, "b")]


def test_mix_against_sql(spark, tmp_path, some_docs):
    write(documents(spark, some_docs), tmp_path, "documents")
    keys = ["doc_id", "size", "source_size", "target", "taken"]
    got = agree(spark, tmp_path, mix.op1_mix_sources, mix.ORACLE_SQL, ["documents"], keys)
    assert len(got) == len(some_docs)
    rows = mix.taken(documents(spark, some_docs)).collect()
    assert all(x.taken <= 3 * x.size for x in rows)
    largest = max(x.size for x in rows)
    for s in {x.source for x in rows}:
        own = [x for x in rows if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 2 * largest
    once = {(x.doc_id, x.source, x.size): x.repeats for x in rows}
    kept = mix.mixed_documents(documents(spark, some_docs))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert kept.count() == sum(x.repeats for x in rows) and once
    assert mix.taken(documents(spark, some_docs).limit(0)).collect() == []


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 30)], "source string, size long")
    got = {r.source: r.target for r in mix.targets(sizes).collect()}
    # weights 5, 2, 1, 5 of 2040; a stops at 30 and null at 90, the rest goes 2 to 1
    assert got == {"a": 30.0, None: 90.0, "b": pytest.approx(1280.0), "c": pytest.approx(640.0)}


def test_decontaminate_against_sql(spark, tmp_path):
    r = random.Random(8)
    words = [f"t{i}" for i in range(400)]
    items = [[r.choice(words) for _ in range(n)] for n in (3, 5, 14, 14, 40)]
    rows = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 90))]
        if i % 3 == 0:
            p = list(items[i // 3 % 5])
            if i % 2:
                p[len(p) // 2] = "edit"
            w[len(w) // 2: len(w) // 2] = p
        rows.append((i, ", ".join(w) if i % 4 else " ".join(w).upper(), "s"))
    rows += [(None, " ".join(items[4]), "s"), (61, None, "s"), (62, " ".join(items[4][:36]), "s"), (63, " ".join(items[2] * 300), "s"), (7, rows[0][1], "s")]
    write(documents(spark, rows), tmp_path, "documents")
    bench = spark.createDataFrame([(i, " ".join(w), 1.0) for i, w in enumerate(items)] + [(8, None, 1.0), (9, "?!", 1.0), (10, " ".join(items[2]), 1.0)], "item_id long, text string, similarity double")
    write(bench, tmp_path, "benchmark")
    got = agree(spark, tmp_path, decontaminate.op8_decontaminate, decontaminate.ORACLE_SQL, ["documents", "benchmark"], ["doc_id", "item_id", "start", "similarity"])
    assert len(got) > 15 and ("62", "4", "0", "0.888889") in got and ("None", "4", "0", "1.0") in got
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = decontaminate.clean(docs, bench)
    bad = {g[0] for g in got}
    # ids 7 and null stand for two rows each, of which one holds an item
    assert clean.columns == docs.columns and sorted(str(x.doc_id) for x in clean.collect()) == sorted([str(i) for i, *_ in rows if str(i) not in bad] + ["7"])
    assert decontaminate.found(docs.limit(0), bench).count() == 0 and decontaminate.found(docs, bench.limit(0)).count() == 0


def test_blocks_find_all_within_the_radius(spark):
    r = random.Random(4)
    items = [(i, 20, r.getrandbits(60)) for i in range(40)]
    windows = []
    for i, _, p in items:
        for d in (0, 3, 9, 13, 14, 15, 20):
            windows.append((len(windows), 20, p ^ sum(1 << b for b in r.sample(range(60), d))))
        windows.append((len(windows), 21, p))
    windows += [(len(windows) + i, 20, r.getrandbits(60)) for i in range(2000)]
    w, x = spark.createDataFrame(windows, "window long, size int, print long"), spark.createDataFrame(items, "item long, size int, print long")
    got = {tuple(r) for r in decontaminate.near_pairs(w, x).collect()}
    assert got == {(a, b) for a, s, p in windows for b, t, q in items if s == t and (p ^ q).bit_count() <= decontaminate.RADIUS}
    # what the index hands over of unrelated pairs, before their whole fingerprints are compared
    reach = spark.createDataFrame([(0,)], "print long").select(decontaminate._blocks([0, 1])).first()[0]
    assert len(reach) == 10 and 5 * (1 + 12 + 66) / 2**12 < 0.1


def test_windows_at_shared_shingles_are_the_most_similar(spark):
    r = random.Random(11)
    words = [f"v{i}" for i in range(300)]
    item = [r.choice(words) for _ in range(24)]
    rows = []
    for i in range(300):
        p = list(item)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(p))
            p[k: k + 1] = r.choice([[], ["edit"], [p[k], "more"]])
        w = [r.choice(words) for _ in range(30)]
        rows.append((i, " ".join(w[:15] + p + w[15:]), "s"))
    got = {x.doc_id: x.similarity for x in decontaminate.found(documents(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    five = lambda w: Counter(tuple(w[k: k + 5]) for k in range(len(w) - 4))
    want, best = five(item), {}
    for i, text, _ in rows:
        w = text.split()
        for k in range(len(w) - len(item) + 1):
            own = five(w[k: k + len(item)])
            best[i] = max(best.get(i, 0), sum((own & want).values()) / sum((own | want).values()))
    assert {i: pytest.approx(x) for i, x in best.items() if x >= 0.8} == got and 60 < len(got) < 290


def test_clean_decides_each_row_without_id(spark):
    item = "one two three four five six seven"
    rows = [(None, f"x {item} y", "s"), (None, "nothing to see here at all", "s"), (3, "a clean text of three", "s"), (4, item, "s"), (5, None, "s"), (None, None, "s")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = [(r.doc_id, r.text) for r in decontaminate.clean(documents(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted(((i, t) for i, t, _ in rows if item not in (t or "")), key=str)
    assert decontaminate.clean(documents(spark, rows), bench.limit(0)).count() == len(rows)


def test_licenses_against_sql(spark, tmp_path):
    texts = [
        "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\nmore", "no end\nAll rights reserved\nthis", None, "", "license " * 5000,
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "This file is licensed under the MIT License. And more", "// SPDX-License-Identifier: GPL-3.0-or-later\nint main", "SPDX-License-Identifier: none\nMIT", "This project is distributed under the terms of the GNU General Public License version 3.",
        "Copyright 2020 x\nthe software is nice\nLicensed under the foo license.", "all code is licensed under the Apache 2.0 license", "MIT License\n\nCopyright (c) 2020 A. N. Other\n\n" + dict(TEXTS)["MIT"], "q " * 9000 + "\nThis work is licensed under CC BY 4.0.\nend",
    ]
    texts += [text for _, text in TEXTS] + ["\n".join(textwrap.wrap(text.replace("\n\n", " @@ "), 66)).replace(" @@ ", "\n\n").replace("@@", "\n") for _, text in TEXTS]
    write(documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(1, texts[0], "s"), (None, texts[0], None)]), tmp_path, "documents")
    got = agree(spark, tmp_path, license_scan.op5_licenses, license_scan.ORACLE_SQL, ["documents"], ["doc_id", "sentences", "rules", "licences"])
    by = {(g[0], g[3]) for g in got}
    want = ["MIT", "Apache-2.0", "", "", "", "", "CC-BY-NC-4.0", "MIT", "GPL-3.0-or-later", "", "GPL-3.0-only", "", "Apache-2.0", "MIT", "CC-BY-4.0"]
    assert {(str(i), w) for i, w in enumerate(want)} <= by
    assert [g[2] for g in got if g[0] == "13"] == ["mit-text"]
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "own", 2)], "doc_id long, text string, rules string, licences int")
    row = license_scan.recognise(docs).first()
    assert (row.rules, row.licences, row.rules_, row.licences_) == ("own", 2, ["says-MIT"], ["MIT"])
    assert license_scan.recognise(docs.limit(0)).collect() == []


#: Whole files and headers as they are published, wrapped and commented as in real files.
FILES = [
    ("mit-text", "MIT", ("MIT License", "", "Copyright (c) 2019 Some Body", "", "MIT"), ""), ("apache-header", "Apache-2.0", ("Copyright 2021 Some Body", "", "APACHE"), "# "), ("apache-header", "Apache-2.0", ("APACHE",), " * "),
    ("bsd-3-text", "BSD-3-Clause", ("Copyright (c) 2018, Some Body. All rights reserved.", "", "BSD", "", "3. ", "BSD-NAME", "", "BSD-WARRANTY"), ""), ("bsd-2-text", "BSD-2-Clause", ("Copyright (c) 2018, Some Body", "", "BSD", "", "BSD-WARRANTY"), ""),
    ("gpl-2-header", "GPL-2.0-or-later", ("prog - does things", "Copyright (C) 2001 Some Body", "", "GPL2", "", "GPL-WARRANTY"), "// "), ("gpl-3-header", "GPL-3.0-or-later", ("GPL3", "", "GPL-WARRANTY"), "# "), ("lgpl-2.1-header", "LGPL-2.1-or-later", ("LGPL21",), " * "),
    ("agpl-3-header", "AGPL-3.0-or-later", ("AGPL3", "", "GPL-WARRANTY"), ""), ("mpl-header", "MPL-2.0", ("MPL",), "# "), ("isc-text", "ISC", ("ISC License", "", "Copyright Some Body", "", "ISC", "", "ISC-WARRANTY"), ""), ("unlicense-text", "Unlicense", ("UNLICENSE",), ""),
    ("zlib-text", "Zlib", ("ZLIB",), ""), ("boost-text", "BSL-1.0", ("BOOST",), ""), ("gpl-2-only-header", "GPL-2.0-only", ("GPL2-ONLY",), ""),
]


def test_published_texts_are_recognised(spark):
    rows = []
    for i, (_, _, parts, sign) in enumerate(FILES):
        lines = []
        for part in parts:
            for paragraph in dict(TEXTS).get(part, part).split("\n\n"):
                lines += [*(textwrap.wrap(paragraph.strip(), 72) or [""]), ""] if part in dict(TEXTS) else [paragraph]
        rows.append((i, "code before;\n\n" + "\n".join((sign + x).rstrip() for x in lines) + "\n\nint main() { return 0; }\n"))
    got = {r.doc_id: r for r in license_scan.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [(rule, got[i].rules, got[i].sentences) for i, (rule, licence, *_) in enumerate(FILES) if got[i].rules != [rule] or got[i].licences != [licence]]
    assert not missed, missed


def test_perspectives_against_sql(spark, tmp_path):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|end|>"), (1, 2, "cara", None), (1, 3, "ann", "é bye"), (2, 0, "system", "only"), (3, None, None, "x"), (3, 1, "system", "rules"), (None, 1, "ann", "a"), (None, 1, "ann", "a"), (4, 7, "bob", "q" * 5000)]
    rows += [(5, i // 2, "ann" if i % 3 else "bob", f"turn {i}") for i in range(700)]
    write(spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, part string").repartition(3), tmp_path, "conversations")
    got = agree(spark, tmp_path, perspectives.op9_perspectives, perspectives.ORACLE_SQL, ["conversations"], ["conv_id", "perspective", "part", "n_turns", "start", "rendered", "masks"])
    assert sum(g[0] == "5" for g in got) == 6 and not any(g[0] == "2" for g in got)
    for conv, who, _, _, start, text, masks in got:
        for m in filter(None, masks.split(",")):
            a, b = (int(x) - int(start) for x in m.split(":"))
            assert text[a:b].endswith("<|end|>\n") and text[:a].endswith("<|start|>assistant\n")
    turns = spark.read.parquet(f"{tmp_path}/conversations.parquet").withColumnRenamed("role", "speaker")
    for r in perspectives.whole(perspectives.perspectives(turns)).filter("conv_id = 5").collect():
        told = sorted((i // 2, "ann" if i % 3 else "bob", f"turn {i}") for i in range(700))
        assert r.rendered == "".join(f"<|start|>{'assistant' if w == r.perspective else 'user name=' + w}\n{t}<|end|>\n" for _, w, t in told)
        assert [r.rendered[a:b] for a, b in r.masks] == [f"{t}<|end|>\n" for _, w, t in told if w == r.perspective]
    assert perspectives.perspectives(turns.limit(0)).collect() == []


def test_revisits_against_sql(spark, tmp_path):
    pages = [(i, u, h, 1) for i, (u, h) in enumerate([("http://www.A.com/x?utm_source=f&b=1#t", "one"), ("https://a.com/x?b=1", "one"), ("HTTP://m.a.com:80/x/?b=1", "two"), ("a.com", ""), ("https://a.com/", None), (None, "n"), ("https://a.com/x?b=1&utm_id=2", "two")] * 9)]
    write(spark.createDataFrame(pages, "page_id long, url string, html string, status int").repartition(4), tmp_path, "pages")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql(warc.ORACLE_SQL).fetchall()}
    got = warc.op2_revisits(spark, str(tmp_path)).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.record_id, r.captured, r.outcome, r.response_id, r.headers, r.body_md5) == want[r.record_id]
    assert any(r.outcome == "resolved" and pages[r.response_id // 2][2] is None for r in got)
    assert {r.outcome for r in got} == {"resolved", "changed", "no_validator", "no_response"}


def test_revisit_rules(spark):
    rows = [
        (1, "http://a.com", 10, 200, {"ETag": 'W/"v1"', "Content-Type": "text/html", "X": "1"}, "body1"), (2, "http://a.com/", 20, 304, {"etag": '"v1"', "Content-Type": "no", "X": "2"}, None),
        (3, "http://a.com", 30, 304, None, None), (4, "http://a.com", 10, 304, {"etag": '"v1"'}, None), (5, "http://a.com", 40, 200, {"ETag": '"v2"'}, "body2"),
        (6, "http://a.com", 40, 304, {"ETag": '"v1"'}, None), (7, "http://a.com", 41, 304, {"ETag": '"v1"'}, None), (8, None, 50, 304, {"ETag": '"v1"'}, None), (9, "http://a.com", None, 304, {"ETag": '"v1"'}, None), (10, "http://a.com", 60, 500, {}, "no"),
    ]
    captures = spark.createDataFrame([(*x, "extra") for x in rows], "record_id long, url string, captured long, status int, headers map<string,string>, body string, outcome string")
    got = {r.record_id: r for r in warc.resolve(captures).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {2: ("resolved", 1), 3: ("no_validator", None), 4: ("no_response", None), 6: ("resolved", 1), 7: ("changed", None), 8: ("no_response", None), 9: ("no_response", None)}
    assert got[2].headers == {"etag": '"v1"', "content-type": "text/html", "x": "2"} and got[2].body == "body1"
    assert warc.resolve(captures.limit(0)).collect() == []


def test_many_revisits_of_one_response(spark):
    rows = [(0, "http://a.com", 0, 200, {"ETag": "t"}, "body")] + [(i, "http://a.com/", i, 304, {"ETag": "t", "N": str(i)}, None) for i in range(1, 700)]
    rows += [(700, "http://b.com", 0, 200, {"ETag": "u"}, None), *[(701, "http://b.com", 5, 304, {"ETag": "u"}, None)] * 300]
    captures = spark.createDataFrame(rows, "record_id long, url string, captured long, status int, headers map<string,string>, body string").repartition(3)
    got = warc.resolve(captures).collect()
    assert len(got) == 999 and {r.outcome for r in got} == {"resolved"}
    assert sorted((r.record_id, r.response_id, r.headers.get("n"), r.body) for r in got if r.record_id < 700) == [(i, 0, str(i), "body") for i in range(1, 700)]
    assert [(r.response_id, r.body) for r in got if r.record_id == 701] == [(700, None)] * 300


def test_repeated_record_ids(spark):
    site, other, tag = "http://a.com", "http://b.com", lambda v: {"ETag": f'"{v}"'}
    rows = [
        (1, site, 10, 200, tag("v1"), "b body of a"), (1, other, 10, 200, tag("w1"), "a body of b"), (None, "http://c.com", 10, 200, tag("x"), "c body"),
        (2, site, 20, 304, tag("v1"), None), (2, site, 20, 304, tag("old"), None), (2, other, 30, 304, tag("w1"), None), (2, other, 30, 304, tag("w1"), None),
        (None, site, 40, 304, tag("v1"), None), (None, site, 41, 304, tag("old"), None), (None, None, 42, 304, tag("v1"), None), (None, "http://c.com", 43, 304, tag("x"), None),
    ]
    captures = spark.createDataFrame(rows, "record_id long, url string, captured long, status int, headers map<string,string>, body string").repartition(3)
    got = [(r.record_id, r.url, r.captured, r.headers["etag"].strip('"'), r.outcome, r.response_id, r.body) for r in warc.resolve(captures).collect()]
    want = [
        (2, site, 20, "v1", "resolved", 1, "b body of a"), (2, site, 20, "old", "changed", None, None), (2, other, 30, "w1", "resolved", 1, "a body of b"), (2, other, 30, "w1", "resolved", 1, "a body of b"),
        (None, site, 40, "v1", "resolved", 1, "b body of a"), (None, site, 41, "old", "changed", None, None), (None, None, 42, "v1", "no_response", None, None), (None, "http://c.com", 43, "x", "resolved", None, "c body"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_native_plans(spark, tmp_path, some_docs):
    docs = documents(spark, some_docs)
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    turns = spark.createDataFrame([(1, 1, "a", "b")], "conv_id long, turn long, speaker string, text string")
    for df in (mix.taken(docs), mix.mixed_documents(docs), decontaminate.found(docs, bench), decontaminate.clean(docs, bench), perspectives.perspectives(turns)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_license_slots(spark, tmp_path):
    """A holder's name or an older wording does not make another licence of a text."""
    t = dict(TEXTS)
    bsd, name, warranty = t["BSD"], t["BSD-NAME"], t["BSD-WARRANTY"]
    google = name.replace("the copyright holder", "Google Inc.")
    owner = warranty.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS OF FOO Inc. AND CONTRIBUTORS")
    rows = [
        (1, f"{bsd}\n\n3. {google}\n\n{warranty}"), (2, f"{bsd}\n\n* {name.replace('the copyright holder', 'the University')}\n\n{owner}"), (3, f"{bsd}\n\n{warranty}"), (4, f"{bsd}\n\n{owner.replace('Inc. ', 'Co ')}"),
        (5, f"{bsd}\n\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n\n{warranty}"), (6, t["GPL2"].replace("version 2 of the License, or", "version 2, or")), (7, t["GPL3"].replace("version 3 of the License, or", "version 3, or")),
        (8, "Neither the name of the game nor its rules may be used."), (9, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licences for r in license_scan.recognise(docs).collect()}
    assert got == {1: ["BSD-3-Clause"], 2: ["BSD-3-Clause"], 3: ["BSD-2-Clause"], 4: ["BSD-2-Clause"], 5: ["BSD-3-Clause"], 6: ["GPL-2.0-or-later"], 7: ["GPL-3.0-or-later"], 8: [], 9: []}
    docs.selectExpr("*", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[3] for r in con.sql(license_scan.ORACLE_SQL).select("doc_id, sentences, rules, licences").fetchall()}
    assert want == {k: ",".join(v) for k, v in got.items()}
