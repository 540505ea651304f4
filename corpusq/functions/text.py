"""Text and path functions as Columns; all stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq.settings import FILE_TYPES

#: Combining marks, which fold to nothing.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _with_marks() -> tuple[str, str]:
    """Lower-case letters with marks (Latin, Greek, Cyrillic), and the letters without."""
    of = {}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isalpha() and chr(code).lower() == chr(code) and all(map(unicodedata.combining, marks)):
            of[chr(code)] = base
    return "".join(of), "".join(of.values())


ACCENTED, FOLDED = _with_marks()
CJK = r"[一-鿿]"
#: Seven ranges of wide characters that the token budget counts in full.
WIDE = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{f900}-\x{faff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a one-character pattern; runs are taken at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def chunk_tokens(text: Column) -> Column:
    """Estimate for sizing chunks: 2.5 a CJK character, 2 an ASCII word, 1 any other character; rounded down."""
    marks = F.regexp_replace(text, "[^a-zA-Z]*+[a-zA-Z]++", "x")  # a mark for each word, then what follows the last one
    n_words = F.length(marks) - F.length(F.regexp_replace(marks, "^x*+", ""))
    letters = _count(text, "[a-zA-Z]")
    cjk = _count(text, CJK)
    return F.floor(cjk * 2.5 + n_words * 2.0 + (F.length(text) - cjk - letters)).cast("long")


def budget_tokens(text: Column) -> Column:
    """Estimate for model budgets: 1.5 a wide character, 0.25 any other but white space, rounded down, plus 1; 0 if empty."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    wide = _count(solid, WIDE)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.floor(wide * 1.5 + (F.length(solid) - wide) * 0.25) + 1).cast("long")


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), ACCENTED + MARKS, FOLDED)


def python_tokens(text: str) -> list[str]:
    """``tokens`` of one text."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(ACCENTED, FOLDED, MARKS)))


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def padded(text: Column) -> Column:
    """Tokens between single spaces, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters; none for fewer than two."""
    return F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct 3-character pieces; none for fewer than three characters.  For short texts: each piece is counted off from the beginning."""
    return F.array_distinct(F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def share_held(pieces: Column, text: Column) -> Column:
    """Share of ``pieces`` that ``text`` has; null without any."""
    return F.try_divide(F.size(F.filter(pieces, lambda x: F.contains(text, x))).cast("double"), F.size(pieces))


def trigram_containment(a: Column, b: Column) -> Column:
    """Share of distinct 3-character pieces of ``a`` that ``b`` has; null if ``a`` is shorter than 3."""
    return share_held(trigrams(a), b)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file; empty if the path has none."""
    return basename(F.regexp_replace(path, r"[/\\]+[^/\\]*$", ""))


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty for names without a dot or that only start with one."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def file_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.lit("other"))


def format_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal, halves to even."""
    out, x = None, size.cast("double")
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        part = F.format_string(f"%.1f {unit}", F.bround(x / float(1024**i), 1))
        cond = x / float(1024**i) < 1024
        out = F.when(cond, part) if out is None else out.when(cond, part)
    return out.otherwise(F.format_string("%.1f TB", F.bround(x / float(1024**4), 1)))


def clean(text: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def place_label(page: Column, chunk_index: Column, total_chunks: Column) -> Column:
    """``, Page p`` or ``, Chunk i/n`` or nothing."""
    chunk = F.concat(F.lit(", Chunk "), (chunk_index + 1).cast("string"), F.lit("/"), F.coalesce(total_chunks.cast("string"), F.lit("?")))
    return F.when(page.isNotNull() & (page != 0), F.concat(F.lit(", Page "), page.cast("string"))).when(chunk_index.isNotNull(), chunk).otherwise("")


def tagged_text(text: Column, tag: str = "ref") -> Column:
    """All parts between ``<|tag|>`` and ``<|/tag|>``, one a line; the whole text if there is none."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)<\|{tag}\|>(.*?)<\|/{tag}\|>"), F.lit(1))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(text)
