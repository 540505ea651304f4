"""License scans: sentence rules.

A text is cut into sentences; each is normalised and mapped to the identifier of the
known licence sentence that it equals: a sentence of a published notice or text (``TEXTS``), a
sentence that says under which licence something is (any of ``SUBJECT``, ``VERB`` and a name), or
a name alone (a title, or the value of a tag).  The identifiers of a text, in order, are one
sequence; ``-`` stands for a sentence that is not known.  Known sentences may have slots (``SLOTS``), such as a holder's name.  A rule names a licence and a
sequence of identifiers, and holds if they occur in order, with any others between or next
to each other as the rule says.  Rules are ordered: once one holds, the later rules
that it covers are not reported.

A paragraph is cut at ends of sentences, its line ends read as spaces; a sentence that is
not known so is cut at its line ends and the lines are looked up, so that notices broken
over lines and notices on lines of their own are both found, in one sequence.

Defined cases: null and empty texts have no licence; a sentence that occurs repeatedly counts each
time; rows with one doc_id are scanned each by its own text; empty input gives no rows;
other columns are kept (``recognise``), and an added column whose name the input has
gets ``_`` after it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import free_name, packed, table
from corpusq.llm.license_texts import AFTER, NAMES, SLOTS, SUBJECT, TEXTS, VERB

#: Every known sentence has one of these.
ANY = "(?i)licen[sc]e|later version|software|redistribution|cc.by|cc0|permission|warranty|rights reserved|copyright|gpl|spdx|apache|mit\\b|mpl|bsd|zlib|isc\\b|creative commons|disclaim"
#: Ends of sentences, and of paragraphs; comment signs at the start of a line are part of the break.
ENDS = r"[.!?;:]+[\s\")]+|[.!?;:]+$|\n[ \t]*(?:[#*/%;-]+[ \t]*)?\n"
LINES = r"\n"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def sentences(text: str) -> list[str]:
    """Normalised sentences of a text, as the scan makes them."""
    return [s for s in map(normal, re.split(ENDS, text)) if s]


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier; of equal sentences of two texts the first one's counts for both."""
    out: dict[str, str] = {}
    for name, text in TEXTS:
        for i, s in enumerate(sentences(text)):
            out.setdefault(s, name if i == 0 else f"{name}-{i + 1}")
    return out


KNOWN = known_sentences()
TITLES = {normal(name): f"NAME:{licence}" for licence, names in NAMES for name in names}


def of(name: str) -> tuple[str, ...]:
    """Identifiers of all sentences of a text, in order."""
    return tuple(KNOWN[s] for s in sentences(dict(TEXTS)[name]))


#: (rule, licence, identifiers in order, may others stand between, rules that it covers), most specific first.
RULES = (
    ("apache-header", "Apache-2.0", of("APACHE")[:4], True, ("apache-notice", "says-Apache-2.0", "title-Apache-2.0")),
    ("apache-notice", "Apache-2.0", of("APACHE")[:2], True, ("says-Apache-2.0", "title-Apache-2.0")),
    ("mit-text", "MIT", (of("MIT")[0], of("MIT")[1], of("MIT")[2]), True, ("says-MIT", "title-MIT")),
    ("bsd-3-text", "BSD-3-Clause", (of("BSD")[0], *of("BSD-NAME"), *of("BSD-WARRANTY")), True, ("bsd-2-text", "says-BSD-3-Clause", "title-BSD-3-Clause")),
    ("bsd-2-text", "BSD-2-Clause", (of("BSD")[0], *of("BSD-WARRANTY")), True, ("says-BSD-2-Clause", "title-BSD-2-Clause")),
    ("isc-text", "ISC", of("ISC") + of("ISC-WARRANTY"), True, ("says-ISC", "title-ISC")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", of("LGPL21"), False, ()),
    ("lgpl-3-header", "LGPL-3.0-or-later", of("LGPL3"), False, ()),
    ("agpl-3-header", "AGPL-3.0-or-later", of("AGPL3"), False, ()),
    ("gpl-2-header", "GPL-2.0-or-later", of("GPL2"), False, ()),
    ("gpl-2-only-header", "GPL-2.0-only", of("GPL2-ONLY"), False, ()),
    ("gpl-3-header", "GPL-3.0-or-later", of("GPL3"), False, ()),
    ("mpl-header", "MPL-2.0", of("MPL")[:2], False, ()),
    ("unlicense-text", "Unlicense", of("UNLICENSE")[:1], False, ("title-Unlicense",)),
    ("boost-text", "BSL-1.0", of("BOOST")[1:2], False, ("title-BSL-1.0",)),
    ("zlib-text", "Zlib", (of("ZLIB")[0], of("ZLIB")[2]), True, ("title-Zlib",)),
    ("cc-by-text", "CC-BY-4.0", of("CC-BY-TEXT"), False, ("says-CC-BY-4.0",)),
    ("cc-by-sa-text", "CC-BY-SA-4.0", of("CC-BY-SA-TEXT"), False, ("says-CC-BY-SA-4.0",)),
    ("cc-by-nc-text", "CC-BY-NC-4.0", of("CC-BY-NC-TEXT"), False, ("says-CC-BY-NC-4.0",)),
    *((f"tag-{licence}", licence, (*of("SPDX"), f"NAME:{licence}"), False, (f"title-{licence}",)) for licence, _ in NAMES),
    *((f"says-{licence}", licence, (f"SAYS:{licence}",), False, (f"title-{licence}",)) for licence, _ in NAMES),
    ("title-MIT", "MIT", ("NAME:MIT", of("MIT")[0]), True, ()),
)


def _identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence; null if it is not known."""
    literal = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    name = F.regexp_replace(sentence, f"^(?:{SUBJECT}){VERB}", "")
    said = F.try_element_at(literal({k: v.replace("NAME:", "SAYS:") for k, v in TITLES.items()}), name)
    shorter = F.try_element_at(literal({k: v.replace("NAME:", "SAYS:") for k, v in TITLES.items()}), F.regexp_replace(name, f"{AFTER}$", ""))
    return F.coalesce(F.try_element_at(literal(KNOWN), _slotted(sentence)), F.try_element_at(literal(TITLES), sentence), F.when(name != sentence, F.coalesce(said, shorter)))


def _slotted(sentence: Column) -> Column:
    """A normalised sentence with what its slots hold put as in the known one."""
    for pattern, meant in SLOTS:
        sentence = F.regexp_replace(sentence, pattern, meant.replace("\\1", "$1"))
    return sentence


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _sequence(text: Column) -> Column:
    """|A|-|B|...: identifiers of the sentences of a text that may be known, in order."""
    known = lambda s: F.when(s.rlike(ANY) | s.rlike(r"^\W*\d[\d\W]*$"), _identifier(_normal(s)))
    lines = lambda s: F.transform(F.split(s, LINES), lambda x: F.coalesce(known(x), F.lit("-")))
    each = F.transform(F.filter(F.split(text, ENDS), lambda s: _normal(s) != ""), lambda s: F.struct(s.alias("s"), known(s).alias("id")))
    found = F.flatten(F.transform(each, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).when(e["s"].contains("\n"), lines(e["s"])).otherwise(F.array(F.lit("-")))))
    return F.concat(F.lit("|"), F.regexp_replace(F.array_join(found, "|"), r"(?:-\|)*-", "-"), F.lit("|"))


def _pattern(ids: tuple[str, ...], loose: bool) -> str:
    return r"\|" + (r"\|(.*\|)?" if loose else r"\|").join(map(re.escape, ids)) + r"\|"


def recognise(docs: DataFrame) -> DataFrame:
    """``docs`` with sentences (identifiers in order), rules and licences (arrays, in order of the rules)."""
    names = [free_name(docs, c) for c in ("sentences", "rules", "licences")]
    seq = packed(docs, seq=F.when(F.col("text").rlike(ANY), _sequence(F.col("text"))).otherwise("|"))
    holds = {rule: F.col("seq").rlike(_pattern(ids, loose)) for rule, _, ids, loose, _ in RULES}
    hit = []
    for rule, licence, *_ in RULES:
        ok = holds[rule]
        for c in [holds[r] for r, *_, covers in RULES if rule in covers]:
            ok = ok & ~c
        hit.append(F.when(ok, F.struct(F.lit(rule).alias("rule"), F.lit(licence).alias("licence"))))
    # texts without any known sentence are settled before the rules
    known = F.array_remove(F.array_remove(F.split("seq", r"\|"), ""), "-")
    hits = F.when(F.size(known) > 0, F.array_compact(F.array(*hit))).otherwise(F.array().cast("array<struct<rule:string,licence:string>>"))
    return seq.select("_row", known.alias("known"), hits.alias("hits")).select(
        "_row.*", F.col("known").alias(names[0]), F.transform("hits", lambda h: h["rule"]).alias(names[1]), F.array_distinct(F.transform("hits", lambda h: h["licence"])).alias(names[2]))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentences", "rules", "licences")])


def _oracle() -> str:
    values = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in d.items())
    n = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    slotted = n.format("x")
    for pattern, meant in SLOTS:
        slotted = f"regexp_replace({slotted}, '{pattern}', '{meant}')"
    name = f"regexp_replace({n.format('x')}, '^(?:{SUBJECT}){VERB}', '')"
    ident = f"""CASE WHEN regexp_matches(x, '{ANY}') OR regexp_matches(x, '^\\W*\\d[\\d\\W]*$') THEN coalesce((SELECT id FROM known WHERE sentence = {slotted}), (SELECT id FROM titles WHERE sentence = {n.format('x')}),
      CASE WHEN {name} <> {n.format('x')} THEN replace(coalesce((SELECT id FROM titles WHERE sentence = {name}), (SELECT id FROM titles WHERE sentence = regexp_replace({name}, '{AFTER}$', ''))), 'NAME:', 'SAYS:') END) END"""
    holds = {r: f"regexp_matches(seq, '{_pattern(ids, loose)}')" for r, _, ids, loose, _ in RULES}
    whole = {r: " AND ".join([holds[r], *[f"NOT {holds[o]}" for o, *_, covers in RULES if r in covers]]) for r, *_ in RULES}
    hits = ", ".join(f"CASE WHEN {whole[r]} THEN '{r}={licence}' END" for r, licence, *_ in RULES)
    return rf"""
WITH known AS (SELECT * FROM (VALUES {values(KNOWN)}) AS v(sentence, id)), titles AS (SELECT * FROM (VALUES {values(TITLES)}) AS v(sentence, id)),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, unnest(parts) AS x, generate_subscripts(parts, 1) AS pos FROM (SELECT r, regexp_split_to_array(text, '{ENDS}') AS parts FROM d WHERE regexp_matches(text, '{ANY}'))),
w AS (SELECT r, pos, x, {ident} AS id FROM p WHERE {n.format('x')} <> ''),
l AS (SELECT r, pos, unnest(parts) AS x, generate_subscripts(parts, 1) AS line FROM (SELECT r, pos, string_split(x, chr(10)) AS parts FROM w WHERE id IS NULL AND contains(x, chr(10)))),
t AS (SELECT r, pos, line, coalesce({ident}, '-') AS id FROM l UNION ALL SELECT r, pos, 0, coalesce(id, '-') FROM w WHERE id IS NOT NULL OR NOT contains(x, chr(10))),
s AS (SELECT doc_id, '|' || coalesce(regexp_replace((SELECT string_agg(id, '|' ORDER BY pos, line) FROM t WHERE t.r = d.r), '(?:-\|)*-', '-', 'g') || '|', '') AS seq FROM d),
h AS (SELECT doc_id, array_to_string(list_filter(string_split(seq, '|'), lambda x: x <> '' AND x <> '-'), ',') AS sentences, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM s)
SELECT doc_id, sentences, array_to_string(list_transform(hits, lambda x: split_part(x, '=', 1)), ',') AS rules,
       array_to_string(list_filter(list_transform(hits, lambda x: split_part(x, '=', 2)), lambda x, i: list_position(list_transform(hits, lambda y: split_part(y, '=', 2)), x) = i), ',') AS licences
FROM h
"""


ORACLE_SQL = _oracle()
