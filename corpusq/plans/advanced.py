"""Queries in the full-text language, over whole outlines, sessions and streams, with their SQL."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions import metadata
from corpusq.operators import analysis, fulltext, outline, postings, rag, search
from corpusq.operators.chunk import chunk_documents
from corpusq.plans import catalog
from corpusq.plans.catalog import ORACLE_SQL, QUERIES, query
from corpusq.plans.views import PADDED_SQL, chunks, chunks_sql, table
from corpusq.session import shared_dir
from corpusq.streaming import states

__all__ = ["ORACLE_SQL", "QUERIES"]


def _digest(prompt: str) -> str:
    return hashlib.md5(prompt.encode()).hexdigest()


# ---- full-text language, over stored postings

def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chunks, and their postings as a written table sorted by token."""
    c = chunks(spark, sf_dir, with_vector=False)
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings.write(postings.build(c), path)
    return c, spark.read.parquet(path)


def _found(spark, sf_dir, asked: str) -> DataFrame:
    c, stored = _stored(spark, sf_dir)
    return fulltext.search(c, asked, stored).select("rowid", "source_file")


_P = f"WITH c AS ({chunks_sql()}), p AS (SELECT rowid, source_file, {PADDED_SQL.format('text')} AS t, {PADDED_SQL.format('source_file')} AS f FROM c)"


@query(f"{_P} SELECT rowid, source_file FROM p WHERE contains(t, ' of the ') OR contains(f, ' of the ')")
def fulltext_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"of the"')


@query(f"{_P} SELECT rowid, source_file FROM p WHERE (contains(t, ' und ') AND (contains(t, ' der ') OR contains(t, ' die ')) AND NOT contains(t, ' and ')) OR (contains(t, ' que les ') AND contains(f, ' docx '))")
def fulltext_boolean(spark, sf_dir):
    return _found(spark, sf_dir, 'und AND (der OR die) NOT and OR "que les" docx')


@query(f"{_P} SELECT rowid, source_file FROM p WHERE (contains(t, ' erblest') OR contains(t, ' of ther')) AND (starts_with(t, ' the ') OR contains(f, ' src1 '))")
def fulltext_prefix(spark, sf_dir):
    return _found(spark, sf_dir, 'text : (erblest* OR of + ther*) AND (text : ^the OR - text : src1)')


@query(f"""WITH c AS ({chunks_sql()}), w AS (SELECT rowid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT rowid, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM c)),
a AS (SELECT * FROM w WHERE w = 'that'), b AS (SELECT * FROM w WHERE w = 'was'), d AS (SELECT * FROM w WHERE w = 'from')
SELECT DISTINCT c.rowid, c.source_file FROM c JOIN a ON c.rowid = a.rowid JOIN b ON a.rowid = b.rowid AND abs(a.i - b.i) <= 7 JOIN d ON a.rowid = d.rowid AND greatest(a.i, b.i, d.i) - least(a.i, b.i, d.i) <= 7""")
def fulltext_near(spark, sf_dir):
    return _found(spark, sf_dir, "NEAR(that was from, 6)")


# ---- a whole scan: outlines to reports

def _outlines(spark, sf_dir) -> DataFrame:
    """Four outlines, each of a section for every tenth item of the benchmark, in words of the item."""
    b = table(spark, sf_dir, "benchmark").filter("text is not null")
    words = F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " ")
    line = F.concat(F.col("item_id").cast("string"), F.lit(". "), F.try_element_at(words, F.lit(5)), F.lit("\n"), F.try_element_at(words, F.lit(7)), F.lit("-"), F.try_element_at(words, F.lit(8)))
    some = b.filter("item_id % 10 < 4").select((F.col("item_id") % 10).alias("id"), "item_id", line.alias("line"))
    return some.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


_WORD = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
_REDUCE = """{to} AS (SELECT id, ord, source_file, part // 30 AS part, CASE WHEN count(*) = 1 THEN min(s) ELSE md5(string_agg(s, chr(10) || chr(10) ORDER BY part)) END AS s FROM {of} GROUP BY id, ord, source_file, part // 30)"""
_SCAN = f"""WITH c AS ({chunks_sql()}),
b AS (SELECT item_id % 10 AS id, item_id, string_split_regex(text, '[^A-Za-z]+') AS w FROM benchmark WHERE item_id % 10 < 4 AND text IS NOT NULL),
s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY item_id) AS ord, item_id || '. ' || w[5] AS title, w[7] || '-' || w[8] AS detail FROM b),
p AS (SELECT rowid, {PADDED_SQL.format('text')} AS t, {PADDED_SQL.format('source_file')} AS f FROM c),
q AS (SELECT DISTINCT id, ord, ' ' || array_to_string({_WORD.format('x')}, ' ') || ' ' AS phrase FROM (SELECT id, ord, unnest(string_split(title || ' ' || detail, ' ')) AS x FROM s) WHERE len({_WORD.format('x')}) > 0),
h AS (SELECT DISTINCT id, ord, rowid FROM q JOIN p ON contains(t, phrase) OR contains(f, phrase)),
r AS (SELECT h.id, h.ord, c.source_file, c.chunk_index, c.total_chunks, c.text, row_number() OVER k AS rn, count(*) OVER (PARTITION BY h.id, h.ord, c.source_file) AS n,
  sum(length(c.text)) OVER (PARTITION BY h.id, h.ord, c.source_file) AS len FROM h JOIN c USING (rowid) WINDOW k AS (PARTITION BY h.id, h.ord, c.source_file ORDER BY c.chunk_index, c.rowid)),
z AS (SELECT *, (rn - 1) // 30 AS run, coalesce(sum(length(text)) OVER (PARTITION BY id, ord, source_file, (rn - 1) // 30 ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 15000 AS within FROM r WHERE n > 30 OR len > 12000),
y AS (SELECT id, ord, source_file, run, within, md5(string_agg('[Chunk ' || (chunk_index + 1) || '/' || total_chunks || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rn)) AS s FROM z GROUP BY ALL),
l0 AS (SELECT id, ord, source_file, row_number() OVER (PARTITION BY id, ord, source_file ORDER BY run, within) - 1 AS part, s FROM y), {_REDUCE.format(to='l1', of='l0')}, {_REDUCE.format(to='l2', of='l1')}, {_REDUCE.format(to='l3', of='l2')},
t AS (SELECT id, ord, source_file, s AS content FROM l3 UNION ALL SELECT id, ord, source_file, string_agg(text, chr(10) || chr(10) ORDER BY rn) FROM r WHERE n <= 30 AND len <= 12000 GROUP BY id, ord, source_file),
g AS (SELECT t.*, row_number() OVER (PARTITION BY t.id, t.ord ORDER BY x.hits DESC, t.source_file) - 1 AS place, x.hits FROM t JOIN (SELECT id, ord, source_file, count(*) AS hits FROM r GROUP BY ALL) x USING (id, ord, source_file)),
a AS (SELECT g.id, g.ord, place // 30 AS part, count(*) AS files, md5(any_value(title || chr(10) || detail) || chr(10) || chr(10) || string_agg('【' || regexp_extract(source_file, '[^/]*$') || '】' || chr(10) || content, chr(10) || chr(10) ORDER BY place)) AS s FROM g JOIN s ON s.id = g.id AND s.ord = g.ord GROUP BY ALL),
o AS (SELECT id, ord, CAST(sum(files) AS BIGINT) AS files, CASE WHEN count(*) = 1 THEN min(s) ELSE md5(string_agg(s, chr(10) || chr(10) ORDER BY part)) END AS body FROM a GROUP BY id, ord),
e AS (SELECT s.id, s.ord, title, coalesce(files, 0) AS files, coalesce(body, '（未找到相关文件）') AS body FROM s LEFT JOIN o ON s.id = o.id AND s.ord = o.ord)"""


@query(f"{_SCAN} SELECT id, CAST(ord AS BIGINT) AS ord, title, CAST(files AS BIGINT) AS files, body FROM e")
def outline_scan(spark, sf_dir):
    """Outlines to the answer of every section, over stored postings."""
    c, stored = _stored(spark, sf_dir)
    return analysis.scan(_outlines(spark, sf_dir), c, _digest, stored)[0]


@query(f"""{_SCAN}, w AS (SELECT id, string_agg('## ' || title || chr(10) || chr(10) || body || chr(10), chr(10) || chr(10) ORDER BY ord) AS document FROM e GROUP BY id),
u AS (SELECT id, source_file, min(ord) AS ord, arg_min(hits, ord) AS hits FROM g GROUP BY id, source_file),
v AS (SELECT id, count(*) AS files, string_agg(source_file, ',' ORDER BY ord, hits DESC, source_file) AS sources FROM u GROUP BY id)
SELECT w.id, CASE WHEN files IS NULL THEN '未在知识库中找到与框架相关的文件内容。' ELSE document END AS document, coalesce(files, 0) AS files, coalesce(sources, '') AS sources FROM w LEFT JOIN v ON w.id = v.id""")
def outline_report(spark, sf_dir):
    """Outlines to one document each, with its sources; the corpus is scanned as it stands."""
    made = analysis.scan(_outlines(spark, sf_dir), chunks(spark, sf_dir, with_vector=False), _digest)[1]
    return made.select("id", "document", "files", F.array_join(F.transform("sources", lambda x: x["file_path"]), ",").alias("sources"))


# ---- statuses of files as a stream with state

_STATUSES = ("pending", "parsing", "parsed", "embedding", "embedded", "error", "cancelling", "cancelled", "duplicate")
_PATIENCE_HOURS = 12
_RANGES = 3
_FILES_EACH = 64


@query(f"""WITH RECURSIVE e AS (SELECT '/kb/' || user_id AS path, event_id AS seq, ts, {list(_STATUSES)}[CAST(event_id % 9 + 1 AS INT)] AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m(f, t) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, to in states.MOVES.items() for b in to)}),
w AS (SELECT DISTINCT path, CAST(0 AS BIGINT) AS n, '' AS held, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, '' AS before, '' AS status, '' AS verdict FROM e
 UNION ALL SELECT e.path, e.n, CASE WHEN m.t IS NULL THEN w.held ELSE e.status END, e.seq, e.ts, w.held, e.status, CASE WHEN m.t IS NULL THEN 'illegal' ELSE 'moved' END
 FROM w JOIN e ON e.path = w.path AND e.n = w.n + 1 LEFT JOIN m ON m.f = w.held AND m.t = e.status),
l AS (SELECT *, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY path ORDER BY n) AS next FROM w WHERE verdict = 'moved')
SELECT path, seq, epoch_us(ts) AS at_us, before, status, verdict FROM w WHERE n > 0
UNION ALL SELECT path, NULL, us + {_PATIENCE_HOURS * 3_600_000_000}, status, status, 'stuck' FROM l
WHERE status IN {states.UNFINISHED} AND (next IS NULL OR next > us + {_PATIENCE_HOURS * 3_600_000_000}) AND us // 1000 + {_PATIENCE_HOURS * 3_600_000} <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""")
def file_state_changes(spark, sf_dir):
    """Events come in ranges of time; after each the stream starts again from its checkpoint."""
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("event_id") % 9 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("/kb/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), "ts", status.alias("status"))
    base = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    # two numbers, and that of the files
    bounds, files = e.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / _RANGES for i in range(1, _RANGES)]), F.approx_count_distinct("path")).first()
    us, low = F.unix_micros(F.col("ts").cast("timestamp")), None
    for high in [*(bounds or []), None]:
        some = e.filter((F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high))
        some.write.mode("append").parquet(f"{base}/events")
        given = spark.readStream.schema(e.schema).parquet(f"{base}/events")
        states.start_states(given, f"{base}/changes", f"{base}/checkpoint", f"{_PATIENCE_HOURS} hours", files // _FILES_EACH + 1).awaitTermination()
        low = high
    return spark.read.schema(states.CHANGES).parquet(f"{base}/changes").select("path", "seq", F.unix_micros("at").alias("at_us"), "before", "status", "verdict")


# ---- answers, all modes of search, wide characters

def _lines(role: str, text: str) -> str:
    return f"'{role}:' || {text} || chr(10)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
k AS (SELECT DISTINCT conv_id FROM t), l AS (SELECT conv_id, max(turn) AS turn FROM t WHERE role = 'assistant' GROUP BY conv_id),
h AS (SELECT t.conv_id, string_agg(role || ':' || CASE WHEN role = 'user' THEN text || ' [1][3]' || CASE WHEN l.turn IS NULL THEN '' ELSE '(指上轮「t' || l.turn || '」)' END ELSE text END || chr(10), '' ORDER BY t.turn) AS said
  FROM t LEFT JOIN l ON l.conv_id = t.conv_id WHERE n <= 50 AND role IN ('user', 'assistant') GROUP BY t.conv_id)
SELECT k.conv_id AS session_id, CASE WHEN k.conv_id % 7 = 0 THEN {_q(rag.FAILED)} ELSE md5({_lines('system', f"CASE WHEN k.conv_id % 2 = 0 THEN {_q(rag.WITH_CONTEXT)} || 'about ' || k.conv_id ELSE {_q(rag.WITHOUT_CONTEXT)} END || CASE WHEN l.turn IS NULL THEN '' ELSE {_q(rag.LEGEND)} || '  [1] → a.pdf' || chr(10) || '  [2] → b.pdf' || chr(10) || '  [3] → t' || l.turn || {_q(rag.LEGEND_ENDS)} END")}
  || coalesce(said, '') || {_lines('user', "'what of [2]?'")}) END AS answer FROM k LEFT JOIN h ON h.conv_id = k.conv_id LEFT JOIN l ON l.conv_id = k.conv_id""".replace("|| ' [1][3]' ||", "|| ' [1]' || CASE WHEN l.turn IS NULL THEN '' ELSE '(指上轮「a.pdf」)' END || '[3]' ||"))
def asked(spark, sf_dir):
    """Every session is asked one more question, half of them with a context; the last answer's sources are explained, and some answers fail."""
    t = table(spark, sf_dir, "conversations")
    source = lambda *names: F.array(*[F.struct(F.lit("").alias("file"), n.alias("file_path")) for n in names])
    given = source(F.lit("/k/a.pdf"), F.lit("b.pdf"), F.concat(F.lit("/t"), F.col("turn").cast("string")))
    turns = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.when(F.col("role") == "user", F.concat(F.coalesce("text", F.lit("")), F.lit(" [1][3]"))).otherwise(F.col("text")).alias("content"), F.when(F.col("role") == "assistant", given).alias("sources"))
    c = F.col("session_id")
    questions = turns.select("session_id").distinct().select("session_id", F.lit("what of [2]?").alias("query"), F.when(c % 2 == 0, F.concat(F.lit("about "), c.cast("string"))).alias("context"))

    def generate(prompt: str) -> str:
        return _digest("".join(f"{m['role']}:{m['content']}\n" for m in json.loads(prompt)))

    told = rag.conversations(questions, turns)
    made = rag.answers(told.filter(c % 7 != 0), generate).unionByName(rag.answers(told.filter(c % 7 == 0), lambda prompt: None))
    return made.select("session_id", "answer")


_MODES = f"""WITH c AS ({chunks_sql()}), {catalog._merged_sql(catalog.WORDS, 60)},
v AS (SELECT rowid, round(s, 4) AS score FROM (SELECT rowid, s FROM vec) t)"""


@query(f"""{_MODES} SELECT 'keyword' AS mode, rowid, 1.0::DOUBLE AS score FROM kw UNION ALL SELECT 'fallback', rowid, 1.0::DOUBLE FROM kw UNION ALL SELECT 'vector', rowid, score FROM v
UNION ALL SELECT 'hybrid', rowid, round(score, 4) FROM h UNION ALL SELECT 'unembedded', rowid, 3.0::DOUBLE FROM
(SELECT rowid, row_number() OVER (ORDER BY fr <> 1, rowid) AS rank FROM (SELECT rowid, row_number() OVER (PARTITION BY source_file ORDER BY rowid) AS fr FROM kw)) WHERE rank <= 60""")
def search_modes(spark, sf_dir):
    """Every branch of the dispatcher: keywords, vectors with and without a model, both merged, and both without a model."""
    c, vector = chunks(spark, sf_dir), catalog._query_vector(spark, sf_dir)
    found = None
    for mode, name, embed in (("keyword", "keyword", None), ("vector", "fallback", lambda q: None), ("vector", "vector", lambda q: vector), ("any", "hybrid", lambda q: vector), ("any", "unembedded", None)):
        part = search.search(c, catalog.WORDS, mode, embed, 60).select(F.lit(name).alias("mode"), "rowid", "score")
        found = part if found is None else found.unionByName(part)
    return found


@query(f"""WITH d AS (SELECT doc_id AS rowid, text, lang FROM documents), w AS (SELECT rowid, replace(replace(replace(text, ' the ', ' 质量 '), ' and ', ' 量管理体 '), ' of ', '系') AS text, '/质量/' || lang || '.txt' AS source_file FROM d),
p AS (SELECT rowid, {PADDED_SQL.format('text')} AS t, {PADDED_SQL.format('source_file')} AS f, lower(text) AS g FROM w)
SELECT 'tokens' AS mode, rowid FROM p WHERE contains(t, ' 管理 ') OR contains(t, ' 理体 ') OR contains(t, ' whou ') UNION ALL
SELECT 'pairs', rowid FROM p WHERE contains(g, '管理') OR contains(g, '理体') OR contains(t, ' whou ') UNION ALL
SELECT 'runs', rowid FROM p WHERE contains(t, ' 量管理体 ')""")
def wide_search(spark, sf_dir):
    """Texts with runs of CJK characters: pairs as whole tokens, pairs inside runs, and a run as a quoted phrase."""
    text = F.col("text")
    for word, wide in ((" the ", " 质量 "), (" and ", " 量管理体 "), (" of ", "系")):
        text = F.replace(text, F.lit(word), F.lit(wide))
    c = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rowid"), F.col("doc_id").cast("string").alias("chunk_id"), text.alias("text"), F.concat(F.lit("/质量/"), "lang", F.lit(".txt")).alias("source_file"), F.lit("text").alias("file_type"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"))
    named = lambda mode, df: df.select(F.lit(mode).alias("mode"), "rowid")
    pairs = named("tokens", search.exhaustive_search(c, "管理体 whou")).unionByName(named("pairs", search.exhaustive_search(c, "管理体 whou", "cjk_bigram")))
    return pairs.unionByName(named("runs", search.exhaustive_search(c, '"量管理体"')))


# ---- metadata of any shape, paths of sections, progress

_SHAPES = ('{"page": 7, "tags": ["a", "b"]}', '{"page": "12", "deep": {"k": [1, {"x": 2.5}]}}', "[1, 2]", '{"broken": ')


@query(f"""WITH j AS (SELECT event_id, CASE WHEN event_id % 6 = 4 THEN NULL WHEN event_id % 6 = 5 THEN props ELSE [{', '.join(_q(x) for x in _SHAPES)}][CAST(event_id % 6 + 1 AS INT)] END AS m FROM events), v AS (SELECT event_id, CASE WHEN json_valid(m) THEN m END AS m FROM j)
SELECT event_id, m IS NOT NULL AS valid, CASE json_type(m) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind, TRY_CAST(json_extract_string(m, '$.page') AS INTEGER) AS page,
TRY_CAST(json_extract_string(m, '$.k') AS BIGINT) AS k, json_extract_string(m, '$.tags[1]') AS tag, TRY_CAST(json_extract_string(m, '$.deep.k[1].x') AS DOUBLE) AS x FROM v""")
def metadata_values(spark, sf_dir):
    """Metadata of four shapes beside the events' own, some of it broken or missing."""
    n = F.col("event_id") % 6
    text = F.when(n == 5, F.col("props"))
    for i, shape in enumerate(_SHAPES):
        text = text.when(n == i, shape)
    rows = table(spark, sf_dir, "events").select("event_id", metadata.parsed(text).alias("v"))
    v = F.col("v")
    return rows.select("event_id", v.isNotNull().alias("valid"), metadata.kind(v).alias("kind"), metadata.value(v, "$.page", "int").alias("page"), metadata.value(v, "$.k", "long").alias("k"), metadata.value(v, "$.tags[1]", "string").alias("tag"), metadata.value(v, "$.deep.k[1].x", "double").alias("x"))


@query("""WITH RECURSIVE w AS (SELECT item_id AS id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
s(ord, number, depth, parent_ord, word) AS (VALUES (1, '2.1.1', 3, NULL, 1), (2, '1', 1, NULL, 2), (3, '1.1', 2, 2, 3), (4, '1.1.1', 3, 3, 4), (5, '1.1.1.1', 4, 3, 5), (6, '2', 1, NULL, 6), (7, '2.1', 2, 6, 7)),
n AS (SELECT id, s.*, w[word] AS title FROM w, s), r AS (SELECT id, ord, title AS path, ord AS top_ord FROM n WHERE parent_ord IS NULL UNION ALL SELECT n.id, n.ord, r.path || ' > ' || n.title, r.top_ord FROM n JOIN r ON r.id = n.id AND r.ord = n.parent_ord)
SELECT n.id, CAST(n.ord AS BIGINT) AS ord, number, depth, CAST(parent_ord AS BIGINT) AS parent_ord, path, CAST(top_ord AS BIGINT) AS top_ord, CASE n.ord WHEN 2 THEN 'note one|note two' WHEN 6 THEN 'last' ELSE '' END AS extra FROM n JOIN r USING (id, ord)""")
def framework_paths(spark, sf_dir):
    """An outline of four depths for each item of the benchmark, its first section an orphan."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)).alias("w"))
    line = lambda number, word: F.concat(F.lit(f"{number} "), F.element_at("w", word))
    text = F.array_join(F.array(F.lit("preamble"), line("2.1.1", 1), line("1.", 2), F.lit("note one"), line("1.1", 3), line("1.1.1", 4), F.lit("  note two "), line("1.1.1.1", 5), line("2.", 6), line("2.1", 7), F.lit("last")), "\n")
    made = outline.section_paths(outline.tree_sections(b.select("id", text.alias("text"))))
    return made.select("id", "ord", "number", "depth", "parent_ord", F.array_join("path", " > ").alias("path"), "top_ord", F.array_join("extra", "|").alias("extra"))


# ---- comparing texts

_COMPARED = catalog.ORACLE_SQL["compare_context"].replace("AS digest\nFROM k", "AS content\nFROM k").replace("md5('===== '", "('===== '")


@query(f"""WITH x AS ({_COMPARED}), n AS (SELECT count(*) AS total_hit FROM (SELECT DISTINCT source_file FROM ({chunks_sql()}) c WHERE {catalog._match_sql(catalog.COMMON)}))
SELECT md5('{catalog.COMMON}' || chr(10) || chr(10) || string_agg(content, chr(10) || chr(10) ORDER BY ord) || CASE WHEN any_value(total_hit) > count(*) THEN chr(10) || chr(10) || {_q(analysis.SHOWN[0])} || any_value(total_hit) || {_q(analysis.SHOWN[1])} || count(*) || {_q(analysis.SHOWN[2])} ELSE '' END) AS answer,
count(*) AS files, any_value(total_hit) AS total_hit, string_agg(source_file, ',' ORDER BY ord) AS sources FROM x, n""")
def compare_report(spark, sf_dir):
    """From a task to its answer over the texts of the files that match it."""
    made = analysis.compare(chunks(spark, sf_dir, with_vector=False), catalog.COMMON, _digest)
    return made.select("answer", "files", "total_hit", F.array_join(F.transform("sources", lambda x: x["file_path"]), ",").alias("sources"))


# ---- chunks of documents, their lines as paragraphs

_ESTIMATE = "CAST(floor(2.0 * len(regexp_extract_all(p, '[a-zA-Z]+')) + length(regexp_replace(p, '[a-zA-Z]', '', 'g'))) AS BIGINT)"
_PIECES = f"""p AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)),
z AS (SELECT *, {_ESTIMATE} AS n FROM p),
q AS (SELECT doc_id, pos, p, list_filter(list_transform(regexp_extract_all(p, '[^。！？!?]*[。！？!?]|[^。！？!?]+$'), lambda x: trim(x)), lambda x: x <> '') AS s FROM z WHERE n > 1024),
u AS (SELECT doc_id, pos, 0 AS part, p FROM z WHERE n <= 1024 UNION ALL SELECT doc_id, pos, 0, p FROM q WHERE len(s) <= 1
 UNION ALL SELECT doc_id, pos, unnest(range(0, len(s), 10)), unnest(list_transform(range(0, len(s), 10), lambda i: array_to_string(s[i + 1:i + 10], ''))) FROM q WHERE len(s) > 1),
t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS i, p, {_ESTIMATE} AS n FROM u),
v AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM t)"""


@query(f"""WITH RECURSIVE {_PIECES},
k AS (SELECT a.doc_id, a.i, a.n, a.upto - a.n AS before, count(b.i) AS held FROM v a LEFT JOIN v b ON b.doc_id = a.doc_id AND b.i < a.i AND a.upto - a.n - (b.upto - b.n) <= 64 GROUP BY ALL),
f AS (SELECT doc_id, i, CAST(1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS low, CAST(NULL AS BIGINT) AS flushed FROM k WHERE i = 1
 UNION ALL SELECT k.doc_id, k.i, CASE WHEN k.before - f.low + k.n > 1024 THEN k.i - k.held ELSE f.start END, CASE WHEN k.before - f.low + k.n > 1024 THEN o.upto - o.n ELSE f.low END, CASE WHEN k.before - f.low + k.n > 1024 THEN f.start END
 FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1 JOIN v o ON o.doc_id = k.doc_id AND o.i = k.i - k.held),
r AS (SELECT doc_id, flushed AS a, i - 1 AS b FROM f WHERE flushed IS NOT NULL UNION ALL SELECT doc_id, arg_max(start, i), max(i) FROM f GROUP BY doc_id),
c AS (SELECT r.doc_id, a, b, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM r JOIN v ON v.doc_id = r.doc_id AND v.i BETWEEN a AND b GROUP BY ALL),
e AS (SELECT doc_id, b, a, 0 AS part, CAST(NULL AS VARCHAR) AS piece, text AS rest, CAST(0 AS BIGINT) AS at FROM c
 UNION ALL SELECT doc_id, b, a, part + 1, substr(rest, 1, cut), ltrim(substr(rest, cut + 1), chr(10)), cut FROM
 (SELECT *, CASE WHEN length(rest) <= 3000 THEN length(rest) WHEN strpos(reverse(substr(rest, 1, 3000)), chr(10)) BETWEEN 1 AND 2999 THEN 3000 - strpos(reverse(substr(rest, 1, 3000)), chr(10)) ELSE 3000 END AS cut FROM e WHERE rest <> '')),
g AS (SELECT doc_id, trim(piece, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, part) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM e WHERE part > 0)
SELECT '/kb/' || doc_id || '.txt' AS source_file, chunk_index, total_chunks, md5(text) AS digest, length(text) AS chars FROM g""")
def chunked_documents(spark, sf_dir):
    """Lines as paragraphs, packed into chunks with an overlap, long ones split; what is over the limit goes on in further chunks."""
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/kb/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.lit("text").alias("file_type"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"),
        F.lit(None).cast("array<string>").alias("pages"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    made = chunk_documents(d, lossless=True)
    return made.select("source_file", "chunk_index", "total_chunks", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))
