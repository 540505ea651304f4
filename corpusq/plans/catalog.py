"""Every registered query of the library, with the SQL that must agree with it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.functions.vectors import l2_normalize
from corpusq.operators import analysis, ann, evidence, outline, postings, rag, search, sessions, status
from corpusq.operators.chunk import chunk_documents, page_of
from corpusq.plans.views import PADDED_SQL, chunks, chunks_sql, table
from corpusq.session import shared_dir
from corpusq.sources.files import page_text
from corpusq.streaming.ingest import event_windows as windows_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS = "retitioning eleve thand"
COMMON = "the eleve que"
QUERY_ID = 7
TOP_K = 120
POINTS = ("retitioning eleve", "thand onwh", "que eaueneaux", "der schlich")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_ID) -> list[float]:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()  # one vector
    return [float(x) for x in rows[0][0]]


def _match_sql(words: str, text: str = "text", path: str = "source_file") -> str:
    return "(" + " OR ".join(f"contains({PADDED_SQL.format(c)}, ' {w} ')" for w in words.split() for c in (text, path)) + ")"


def _kw_sql(words: str, fetch: int, name: str = "kw") -> str:
    return f"{name} AS (SELECT * FROM c WHERE {_match_sql(words)} ORDER BY rowid LIMIT {fetch})"




def _merged_sql(words: str, top_k: int, vec_id: int = QUERY_ID, suffix: str = "") -> str:
    """kw, vec and m (merged hits) as WITH entries over c."""
    s = suffix
    return f"""{_kw_sql(words, max(5 * top_k, 200), 'kw' + s)},
q{s} AS (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}),
vec{s} AS (SELECT *, row_number() OVER (ORDER BY s DESC, rowid) AS vr FROM (
  SELECT c.*, list_dot_product(CAST(vector AS DOUBLE[]), CAST((SELECT embedding FROM q{s}) AS DOUBLE[])) AS s FROM c WHERE vector IS NOT NULL)
  ORDER BY s DESC, rowid LIMIT (SELECT greatest({5 * top_k}, least(200, count(*))) FROM c WHERE vector IS NOT NULL)),
m{s} AS (SELECT coalesce(k.rowid, v.rowid) AS rowid, coalesce(k.text, v.text) AS text, coalesce(k.source_file, v.source_file) AS source_file,
  coalesce(k.chunk_index, v.chunk_index) AS chunk_index, coalesce(k.total_chunks, v.total_chunks) AS total_chunks,
  CASE WHEN k.rowid IS NULL THEN 0.0 ELSE 2.0 END + coalesce(v.s, 0.0) AS score, CASE WHEN v.rowid IS NULL THEN 'keyword' ELSE 'vector' END AS match_type,
  k.rowid IS NULL AS ov, coalesce(k.rowid, v.vr) AS tie FROM kw{s} k FULL JOIN vec{s} v ON k.rowid = v.rowid),
r{s} AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, ov, tie) AS fr FROM m{s}),
h{s} AS (SELECT *, row_number() OVER (ORDER BY (fr <> 1 OR source_file = ''), score DESC, ov, tie) AS rank FROM r{s} ORDER BY rank LIMIT {top_k})"""


def _c(constant_ext: str | None = None) -> str:
    return f"WITH c AS ({chunks_sql(constant_ext)})"


def _hybrid(spark: SparkSession, sf_dir: str, words: str = COMMON, top_k: int = TOP_K, constant_ext: str | None = None) -> DataFrame:
    return search.hybrid_search(chunks(spark, sf_dir, constant_ext), words, _query_vector(spark, sf_dir), top_k)


# ---- search

@query(f"{_c()}, {_kw_sql(WORDS, 250)} SELECT rowid, source_file, 1.0::DOUBLE AS score, 'keyword' AS match_type FROM kw")
def keyword_search(spark, sf_dir):
    return search.keyword_search(chunks(spark, sf_dir, with_vector=False), WORDS, 50).select("rowid", "source_file", "score", "match_type")


@query(f"{_c()} SELECT rowid, source_file FROM c WHERE contains({PADDED_SQL.format('text')}, ' of the ') OR contains({PADDED_SQL.format('source_file')}, ' of the ') ORDER BY rowid LIMIT 250")
def phrase_search(spark, sf_dir):
    return search.keyword_search(chunks(spark, sf_dir, with_vector=False), "of-the", 50).select("rowid", "source_file")


_VEC = f"""{_c()}, q AS (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}),
s AS (SELECT rowid, source_file, list_dot_product(CAST(vector AS DOUBLE[]), CAST((SELECT embedding FROM q) AS DOUBLE[])) AS s FROM c WHERE vector IS NOT NULL)
SELECT rowid, source_file, round(s, 4) AS score FROM s ORDER BY s DESC, rowid LIMIT 250"""


@query(_VEC)
def vector_search(spark, sf_dir):
    return search.vector_search(chunks(spark, sf_dir), _query_vector(spark, sf_dir), 50).select("rowid", "source_file", F.round("score", 4).alias("score"))


@query(_VEC.replace("rowid, source_file, round", "rowid, round").replace("SELECT rowid, source_file, list_dot", "SELECT rowid, list_dot"))
def vector_search_arrow(spark, sf_dir):
    return search.vector_search_arrow(chunks(spark, sf_dir), _query_vector(spark, sf_dir), 250).select("rowid", F.round("score", 4).alias("score"))


@query(f"{_c()}, {_merged_sql(COMMON, TOP_K)} SELECT CAST(rank AS INTEGER) AS rank, rowid, source_file, round(score, 4) AS score, match_type FROM h")
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("rank", "rowid", "source_file", F.round("score", 4).alias("score"), "match_type")


@query(f"{_c()}, {_kw_sql(WORDS, 500)} SELECT rowid, 1.0::DOUBLE AS score, 'keyword' AS match_type FROM kw")
def search_dispatch(spark, sf_dir):
    return search.search(chunks(spark, sf_dir), WORDS, "keyword", top_k=100).select("rowid", "score", "match_type")


@query(f"{_c()} SELECT source_file, count(*) AS hits FROM c WHERE {_match_sql(WORDS)} GROUP BY source_file")
def exhaustive_hits(spark, sf_dir):
    return analysis.files_by_hits(search.exhaustive_search(chunks(spark, sf_dir, with_vector=False), WORDS))


@query(f"""{_c()} SELECT rowid, array_to_string(regexp_extract_all(strip_accents(lower(source_file)), '[\\p{{L}}\\p{{N}}]+'), '|') AS path_tokens,
len(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS n_tokens FROM c""")
def postings_input(spark, sf_dir):
    c = chunks(spark, sf_dir, with_vector=False)
    return c.select("rowid", F.array_join(tx.tokens(F.col("source_file")), "|").alias("path_tokens"), F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


# ---- catalog and text

@query(f"{_c()} SELECT source_file AS path, regexp_extract(source_file, '[^/]*$') AS name, count(*) AS chunks, min(file_type) AS type FROM c GROUP BY source_file")
def file_list(spark, sf_dir):
    c = chunks(spark, sf_dir, with_vector=False)
    return c.groupBy("source_file").agg(F.count("*").alias("chunks")).select(F.col("source_file").alias("path"), tx.basename(F.col("source_file")).alias("name"), "chunks", tx.file_type(F.col("source_file")).alias("type")).orderBy("path")


@query(f"{_c()} SELECT source_file, chunk_index, rowid FROM c WHERE source_file IN ('/kb/en/src0.pdf', '/kb/fr/src1.docx', '/kb/none')")
def chunks_by_source(spark, sf_dir):
    return chunks(spark, sf_dir, with_vector=False).filter(F.col("source_file").isin("/kb/en/src0.pdf", "/kb/fr/src1.docx", "/kb/none")).select("source_file", "chunk_index", "rowid").orderBy("source_file", "chunk_index")


@query(f"{_c()} SELECT DISTINCT source_file FROM c")
def distinct_files(spark, sf_dir):
    return chunks(spark, sf_dir, with_vector=False).select("source_file").distinct()


@query("SELECT count(*) AS chunks, count(embedding) AS vectors FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def chunk_count(spark, sf_dir):
    return chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"))


@query(r"""SELECT doc_id, CAST(floor(2.0 * len(regexp_extract_all(text, '[a-zA-Z]+')) + length(regexp_replace(text, '[a-zA-Z]', '', 'g'))) AS BIGINT) AS chunk_tokens,
CAST(CASE WHEN length(text) = 0 THEN 0 ELSE floor(0.25 * length(regexp_replace(text, '\s', '', 'g'))) + 1 END AS BIGINT) AS budget_tokens FROM documents""")
def token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.chunk_tokens(F.col("text")).alias("chunk_tokens"), tx.budget_tokens(F.col("text")).alias("budget_tokens"))


@query(f"{_c()} SELECT file_type, count(DISTINCT source_file) AS files, count(*) AS chunks FROM c GROUP BY file_type")
def doc_type_map(spark, sf_dir):
    return chunks(spark, sf_dir, with_vector=False).groupBy("file_type").agg(F.countDistinct("source_file").alias("files"), F.count("*").alias("chunks"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 3 / sqrt(list_dot_product(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3))), 4) AS first, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def l2_normalized(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 4).alias("first"), F.size("v").cast("long").alias("dim"))


@query("""SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f MB', s / 1048576.0) END AS size_str
FROM (SELECT doc_id, strlen(text) * (1 + doc_id % 3 * 700) AS s FROM documents)""")
def sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.format_size(F.octet_length("text") * (1 + F.col("doc_id") % 3 * 700)).alias("size_str"))


@query("SELECT doc_id, substr(text, 1, 3000) AS embed_text FROM documents WHERE length(text) > 2500")
def embed_input(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") > 2500).select("doc_id", F.substring("text", 1, 3000).alias("embed_text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- duplicates and status

@query("""SELECT doc_id, md5(text) AS hash, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate_in_batch' ELSE 'new' END AS verdict FROM documents""")
def md5_dedup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return status.dedup(files).select(F.col("pos").alias("doc_id"), "hash", "verdict")


@query("""WITH f AS (SELECT doc_id, md5(text) AS hash FROM documents), m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE hash END AS hash FROM f WHERE doc_id % 3 = 0),
n AS (SELECT f.*, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS n FROM f)
SELECT n.doc_id, CASE WHEN m.hash = n.hash THEN 'unchanged' WHEN n.hash IN (SELECT hash FROM m) THEN 'duplicate_of_indexed' WHEN n > 1 THEN 'duplicate_in_batch' WHEN m.doc_id IS NOT NULL THEN 'changed' ELSE 'new' END AS verdict
FROM n LEFT JOIN m USING (doc_id)""")
def manifest_dedup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"))
    manifest = files.filter(F.col("pos") % 3 == 0).select("path", F.when(F.col("pos") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return status.dedup(files, manifest).select(F.col("pos").alias("doc_id"), "verdict")


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents m WHERE m.doc_id % 3 = 0 AND m.text = d.text)""")
def manifest_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return d.join(d.filter("doc_id % 3 = 0").select("hash"), "hash", "left_anti").select("doc_id")


def _status_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % len(status.STATES)
    state = F.element_at(F.array(*[F.lit(s) for s in status.STATES]), i + 1)
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("/kb/u"), F.col("user_id").cast("string")).alias("path"), state.alias("status"), F.when(state == "error", F.col("event_type")).alias("error"))


_EVENTS = f"""WITH e AS (SELECT event_id AS seq, '/kb/u' || user_id AS path, [{', '.join(f"'{s}'" for s in status.STATES)}][CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 4))::BIGINT % {len(status.STATES)} AS INT) + 1] AS status, event_type FROM events),
s AS (SELECT path, arg_max(status, seq) AS status, arg_max(CASE WHEN status = 'error' THEN event_type ELSE '' END, seq) AS error FROM e GROUP BY path)"""


@query(_EVENTS + " SELECT status, count(*) AS files FROM s GROUP BY status")
def status_counts(spark, sf_dir):
    return status.current_status(_status_events(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("files"))


@query(_EVENTS + """, x AS (SELECT path, arg_min(CASE WHEN seq % 2 = 0 THEN 'embed_error' ELSE 'parse_error' END, seq) AS t FROM e WHERE status = 'error' GROUP BY path)
SELECT CASE WHEN status = 'error' THEN coalesce(t, 'parse_error') WHEN status = 'duplicate' THEN 'duplicate' WHEN status IN ('cancelled', 'cancelling') THEN 'cancelled' ELSE 'parse_error' END AS "group", path, status,
CASE WHEN status IN ('pending', 'parsing', 'parsed', 'embedding') THEN 'incomplete' WHEN status = 'error' THEN error END AS error FROM s LEFT JOIN x USING (path) WHERE status <> 'embedded'""")
def failed_groups(spark, sf_dir):
    e = _status_events(spark, sf_dir)
    errors = e.filter("status = 'error'").select(F.col("seq").alias("pos"), "path", F.when(F.col("seq") % 2 == 0, "embed_error").otherwise("parse_error").alias("type"))
    current = e.groupBy("path").agg(F.max_by("status", "seq").alias("status"), F.max_by(F.coalesce("error", F.lit("")), "seq").alias("error"))
    current = current.withColumn("error", F.when(F.col("status") == "error", F.col("error")))
    return status.failed_groups(current, errors)


@query("""SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, substr(props, 1, 100) ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def error_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("path"), F.lit("f").alias("file"), F.col("props").alias("message"), "user_id")
    return status.dedupe_errors(e).select(F.col("pos").alias("event_id"), F.col("type").alias("event_type"), "user_id")


@query("""WITH m AS (SELECT doc_id, 'old' AS hash FROM documents WHERE doc_id % 2 = 0), d AS (SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 3 = 0 AND length(text) > 500)
SELECT CAST(doc_id AS VARCHAR) AS path, hash FROM m WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT CAST(doc_id AS VARCHAR), hash FROM d""")
def manifest_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"), "doc_id", F.length("text").alias("n"))
    old = d.filter("doc_id % 2 = 0").select("path", F.lit("old").alias("hash"), F.lit(0.0).alias("indexed_at"))
    done = d.filter("doc_id % 3 = 0").select("path", "hash", F.when(F.col("n") > 500, "embedded").otherwise("error").alias("status"), F.lit(1.0).alias("indexed_at"))
    return status.merge_manifest(old, done).select("path", "hash")


@query("""SELECT 'total' AS what, NULL AS user_id, CAST(sum(event_id) AS BIGINT) AS ms, count(*) AS chunks FROM events
UNION ALL SELECT 'slow', user_id, ms, chunks FROM (SELECT user_id, CAST(sum(event_id) AS BIGINT) AS ms, count(*) AS chunks FROM events GROUP BY user_id ORDER BY ms DESC, CAST(user_id AS VARCHAR) LIMIT 3)""")
def pipeline_profile(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("event_id").alias("ms"), F.count("*").alias("chunks")).withColumn("path", F.col("user_id").cast("string"))
    total, slow = status.profile(t)
    return total.select(F.lit("total").alias("what"), F.lit(None).cast("bigint").alias("user_id"), F.col("total_ms").alias("ms"), "chunks").unionByName(slow.select(F.lit("slow").alias("what"), "user_id", "ms", "chunks"))


@query("SELECT count(*) FILTER (value > 50) AS ok, count(*) AS total FROM events")
def ok_summary(spark, sf_dir):
    return status.ok_summary(table(spark, sf_dir, "events").select((F.col("value") > 50).alias("ok")))


# ---- evidence

def _evidence_hits(spark, sf_dir) -> DataFrame:
    q = _query_vector(spark, sf_dir)
    return search.hybrid_search_many(chunks(spark, sf_dir), [(p, p, q) for p in POINTS], 30, 200)


_EV = _c() + ", " + ", ".join(_merged_sql(p, 30, QUERY_ID, f"_{i}").replace("LIMIT (SELECT greatest(150, least(200, count(*))) FROM c WHERE vector IS NOT NULL)", "LIMIT 200") for i, p in enumerate(POINTS)) + """,
hits AS (""" + " UNION ALL ".join(f"SELECT '{p}' AS point, source_file, score FROM h_{i}" for i, p in enumerate(POINTS)) + """),
sc AS (SELECT point, source_file, greatest(max(score), 0.0) AS score, count(*) AS chunks FROM hits GROUP BY ALL)"""


@query(_EV + " SELECT point, source_file, round(score, 4) AS score, chunks FROM sc")
def evidence_scores(spark, sf_dir):
    return evidence.scores(_evidence_hits(spark, sf_dir)).withColumn("score", F.round("score", 4))


_POINT_ROWS = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(POINTS)) + ") AS p(ord, point)"


@query(_EV + f""" SELECT f.source_file, string_agg(p.point || '=' || printf('%.4f', round(coalesce(sc.score, 0.0), 4)) || '/' || coalesce(sc.chunks, 0), ';' ORDER BY p.ord) AS topics, round(max(coalesce(sc.score, 0.0)), 4) AS max_score
FROM (SELECT DISTINCT source_file FROM c) f CROSS JOIN {_POINT_ROWS} LEFT JOIN sc ON sc.source_file = f.source_file AND sc.point = p.point GROUP BY f.source_file""")
def evidence_matrix(spark, sf_dir):
    points = spark.createDataFrame(list(enumerate(POINTS)), "ord int, point string")
    m = evidence.matrix(evidence.scores(_evidence_hits(spark, sf_dir)), points, chunks(spark, sf_dir, with_vector=False))
    one = lambda t: F.concat(t["point"], F.lit("="), F.format_string("%.4f", t["score"]), F.lit("/"), t["chunks"].cast("string"))
    return m.select("source_file", F.array_join(F.transform("topics", one), ";").alias("topics"), "max_score")


@query(_EV + f""" SELECT p.point, count(sc.source_file) AS files, (SELECT count(DISTINCT source_file) FROM c) AS total_files, round(coalesce(avg(sc.score), 0.0), 4) AS avg_score, round(coalesce(max(sc.score), 0.0), 4) AS max_score
FROM {_POINT_ROWS} LEFT JOIN sc ON sc.point = p.point GROUP BY p.point""")
def topic_coverage(spark, sf_dir):
    points = spark.createDataFrame(list(enumerate(POINTS)), "ord int, point string")
    n = chunks(spark, sf_dir, with_vector=False).select("source_file").distinct().count()
    return evidence.coverage(evidence.scores(_evidence_hits(spark, sf_dir)), points, n)


# ---- answering

_ASK = "please compare src12.pdf with src1.docx and the others"


@query(f"""{_c()}, f AS (SELECT DISTINCT source_file, lower(regexp_extract(source_file, '[^/]*$')) AS name FROM c),
g AS (SELECT source_file, (length(split_part(name, '.', 1)) >= 6 AND contains('{_ASK}', split_part(name, '.', 1))) AS exact,
  len(list_filter(range(1, length(name) - 4), lambda i: contains('{_ASK}', substr(name, i, 6)))) > 0 AS piece FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY source_file) AS ord FROM g WHERE exact OR piece)
SELECT source_file, CAST(ord AS INTEGER) AS ord FROM o WHERE exact OR ord <= 10""")
def filename_targets(spark, sf_dir):
    return rag.filename_targets(chunks(spark, sf_dir, with_vector=False), _ASK)


@query(f"""{_c()}, {_merged_sql(COMMON, TOP_K)}, t AS (SELECT * FROM (VALUES ('/kb/en/src0.pdf'), ('/kb/fr/src1.docx')) v(source_file)),
k AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, rowid) - 1 AS nth, greatest(1, count(*) OVER (PARTITION BY source_file) // 3) AS step FROM c WHERE source_file IN (SELECT source_file FROM t)),
p AS (SELECT k.*, rowid NOT IN (SELECT rowid FROM h) AS absent, (SELECT count(*) FROM h WHERE h.source_file = k.source_file) AS have FROM k WHERE nth % step = 0),
n AS (SELECT *, coalesce(sum(absent::INT) OVER (PARTITION BY source_file ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT rowid, source_file, round(score, 4) AS score, match_type FROM h UNION ALL SELECT rowid, source_file, 5.0, 'targeted' FROM n WHERE absent AND (nth = 0 OR have + before < 5)""")
def targeted_injection(spark, sf_dir):
    targets = spark.createDataFrame([("/kb/en/src0.pdf",), ("/kb/fr/src1.docx",)], "source_file string")
    return rag.targeted_injection(_hybrid(spark, sf_dir), chunks(spark, sf_dir, with_vector=False), targets).select("rowid", "source_file", F.round("score", 4).alias("score"), "match_type")


_SRC = f"""{_c('.txt')}, {_merged_sql(COMMON, TOP_K)},
fh AS (SELECT source_file, arg_min(text, rank) AS text, arg_min(score, rank) AS score FROM h GROUP BY source_file),
src AS (SELECT row_number() OVER (ORDER BY lower(regexp_extract(source_file, '[^/]*$')), lower(source_file), source_file) AS number,
  CASE WHEN count(*) OVER (PARTITION BY regexp_extract(source_file, '[^/]*$')) > 1 THEN split_part(source_file, '/', 3) || '/' ELSE '' END || regexp_extract(source_file, '[^/]*$') AS file,
  source_file AS file_path, substr(text, 1, 200) AS snippet, round(score, 3) AS score FROM fh)"""


@query(_SRC + " SELECT * FROM src")
def source_numbering(spark, sf_dir):
    return rag.numbered_sources(_hybrid(spark, sf_dir, constant_ext=".txt")).drop("source")


@query(_SRC + """ SELECT string_agg('[' || number || '] (Source: ' || file || ', Chunk ' || (chunk_index + 1) || '/' || total_chunks || ')' || chr(10) || substr(text, 1, 3000), chr(10) || chr(10) ORDER BY number, rank) AS context
FROM h JOIN src ON h.source_file = src.file_path""")
def rag_context(spark, sf_dir):
    hits = _hybrid(spark, sf_dir, constant_ext=".txt")
    return rag.context(hits, rag.numbered_sources(hits))


# ---- sampling and budgets

@query(f"""{_c()}, n AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, rowid) AS rn FROM c)
SELECT rowid, source_file FROM n WHERE total_chunks <= 50 OR rn <= 15 OR rn > total_chunks - 15 OR (rn - 16) % greatest(1, (total_chunks - 30) // 20) = 0""")
def stratified_sample(spark, sf_dir):
    return analysis.stratified_sample(chunks(spark, sf_dir, with_vector=False)).select("rowid", "source_file")


@query(f"""{_c()}, u AS (SELECT rowid, source_file, CAST(sum(least(length(text), 4000)) OVER (PARTITION BY source_file ORDER BY chunk_index, rowid) AS BIGINT) AS used FROM c) SELECT * FROM u WHERE used <= 20000""")
def char_budget(spark, sf_dir):
    return analysis.char_budget(chunks(spark, sf_dir, with_vector=False), total=20000).select("rowid", "source_file", F.col("used").cast("long").alias("used"))


@query(f"{_c()} SELECT rowid, source_file, (row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, rowid) - 1) // 10 AS batch FROM c")
def batch_assign(spark, sf_dir):
    return analysis.batches(chunks(spark, sf_dir, with_vector=False), ["chunk_index", "rowid"], 10, ["source_file"]).select("rowid", "source_file", "batch")


@query(f"""{_c()}, t AS (SELECT source_file, substr(string_agg(substr(text, 1, 2000), chr(10) || chr(10) ORDER BY chunk_index), 1, 12000) AS cut, sum(least(length(text), 2000)) + 2 * (count(*) - 1) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, rowid) AS rn FROM c) WHERE rn <= 30 GROUP BY source_file)
SELECT source_file, md5(cut || CASE WHEN n > 12000 THEN chr(10) || '...(truncated)' ELSE '' END) AS digest FROM t""")
def file_text(spark, sf_dir):
    return analysis.file_text(chunks(spark, sf_dir, with_vector=False)).select("source_file", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""{_c()}, hit AS (SELECT * FROM c WHERE {_match_sql(COMMON)}),
top AS (SELECT source_file, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source_file) AS ord FROM hit GROUP BY source_file ORDER BY ord LIMIT 40),
s AS (SELECT hit.*, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, rowid) AS rn, count(*) OVER (PARTITION BY source_file) AS n FROM hit WHERE source_file IN (SELECT source_file FROM top)),
k AS (SELECT *, sum(least(length(text), 4000)) OVER (PARTITION BY source_file ORDER BY chunk_index, rowid) AS used FROM s WHERE n <= 50 OR rn <= 15 OR rn > n - 15 OR (rn - 16) % greatest(1, (n - 30) // 20) = 0)
SELECT top.ord, top.source_file, md5('===== ' || regexp_extract(top.source_file, '[^/]*$') || ' =====' || chr(10) || string_agg('--- Chunk ' || (chunk_index + 1) || '/' || total_chunks || ' ---' || chr(10) || substr(text, 1, 4000), chr(10) || chr(10) ORDER BY chunk_index, rowid) FILTER (used <= 60000)
|| CASE WHEN max(used) > 60000 THEN chr(10) || chr(10) || chr(10) || '...(后续内容因长度限制省略)' ELSE '' END) AS digest
FROM k JOIN top USING (source_file) GROUP BY top.ord, top.source_file""")
def compare_context(spark, sf_dir):
    hits = search.exhaustive_search(chunks(spark, sf_dir, with_vector=False), COMMON)
    return analysis.compare_context(hits).select("ord", "source_file", F.md5(F.col("content").cast("binary")).alias("digest"))


# ---- sessions

def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("created_at"))


def _sessions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("topic"), F.count("*").alias("turn_count"), F.sum(F.length("text")).alias("updated_at"), F.max((F.col("turn") > 3).cast("int")).alias("is_active"), F.lit("day").alias("created_at"))


@query("SELECT conv_id AS id, count(*) AS turn_count, CAST(sum(length(text)) AS BIGINT) AS updated_at FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 5")
def session_list(spark, sf_dir):
    return sessions.list_sessions(_sessions(spark, sf_dir), 50, 5).select("id", "turn_count", "updated_at")


@query("SELECT conv_id AS session_id, turn AS id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 AND role IN ('user', 'assistant')")
def recent_turns(spark, sf_dir):
    return rag.recent_history(_turns(spark, sf_dir), 3).select("session_id", "id", "role")


@query("SELECT conv_id AS session_id, turn AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def turn_retention(spark, sf_dir):
    return sessions.retained_turns(_turns(spark, sf_dir), 4).select("session_id", "id")


@query("""WITH s AS (SELECT conv_id AS id, CAST(sum(length(text)) AS BIGINT) AS updated_at, max(turn > 3) AS active FROM conversations GROUP BY conv_id),
x AS (SELECT id FROM s WHERE NOT active ORDER BY updated_at, id LIMIT (SELECT greatest(0, count(*) - 60) FROM s)) SELECT id FROM s WHERE id NOT IN (SELECT id FROM x)""")
def session_retention(spark, sf_dir):
    return sessions.retained_sessions(_sessions(spark, sf_dir), 60).select("id")


@query("SELECT conv_id AS id, CAST(sum(length(text)) AS BIGINT) AS updated_at FROM conversations GROUP BY conv_id HAVING max(turn) > 3 ORDER BY updated_at DESC, id DESC LIMIT 1")
def active_session(spark, sf_dir):
    return sessions.active_session(_sessions(spark, sf_dir)).select("id", "updated_at")


@query(r"""SELECT conv_id AS session_id, count(*) AS messages, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE floor(0.25 * length(regexp_replace(text, '\s', '', 'g'))) + 1 END + 4) AS BIGINT) AS tokens,
sum(CASE WHEN length(text) = 0 THEN 0 ELSE floor(0.25 * length(regexp_replace(text, '\s', '', 'g'))) + 1 END + 4) > 400000 AS over_budget FROM conversations GROUP BY conv_id""")
def message_tokens(spark, sf_dir):
    return sessions.message_tokens(_turns(spark, sf_dir))


@query("""SELECT conv_id AS id, '# 审计记录' || chr(10) || chr(10) || '- **会话ID**: ' || conv_id || chr(10) || '- **主题**: ' || arg_min(text, turn) || chr(10) || '- **开始时间**: day' || chr(10) || '- **问答轮次**: ' || count(*) || chr(10) || chr(10)
|| string_agg('## [' || n || '] ' || CASE role WHEN 'user' THEN '用户' ELSE 'AI' END || ' (t' || turn || ')' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS markdown
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def session_export(spark, sf_dir):
    return sessions.export_markdown(_sessions(spark, sf_dir), _turns(spark, sf_dir))


@query("SELECT conv_id AS session_id, turn AS id, arg_min(text, turn) OVER (PARTITION BY conv_id) AS topic FROM conversations")
def session_turns(spark, sf_dir):
    return sessions.session_turns(_sessions(spark, sf_dir), _turns(spark, sf_dir)).select("session_id", "id", "topic")


# ---- outlines



def _outlines(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 3 == 0, F.lower("text")).otherwise(F.concat(F.lit("before\nA. "), F.replace("text", F.lit(". "), F.concat(F.lit("\n"), (F.col("item_id") % 9 + 1).cast("string"), F.lit(". "))))).alias("text"))


_L = """WITH o AS (SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN lower(text) ELSE 'before' || chr(10) || 'A. ' || replace(text, '. ', chr(10) || (item_id % 9 + 1) || '. ') END AS text FROM benchmark),
l AS (SELECT id, text, pos, trim(line) AS line FROM (SELECT id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM o) WHERE trim(line) <> ''),
h AS (SELECT *, regexp_matches(line, '^[（(]?[一二三四五六七八九十\\d]+[）).、]|^第.*[节章条]|^[A-Z][.!]') AS head FROM l),
g AS (SELECT *, CAST(sum(head::INT) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS ord FROM h)"""


@query(_L.replace("\\\\d", "\\d") + """ SELECT id, ord, max(CASE WHEN head THEN line END) AS title, coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos), '') AS detail FROM g WHERE ord > 0 GROUP BY id, ord
UNION ALL SELECT id, 1, '分析任务', trim(text) FROM o WHERE id NOT IN (SELECT id FROM g WHERE ord > 0)""")
def framework_sections(spark, sf_dir):
    return outline.flat_sections(_outlines(spark, sf_dir))


@query(_L.replace("\\\\d", "\\d") + r""", n AS (SELECT id, pos, regexp_extract(line, '^(\d+(?:\.\d+)*)[.、\s]\s*(.*)', 1) AS number, trim(regexp_extract(line, '^(\d+(?:\.\d+)*)[.、\s]\s*(.*)', 2)) AS title FROM l)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS ord, number, title, 1 AS depth FROM n WHERE number <> ''""")
def framework_tree(spark, sf_dir):
    return outline.tree_sections(_outlines(spark, sf_dir)).select("id", "ord", "number", "title", "depth")


# ---- index, outlines to documents, chunking, pages

@query(f"{_c()} SELECT rowid, 1.0::DOUBLE AS score FROM (SELECT * FROM c WHERE {_match_sql(WORDS)} OR contains({PADDED_SQL.format('text')}, ' of the ') ORDER BY rowid LIMIT 250)")
def postings_search(spark, sf_dir):
    c = chunks(spark, sf_dir, with_vector=False)
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings.write(postings.build(c), path)
    return postings.keyword_search(c, spark.read.parquet(path), WORDS + " of-the", 50).select("rowid", "score")


@query(f"""{_c()}, t AS (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS token, rowid FROM c) SELECT token, count(*) AS n, count(DISTINCT rowid) AS chunks FROM t GROUP BY token""")
def token_statistics(spark, sf_dir):
    return postings.build(chunks(spark, sf_dir, with_vector=False)).filter("part = 'text'").groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("rowid").alias("chunks"))


@query()
def ann_search(spark, sf_dir):
    """The 20 nearest of one vector, by codes and exact scores of the best."""
    v = chunks(spark, sf_dir).select("rowid", "vector")
    model = ann.fit_quantiser(v)
    path = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    ann.write_codes(v, model, path)
    return ann.nearest(spark, path, model, [(QUERY_ID, _query_vector(spark, sf_dir))], 20).select("rowid", "score")


@query("""SELECT item_id AS id, '# 审核/核实材料' || chr(10) || chr(10) || string_agg(chr(10) || repeat('#', least(d + 1, 6)) || ' ' || item_id || '.' || d || ' T' || d || chr(10) || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY d) AS document
FROM benchmark, range(1, 8) r(d) GROUP BY item_id""")
def assembled_documents(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return outline.assemble(b.select(F.col("item_id").alias("id"), F.col("d").alias("ord"), F.concat(F.col("item_id").cast("string"), F.lit("."), F.col("d").cast("string")).alias("number"), F.concat(F.lit("T"), F.col("d").cast("string")).alias("title"), F.col("d").alias("depth"), F.col("text").alias("content")))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


_PAGES = f"""WITH p AS (SELECT doc_id, substr(text, 1, 200) AS start, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS pages FROM documents),
s AS (SELECT doc_id, n, CAST(len(list_intersect({_GRAMS.format('start')}, {_GRAMS.format('page')})) AS DOUBLE) / len({_GRAMS.format('start')}) AS share FROM p WHERE pages > 1 AND length(start) > 2),
b AS (SELECT doc_id, arg_min(n, (-share, n)) AS page, max(share) AS share FROM s GROUP BY doc_id)"""


@query(f"""{_PAGES}
SELECT doc_id, CAST(CASE WHEN share > 0.3 THEN page END AS INTEGER) AS page, round(share, 4) AS share FROM b""")
def page_attribution(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("start"), F.split("text", "\n").alias("p")).filter((F.size("p") > 1) & (F.length("start") > 2))
    pieces = pages.select("doc_id", tx.trigrams(F.col("start")).alias("pieces"), "p")  # once a document, not once a page
    each = pieces.select("doc_id", "pieces", F.posexplode("p").alias("n", "page")).select("doc_id", "n", tx.share_held(F.col("pieces"), F.col("page")).alias("share"))
    best = each.groupBy("doc_id").agg(F.min_by(F.struct("n", "share"), F.struct(-F.col("share"), F.col("n"))).alias("b"))
    return best.select("doc_id", F.when(F.col("b.share") > 0.3, F.col("b.n") + 1).alias("page"), F.round("b.share", 4).alias("share"))


@query(f"""{_PAGES} SELECT doc_id, CAST(CASE WHEN share > 0.3 THEN page END AS INTEGER) AS page FROM b""")
def chunk_pages(spark, sf_dir):
    """The chunker's own page of a text among the lines of it."""
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([page_of(t, t.split("\n")) for t in texts], dtype="Int32")

    d = table(spark, sf_dir, "documents").filter((F.size(F.split("text", "\n")) > 1) & (F.length("text") > 2))
    return d.select("doc_id", F.pandas_udf(each, "int")("text").alias("page"))


@query()
def chunk_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/kb/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.lit("text").alias("file_type"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"),
        F.split("text", "\n").alias("pages"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    return chunk_documents(d, lossless=True).drop("page")


@query(r"""WITH t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(?:/?(?:p|div|h\d|li|tr|article|nav|section)\b[^>]*|br\s*/?)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM t),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&nbsp;?', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS h FROM b),
l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM e)
SELECT page_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM l""")
def html_text(spark, sf_dir):
    return page_text(table(spark, sf_dir, "pages")).select("page_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


# ---- session log and prompts

@query("""WITH e AS (SELECT event_id AS seq, user_id AS session_id, CASE event_id % 9 WHEN 0 THEN 'create' WHEN 1 THEN 'topic' WHEN 2 THEN 'switch' WHEN 3 THEN 'close' WHEN 4 THEN CASE WHEN event_id % 97 = 0 THEN 'delete' ELSE 'topic' END ELSE 'topic' END AS kind, event_type AS value FROM events)
SELECT session_id AS id, arg_max(value, seq) FILTER (kind IN ('create', 'topic')) AS topic, CAST(arg_max(CASE WHEN kind IN ('create', 'switch') THEN 1 ELSE 0 END, seq) FILTER (kind IN ('create', 'switch', 'close')) AS INTEGER) AS is_active, max(seq) AS updated_at
FROM e GROUP BY session_id HAVING bool_or(kind = 'create') AND NOT bool_or(kind = 'delete')""")
def session_view(spark, sf_dir):
    i = F.col("event_id") % 9
    kind = F.when(i == 0, "create").when(i == 2, "switch").when(i == 3, "close").when((i == 4) & (F.col("event_id") % 97 == 0), "delete").otherwise("topic")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"), kind.alias("kind"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))
    none = spark.createDataFrame([], "session_id long, created_at long")
    return sessions.current_sessions(e, none).select("id", "topic", "is_active", "updated_at")


@query("""SELECT conv_id AS session_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) + 12 + 8 AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 AND role IN ('user', 'assistant') GROUP BY conv_id""".replace("count(*) AS", "count(*) + 2 AS"))
def prompts(spark, sf_dir):
    t = _turns(spark, sf_dir)
    names = spark.createDataFrame([], "session_id long, names map<int,string>")
    m = rag.prompt_messages(rag.recent_history(t, 3), names, "instructions", "question")
    return m.select("session_id", F.size("messages").cast("long").alias("messages"), F.aggregate("messages", F.lit(0).cast("long"), lambda s, x: s + F.length(x["content"])).alias("chars"))


@query("""SELECT DISTINCT ON (source) source AS file_path, lang AS file, doc_id AS pos FROM documents ORDER BY source, doc_id""")
def source_union(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.lit(0).alias("batch"), F.col("doc_id").alias("pos"), F.col("source").alias("file_path"), F.col("lang").alias("file"))
    return analysis.union_sources(s).select("file_path", "file", "pos")


# ---- extension: event-time windows, batch form of the streaming query

@query("""SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return windows_of(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 3))
