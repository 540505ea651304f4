"""Keyword, vector and hybrid search over a table of chunks.

A chunk table has rowid, chunk_id, text, source_file, file_type, chunk_index,
total_chunks and vector.  Ties go by rowid throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import fold, padded, python_tokens
from corpusq.functions.vectors import dot
from corpusq.operators import fulltext

HIT_COLUMNS = ("rowid", "chunk_id", "text", "source_file", "file_type", "chunk_index", "total_chunks")


def query_phrases(query: str) -> list[str]:
    """Phrases of a query, any of which may match; each is tokens between spaces.

    CJK runs give their pairs of characters (a run of one gives nothing), the
    rest its words.  Without any, or with a quote inside a word, the query is taken as typed; see ``typed_tree``.
    """
    out = []
    for run in re.findall(r"[一-鿿]+|[^一-鿿]+", query):
        out += [run[i: i + 2] for i in range(len(run) - 1)] if "一" <= run[0] <= "鿿" else run.split()
    return out


def typed_tree(query: str) -> tuple[bool, fulltext.Node]:
    """Whether a query is full-text language as typed, and its tree.

    It is where it has quotes, or no phrases of its own.  One that does not follow the
    syntax asks for all its words, each in either column.
    """
    phrases = query_phrases(query)
    if phrases and not any('"' in p for p in phrases):
        return False, None
    try:
        return True, fulltext.parse(query)
    except fulltext.QueryError:
        return True, fulltext.all_words(query)


def _padded_phrase(phrase: str) -> str | None:
    words = python_tokens(phrase)
    return f" {' '.join(words)} " if words else None


def keyword_predicate(query: str, mode: str = "compat") -> Column:
    """Whether text or path of a chunk hold any phrase of a query without quotes.

    compat: phrases are whole tokens.  cjk_bigram: a pair of CJK characters
    may also stand inside a run.  A phrase cannot span text and path.

    Both columns are tokenised once for all phrases: they are bound as fields
    of the one element of an array.
    """
    phrases = query_phrases(query)
    fields = [padded(F.col("text")).alias("t"), padded(F.col("source_file")).alias("p")]
    if mode == "cjk_bigram":
        fields += [fold(F.col("text")).alias("ft"), fold(F.col("source_file")).alias("fp")]
    bound = F.array(F.struct(*fields))

    def either(c: Column, phrase: str) -> Column:
        return F.contains(c["t"], F.lit(phrase)) | F.contains(c["p"], F.lit(phrase))

    whole = [w for w in map(_padded_phrase, dict.fromkeys(phrases)) if w]
    inside = [p for p in dict.fromkeys(phrases) if mode == "cjk_bigram" and re.fullmatch(r"[一-鿿]{2}", p)]
    if not whole:
        return F.lit(False)
    return F.exists(bound, lambda c: reduce(or_, [either(c, w) for w in whole] + [F.contains(c[x], F.lit(p)) for p in inside for x in ("ft", "fp")]))


def keyword_search(chunks: DataFrame, query: str, top_k: int = 5, fetch_k: int | None = None, mode: str = "compat") -> DataFrame:
    """Matching chunks by rowid, score 1, at most ``fetch_k`` (max(5 top_k, 200)); not cut to top_k."""
    return exhaustive_search(chunks, query, mode).orderBy("rowid").limit(fetch_k or max(5 * top_k, 200)).withColumn("score", F.lit(1.0)).withColumn("match_type", F.lit("keyword"))


def exhaustive_search(chunks: DataFrame, query: str, mode: str = "compat") -> DataFrame:
    """All matching chunks, without limit.  A query with quotes is read as ``typed_tree`` says."""
    typed, tree = typed_tree(query)
    if typed:
        found = fulltext.rows(fulltext.postings(chunks).filter(fulltext.wanted(tree)), tree)
        return chunks.select(*HIT_COLUMNS).join(found, "rowid", "left_semi")
    return chunks.select(*HIT_COLUMNS).filter(keyword_predicate(query, mode))


def fetch_size(n: int, top_k: int) -> int:
    return max(5 * top_k, min(200, n))


def vector_search(chunks: DataFrame, query_vector: list[float] | None, top_k: int = 5, n_vectors: int | None = None) -> DataFrame:
    """Nearest chunks by cosine of unit vectors, best first; max(5 top_k, min(200, n)) rows.

    The bound needs a count only where 5 top_k is below 200.
    """
    with_vector = chunks.filter(F.col("vector").isNotNull())
    if query_vector is None:
        return with_vector.select(*HIT_COLUMNS, F.lit(0.0).alias("score"), F.lit("vector").alias("match_type")).limit(0)
    if 5 * top_k < 200 and n_vectors is None:
        n_vectors = with_vector.count()
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return (
        with_vector.select(*HIT_COLUMNS, dot(F.col("vector"), q).alias("score"))
        .orderBy(F.desc("score"), "rowid").limit(fetch_size(n_vectors or 200, top_k)).withColumn("match_type", F.lit("vector"))
    )


def vector_search_many(chunks: DataFrame, queries: list[tuple[str, list[float]]], top_k: int = 5, n_vectors: int | None = None) -> DataFrame:
    """``vector_search`` for many (point, vector) in one pass over the chunks; adds ``point`` and ``rank``."""
    with_vector = chunks.filter(F.col("vector").isNotNull())
    if not queries:
        return with_vector.select(F.lit("").alias("point"), *HIT_COLUMNS, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    if 5 * top_k < 200 and n_vectors is None:
        n_vectors = with_vector.count()
    near = [F.struct(F.lit(p).alias("point"), dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in v])).alias("score")) for p, v in queries]
    by_score = Window.partitionBy("point").orderBy(F.desc("score"), "rowid")  # a rank limit, applied before the shuffle too
    ranked = with_vector.select(*HIT_COLUMNS, F.inline(F.array(*near))).withColumn("rank", F.row_number().over(by_score))
    return ranked.filter(F.col("rank") <= fetch_size(n_vectors or 200, top_k)).select("point", *HIT_COLUMNS, "score", "rank")


def vector_search_arrow(chunks: DataFrame, query_vector: list[float], fetch_k: int) -> DataFrame:
    """The same by one matrix product an Arrow batch, each batch keeping its best ``fetch_k``."""
    import numpy as np

    q = np.asarray(query_vector, np.float64)

    def best(batches):
        for pdf in batches:
            if len(pdf):
                s = np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ q
                order = np.lexsort((pdf["rowid"].to_numpy(), -s))[:fetch_k]
                yield pd.DataFrame({"rowid": pdf["rowid"].to_numpy()[order], "score": s[order]})

    scores = chunks.filter(F.col("vector").isNotNull()).select("rowid", "vector").mapInPandas(best, "rowid long, score double")
    return scores.orderBy(F.desc("score"), "rowid").limit(fetch_k)


def merge_hits(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer join of hits: 2 for a keyword hit plus the cosine of a vector hit.

    Adds ``only_vector`` and ``tie``, which order equal scores: keyword hits by
    rowid, then vector hits by their rank.
    """
    rank = Window.orderBy(F.desc("score"), "rowid")  # over the few hits fetched
    v = vector.withColumn("tie", F.row_number().over(rank).cast("long")).select(*[F.col(c).alias(f"v_{c}") for c in HIT_COLUMNS], F.col("score").alias("v_score"), F.col("tie").alias("v_tie"))
    k = keyword.select(*HIT_COLUMNS)
    joined = k.join(v, F.col("rowid") == F.col("v_rowid"), "full_outer")
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"v_{c}")).alias(c) for c in HIT_COLUMNS],
        (F.when(F.col("rowid").isNotNull(), 2.0).otherwise(0.0) + F.coalesce("v_score", F.lit(0.0))).alias("score"),
        F.when(F.col("v_rowid").isNotNull(), "vector").otherwise("keyword").alias("match_type"),
        F.col("rowid").isNull().alias("only_vector"), F.coalesce("rowid", "v_tie").alias("tie"),
    )


def diverse_top(merged: DataFrame, top_k: int) -> DataFrame:
    """Best hit of every file first, by score, then the rest; cut to top_k, with ``rank``."""
    by_score = (F.desc("score"), "only_vector", "tie")
    in_file = Window.partitionBy("source_file").orderBy(*by_score)
    tier = F.when((F.col("source_file") != "") & (F.row_number().over(in_file) == 1), 0).otherwise(1)
    top = merged.withColumn("tier", tier).orderBy("tier", *by_score).limit(top_k)
    final = Window.orderBy("tier", *by_score)  # over top_k rows
    return top.withColumn("rank", F.row_number().over(final)).select(*HIT_COLUMNS, "score", "match_type", "rank")


def hybrid_search(chunks: DataFrame, query: str, query_vector: list[float] | None, top_k: int = 5, n_vectors: int | None = None, mode: str = "compat") -> DataFrame:
    """Keyword and vector hits merged, one hit of each file first.

    Without a query vector the keyword hits stand in for it: score 3.
    """
    keyword = keyword_search(chunks, query, top_k, mode=mode)
    if query_vector is None:
        merged = keyword.select(*HIT_COLUMNS, F.lit(3.0).alias("score"), F.lit("keyword").alias("match_type"), F.lit(False).alias("only_vector"), F.col("rowid").alias("tie"))
    else:
        merged = merge_hits(keyword, vector_search(chunks, query_vector, top_k, n_vectors))
    return diverse_top(merged, top_k)


def hybrid_search_many(chunks: DataFrame, queries: list[tuple[str, str, list[float] | None]], top_k: int, n_vectors: int) -> DataFrame:
    """``hybrid_search`` for many (point, query, vector) in one pass over the chunks; adds ``point``.

    A chunk is tokenised once for all queries; each query keeps its best hits by
    a rank limit, which Spark applies before the shuffle.
    """
    fetch_k, fetch_v = max(5 * top_k, 200), fetch_size(n_vectors, top_k)
    base = chunks.select(*HIT_COLUMNS, "vector", padded(F.col("text")).alias("_text"), padded(F.col("source_file")).alias("_path"))

    def matches(query: str) -> Column:
        cond = F.lit(False)
        for words in filter(None, map(python_tokens, dict.fromkeys(query_phrases(query)))):
            text = F.lit(f" {' '.join(words)} ")
            cond = cond | F.contains("_text", text) | F.contains("_path", text)
        return cond

    typed = [(p, q) for p, q, _ in queries if typed_tree(q)[0]]
    plain = [(p, q) for p, q, _ in queries if (p, q) not in typed]
    hit = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(matches(q), F.lit(p)) for p, q in plain]))
    by_row = Window.partitionBy("point").orderBy("rowid")
    hits = base.select(*HIT_COLUMNS, F.explode(hit).alias("point"))
    for p, q in typed:  # each a search of its own
        hits = hits.unionByName(exhaustive_search(chunks, q).withColumn("point", F.lit(p)))
    kw = hits.withColumn("kr", F.row_number().over(by_row)).filter(F.col("kr") <= fetch_k).drop("kr")
    near = [F.struct(F.lit(p).alias("point"), dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in v])).alias("v_score")) for p, _, v in queries if v is not None]
    if not near:
        near = [F.struct(F.lit(None).cast("string").alias("point"), F.lit(0.0).alias("v_score"))]
    by_score = Window.partitionBy("point").orderBy(F.desc("v_score"), "rowid")
    vec = base.filter("vector is not null").select(*HIT_COLUMNS, F.inline(F.array(*near))).filter("point is not null").withColumn("v_tie", F.row_number().over(by_score).cast("long")).filter(F.col("v_tie") <= fetch_v)
    v = vec.select(F.col("point").alias("v_point"), *[F.col(c).alias(f"v_{c}") for c in HIT_COLUMNS], "v_score", "v_tie")
    without = [p for p, _, q in queries if q is None]
    stands_in = F.col("point").isin(*without) if without else F.lit(False)
    merged = kw.join(v, (F.col("point") == F.col("v_point")) & (F.col("rowid") == F.col("v_rowid")), "full_outer").select(
        *[F.coalesce(F.col(c), F.col(f"v_{c}")).alias(c) for c in ("point", *HIT_COLUMNS)],
        (F.when(F.col("rowid").isNotNull(), F.when(stands_in, 3.0).otherwise(2.0)).otherwise(0.0) + F.coalesce("v_score", F.lit(0.0))).alias("score"),
        F.when(F.col("v_rowid").isNotNull(), "vector").otherwise("keyword").alias("match_type"), F.col("rowid").isNull().alias("only_vector"), F.coalesce("rowid", "v_tie").alias("tie"))
    order = (F.desc("score"), "only_vector", "tie")
    in_file = Window.partitionBy("point", "source_file").orderBy(*order)
    tiered = merged.withColumn("tier", F.when((F.col("source_file") != "") & (F.row_number().over(in_file) == 1), 0).otherwise(1))
    ranked = tiered.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("tier", *order))).filter(F.col("rank") <= top_k)
    return ranked.select("point", *HIT_COLUMNS, "score", "match_type", "rank")


def search(chunks: DataFrame, query: str, mode: str = "hybrid", embed: Callable[[str], list[float] | None] | None = None, top_k: int = 100) -> DataFrame:
    """keyword or vector; any other mode is hybrid.  Scores are rounded to 4 places."""
    vector = embed(query) if embed and mode != "keyword" else None
    if mode == "keyword" or mode == "vector" and vector is None:
        hits = keyword_search(chunks, query, top_k)
    elif mode == "vector":
        hits = vector_search(chunks, vector, top_k)
    else:
        hits = hybrid_search(chunks, query, vector, top_k)
    return hits.withColumn("score", F.round("score", 4))
