"""Inverted index of chunks, for keyword search without reading texts.

Postings are (token, rowid, part, pos), dealt out and sorted by token when
written, so that a query reads the row groups of its tokens only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import python_tokens
from corpusq.operators import fulltext
from corpusq.operators.fulltext import postings as build
from corpusq.operators.search import query_phrases, typed_tree

__all__ = ["build", "keyword_search", "matching_rows", "write"]


def write(postings: DataFrame, path: str) -> None:
    postings.repartitionByRange("token", "rowid").sortWithinPartitions("token", "rowid").write.mode("overwrite").parquet(path)
    postings.sparkSession._jvm.System.gc()  # as in ``session.cut``: the shuffle of all postings is not needed any more


def matching_rows(postings: DataFrame, query: str) -> DataFrame:
    """rowid of the chunks that hold any phrase of the query; a phrase is tokens in a row in one part.  Queries with quotes: ``search.typed_tree``."""
    typed, tree = typed_tree(query)
    if typed:
        return fulltext.rows(postings, tree)
    phrases = [w for w in (python_tokens(p) for p in dict.fromkeys(query_phrases(query))) if w]
    if not phrases:
        return postings.select("rowid").limit(0)
    found = []
    single = [w[0] for w in phrases if len(w) == 1]
    if single:
        found.append(postings.filter(F.col("token").isin(*single)).select("rowid"))
    for words in (w for w in phrases if len(w) > 1):
        starts = [postings.filter(F.col("token") == w).select("rowid", "part", (F.col("pos") - i).alias("at")).distinct() for i, w in enumerate(words)]
        found.append(reduce(lambda a, b: a.join(b, ["rowid", "part", "at"]), starts).select("rowid"))
    return reduce(DataFrame.unionByName, found).distinct()


def keyword_search(chunks: DataFrame, postings: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """As ``search.keyword_search``: rows found in the index, texts fetched for those shown."""
    rows = matching_rows(postings, query).orderBy("rowid").limit(max(5 * top_k, 200))
    return chunks.join(F.broadcast(rows), "rowid", "left_semi").withColumn("score", F.lit(1.0)).withColumn("match_type", F.lit("keyword"))  # at most the limit's rows
