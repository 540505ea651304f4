"""Mixing sources to target weights by weighted fair queueing (native).

Every document gets a place in its source's shuffled order and a virtual
finish time, the source's words up to and including it over the source's
target.  Entries of all sources and repeats are sorted by finish time over the
whole corpus and cut where the budget is used up; since each source reaches
finish time 1 when its target is met, the cut meets every target to within a
few documents: no entry that ends by finish time 1 is cut, so a source takes its target less at
most the next entry in its queue, and more than its target by at most what the others
fall short.  Targets are computed from one row a source in one task; sources are few.

Defined cases: a null text has size 0; a null source is a source of its own,
sorted last; rows of one (source, doc_id, size) are decided alike, so repeated
rows are taken equally often; a source without words has target 0 and takes
nothing; empty input gives an empty result; columns of the input other than
doc_id, text and source are ignored (``taken``) or kept (``mixed_documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.llm.common import cut, packed, running_total, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix"
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of ``[^\\x20\\x09-\\x0D]``; null counts as empty.

    Each run and the spaces before it become one letter, so no array of words
    is built; only spaces at the end remain and are trimmed.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.rtrim(marks, F.lit(SPACES))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target, budget: one row a source.

    Sources in order of code points, null last, take ``weights`` in turn and
    share the whole budget (all words) by weight.  A target stops at
    ``max_repeats`` times its source; the excess is shared by weight among the
    others until none is above: with sources sorted by limit over weight, the
    first whose limit exceeds its share of what the earlier ones leave fixes
    the common level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = F.array(*[F.lit(w) for w in weights])
    src = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    src = (
        src.withColumn("rn", F.row_number().over(by_ratio))
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("given", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("given")) / F.col("open"))
    )
    first_open = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("rn", "level"))).over(everything)
    share = F.coalesce(first_open["level"], F.lit(0.0)) * F.col("weight")
    return src.select("source", "source_size", F.least(F.col("limit").cast("double"), share).alias("target"), "budget")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key: what the mix needs of a document.

    ``key`` shuffles: 60 bits of a digest of seed and doc_id.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Entries of the mix: row, doc_id, source, size, source_size, target, repeat, finish, place, kept.

    One row for each document and repeat offered.  ``place`` is the words of
    the whole queue up to the entry; ``kept`` says whether it is within the
    budget.  ``row`` tells apart the rows of the input.
    """
    base = cut(sized(docs, seed).withColumn("row", F.monotonically_increasing_id()))
    goal = targets(base, weights, max_repeats)
    turns = running_total(base, ["source"], ["key", "doc_id", "size"], "size", "before")
    offered = turns.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    repeats = F.least(F.lit(max_repeats), F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)) + 1)
    entries = (
        offered.withColumn("repeat", F.explode(F.sequence(F.lit(0), (repeats - 1).cast("int"))))
        .withColumn("finish", F.try_divide((F.col("repeat") * F.col("source_size") + F.col("before")).cast("double"), F.col("target")))
        .withColumn("late", F.col("finish").isNull())
    )
    placed = running_total(entries, [], ["late", "finish", "source", "key", "doc_id", "size", "repeat"], "size", "place")
    return placed.withColumn("kept", ~F.col("late") & (F.col("place") <= F.col("budget")))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken: one row for each row of ``docs``."""
    one = F.when(F.col("kept"), 1).otherwise(0)
    return (
        mix(docs, **options)
        .groupBy("row", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum(one).alias("repeats"))
        .withColumn("taken", F.col("repeats") * F.col("size"))
        .drop("row")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: none, once or repeatedly."""
    keep = taken(docs, **options).filter("repeats > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("repeats").alias("_n")).distinct()
    left = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), words=word_count(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("words") == F.col("_size"))
    return left.join(keep, on).select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key,
         row_number() OVER () AS rid
  FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM base GROUP BY source
), ratios AS (
  SELECT *, 3 * source_size AS lim, (3 * source_size) / weight AS ratio FROM named
), levels AS (
  SELECT *, row_number() OVER o AS rn, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
         (CAST(sum(source_size) OVER () AS BIGINT)
          - CAST(coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
         / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM ratios WINDOW o AS (ORDER BY ratio, source NULLS LAST)
), goal AS (
  SELECT source, source_size, budget,
         least(CAST(lim AS DOUBLE), coalesce((SELECT arg_min(level, rn) FROM levels WHERE ratio > level), 0.0) * weight) AS target
  FROM levels
), turns AS (
  SELECT b.*, g.source_size, g.budget, g.target,
         CAST(sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size) AS BIGINT) AS before
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source
), entries AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(rep * source_size + before AS DOUBLE) / target END AS finish
  FROM (SELECT *, unnest(range(0, least(3, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END + 1))) AS rep FROM turns)
), placed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY finish IS NULL, finish, source NULLS FIRST, key, doc_id, size, rep) AS BIGINT) AS place FROM entries
)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN finish IS NOT NULL AND place <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM placed GROUP BY rid, doc_id, size, source_size, target
"""
