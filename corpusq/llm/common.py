"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.session import cut, shared_dir

__all__ = ["BROADCAST_ROWS", "cut", "free_name", "give_back", "hot_keys", "packed", "running_total", "shared_dir", "small", "spread_join", "table", "text_batches", "text_key"]

_LIBC = ctypes.CDLL(None)

#: Rows of a few numbers each that are broadcast at most, about 40 MB; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A key with more rows is dealt out in parts of about ``PART``.
HOT = 250
PART = 100
#: Keys that are dealt out in parts, at most; with more, only the heaviest are.
HOT_KEYS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of this session hold ``rows`` rows at most, since whole texts are in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def text_key(text: Column) -> list[Column]:
    """_t1, _t2: 128 bits that stand for a text, to tell apart rows of one doc_id."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("text"), text).alias("_t2")]


def give_back() -> None:
    """Return to the system what this Python worker has freed.

    Large arrays of one batch otherwise stay with the process, which waits beside
    the JVM for its next task.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def small(rows: DataFrame) -> DataFrame:
    """``rows``, computed once, and marked for broadcast if they are ``BROADCAST_ROWS`` at most."""
    done = cut(rows)
    return F.broadcast(done) if done.count() <= BROADCAST_ROWS else done


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``_row``, the whole row of ``docs``, and ``columns``: no column of the input can clash with one of an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` for a column added to ``docs``; if the input has it already, with ``_`` after it until it is free."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(counts: DataFrame, key: list[str]) -> DataFrame | None:
    """``key`` and ``_parts``: into how many parts of ``PART`` rows each key of over ``HOT`` rows is cut; None if there is none.

    ``counts`` has the key and its number of rows ``n``.  ``HOT_KEYS`` rows at most, so
    the result is marked for broadcast.
    """
    hot = cut(counts.select(*key, "n").filter(F.col("n") > HOT))
    n, total = hot.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return None
    if n > HOT_KEYS:
        hot = hot.filter(F.col("n") > total / HOT_KEYS)
    return F.broadcast(hot.select(*key, F.ceil(F.col("n") / PART).cast("int").alias("_parts")))


def spread_join(rows: DataFrame, facts: DataFrame, key: list[str], by: list[str], hot: DataFrame | None | bool = True, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with ``facts``, which has one row a key, where a key may hold any share of ``rows``.

    The rows of a hot key are dealt out into parts by a hash of ``by``, and its fact is
    copied to each part, so no task gets all of them.  ``key`` columns are not null.
    Rows with values of their own in ``by`` spread evenly.
    ``hot`` is ``hot_keys`` of the rows, if known.
    """
    hot = hot_keys(rows.groupBy(*key).agg(F.count("*").alias("n")), key) if hot is True else hot
    if hot is None:
        return rows.join(facts, key, how)
    part = F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")
    left = rows.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    right = facts.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*key, "_part"], how).drop("_part")


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over rows of the group up to this one.

    Rows that tie on ``order`` share one total.  A group may hold any share
    of the rows: rows are dealt out by ranges of (group, order), each range is
    summed, ranges before this one give the offset, and the window runs inside
    one range only.  So no task needs a whole group.  ``order`` names
    columns; ascending, nulls first.
    """
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
    )
    on = ranged["_range"] == offsets["_r"]
    for i, g in enumerate(group):
        on = on & ranged[g].eqNullSafe(offsets[f"_g{i}"])
    within = Window.partitionBy("_range", *group).orderBy(*order)
    return (
        ranged.join(offsets, on)
        .withColumn(name, F.col("_offset") + F.sum(value).over(within))
        .drop("_range", "_r", "_offset", *[f"_g{i}" for i in range(len(group))])
    )
