"""Audit of how quality filters interact, over every order in which they can be applied.

Each document is reduced to the set of filters that it fails, a mask of five bits, and the
masks to one histogram a part of the corpus: how many documents have each of the 32 masks, and
how many of those are labelled good or toxic.  Whatever happens to a document under an order of the filters
depends on its mask alone, so the outcomes of all 120 orders and 5 steps are
products of the histograms, stacked as rows, with integer matrices of 32 rows and 600
columns (``MATRICES``).  Rows of documents are counted once, not once an order.

Defined cases: a null text is empty; a null lang is the part with the empty name;
rows with one doc_id are separate documents and share its labels; a doc_id without labels, or with null
ones, is neither good nor toxic, and one whose labels repeat is good (toxic) if any says so; a
row without doc_id has no labels, is not smaller than any other, and is no copy of any;
rows of one doc_id and text are no copies of each other; an empty table has no parts and gives no rows; other columns are ignored.

Scale: a text leaves its task as a mask and two hashes.  The smallest doc_id of each text and the labels
are joined with hot texts and ids dealt out in parts; the histogram has at most 32 rows a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import cut, hot_keys, spread_join, table, text_key

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: The stacked rows of a part.
ROWS = ("documents", "good", "toxic")
SPACES = " \t\n\x0b\f\r"


def failures(text: Column) -> dict[str, Column]:
    """Which of the filters on a text alone it fails; ``text`` is not null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, r"[\x20\x09-\x0D]++")
    n, distinct = F.when(trimmed == "", 0).otherwise(F.size(words)), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: one row a document; bit i of the mask is set if it fails the i-th filter."""
    text = F.coalesce("text", F.lit(""))
    failed = failures(text)
    bits = sum((F.when(failed[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS[:-1])), F.lit(0))
    facts = cut(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), bits.alias("mask"), *text_key(text), F.monotonically_increasing_id().alias("row")))
    texts = facts.groupBy("_t1", "_t2").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"))
    texts = cut(texts.filter("n > 1"))  # what is alone has no copy
    copies = spread_join(facts, texts.drop("n"), ["_t1", "_t2"], ["row"], hot_keys(texts, ["_t1", "_t2"]), "left")
    return copies.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("smallest"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, documents, good, toxic."""
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # equal rows are counted before they meet the labels, so an id that repeats is no hot key
    rows = masks(docs).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    n = lambda name: F.sum(F.when(F.col(name) == 1, F.col("n")).otherwise(0)).alias(name)
    return rows.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("documents"), n("good"), n("toxic"))


def matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant, unique and shapley: what a document with each mask counts at each order and step."""
    out = {k: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for k in ("kept", "removed", "redundant", "unique")}
    mask = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        gone = np.zeros(MASKS, bool)
        for s, name in enumerate(order):
            at, bit = o * len(FILTERS) + s, 1 << FILTERS.index(name)
            fails = mask & bit > 0
            out["removed"][:, at] = fails & ~gone
            out["redundant"][:, at] = fails & gone
            out["unique"][:, at] = mask == bit
            gone |= fails
            out["kept"][:, at] = ~gone
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    whole = np.stack([out["removed"][:, letters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    out["shapley"] = whole[:, letters]
    return out


MATRICES = matrices()
_SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stacked histograms, 3 rows a part, times the matrices; 600 rows a part come out."""
    columns = len(ORDERS) * len(FILTERS)
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            some = batch.slice(i, 64)
            all_, good, toxic = (some.column(name).flatten().to_numpy().reshape(-1, MASKS) for name in ROWS)
            made = {
                "kept": all_ @ MATRICES["kept"], "removed": all_ @ MATRICES["removed"], "redundant": all_ @ MATRICES["redundant"], "unique_fails": all_ @ MATRICES["unique"],
                "good_lost": good @ MATRICES["removed"], "toxic_lost": toxic @ MATRICES["removed"], "shapley": all_ @ MATRICES["shapley"],
            }
            parts = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), columns)))
            orders = pa.array(np.tile(np.repeat(ORDERS, len(FILTERS)), some.num_rows), pa.string())
            steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), some.num_rows * len(ORDERS)))
            yield pa.RecordBatch.from_arrays([parts, orders, steps, *[pa.array(made[c].ravel()) for c in COUNTS]], schema=_SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and ``COUNTS``: one row for each part, order and step."""
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*ROWS))))  # 32 entries a part at most
    stacked = histograms(docs, labels).groupBy("part").agg(cells.alias("cells"))
    cell = lambda name: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.try_element_at("cells", m)[name], F.lit(0).cast("long"))).alias(name)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return stacked.select("part", *[cell(name) for name in ROWS]).mapInArrow(_products, f"part string, filter_order string, step int, {counts}")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), failed AS (
  SELECT d.doc_id, part,
         CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM docs d
), told AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id
), hist AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN told USING (doc_id) GROUP BY part, mask
), letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f
    AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f
), steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, l.bit,
         (SELECT sum(x.bit) FROM letters x WHERE strpos(filter_order, x.f) < s) AS earlier
  FROM orders, range(1, 6) r(s), letters l WHERE l.f = filter_order[s]
), counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT filter_order, step, CAST(bit AS INT) AS bit, CAST(earlier AS INT) AS earlier FROM steps), (SELECT part, CAST(mask AS INT) AS mask, n, good, toxic FROM hist)
  GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
