"""Benchmark decontamination: SimHash windows, multi-index blocks, exact check (native).

A window is as long as a benchmark item, in words.  Only windows that share a
shingle with some item of their size can be similar to one, so windows are
made where a shingle of the text equals one of an item, aligned with it; this
loses no window that reaches the threshold and aligns with a shared shingle.
Each window and item gets a SimHash of 60 bits.  Fingerprints are indexed by
5 blocks of 12 bits: two within Hamming distance 14 differ by at most 2 in some block, so
each item is entered under all values within 2 of each of its blocks and a window looks
up its own five values; pairs that this hands over are kept if all their 60 bits are within
14.  So every pair within the radius is found, and at similarity 0.8 (9 bits apart on
average) two in 100,000 are further apart.  Every pair kept is checked exactly: sum
of smaller over sum of larger shingle counts.

Words are runs without white space and ASCII punctuation, lower-cased.
Shingles take ``width`` words, or the whole item if it has fewer.

Defined cases: null and empty texts, and items without words, match nothing; a
window is clipped at the ends of its text; ``found`` reports by doc_id, so rows with one doc_id, null
included, count as one document there, but ``clean`` decides each row by its own text; equally similar windows of a document give
the first; repeated items are reported once each by item_id; empty tables give
an empty result; other columns are ignored (``found``) or kept (``clean``).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import cut, packed, small, table, text_key

WIDTH = 5
THRESHOLD = 0.8
BITS = 60
BLOCK_BITS = 12
RADIUS = 14


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"), "")


def _hashes(widths: list[int]) -> Column:
    """For each width in turn, a hash for each place of ``words``; the last ``width - 1`` of each equal no item's."""
    of = lambda width: F.transform("words", lambda w, i: F.xxhash64(F.lit(width), w, *[F.get(F.col("words"), i + k) for k in range(1, width)]))
    return F.concat(*[of(w) for w in widths])


def _shingles(width: Column) -> Column:
    """Shingles of ``words`` as strings, repeats included."""
    n = F.size("words") - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice("words", i + 1, width), " "))).otherwise(F.array().cast("array<string>"))


def _fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """``print``, the SimHash by key of rows (key, shingle, n): each shingle votes ``n`` times on each bit."""
    hashed = shingles.withColumn("_h", F.conv(F.substring(F.md5(F.col("shingle").cast("binary")), 1, BITS // 4), 16, 10).cast("long"))
    votes = [F.sum(F.when(F.col("_h").bitwiseAND(F.lit(1 << b)) != 0, F.col("n")).otherwise(-F.col("n"))).alias(f"_b{b}") for b in range(BITS)]
    bits = [F.when(F.col(f"_b{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return hashed.groupBy(*keys).agg(*votes).select(*keys, sum(bits[1:], bits[0]).alias("print"))


def _blocks(flips: list[int]) -> Column:
    """(block, value) of ``print`` for each block and each pattern of flipped bits."""
    flipped = F.array(*[F.lit(x).cast("long") for x in flips])

    def of(block: int) -> Column:
        value = F.shiftright("print", block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
        return F.transform(flipped, lambda x: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(x).alias("value")))

    return F.flatten(F.array(*[of(k) for k in range(BITS // BLOCK_BITS)]))


def near_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """window, item: all pairs of one size whose fingerprints are within ``RADIUS``, from (window | item, size, print)."""
    reach = RADIUS // (BITS // BLOCK_BITS)
    flips = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(BLOCK_BITS), n)]
    entered = items.select("item", "size", F.col("print").alias("item_print"), F.inline(_blocks(flips)))
    asked = windows.select("window", "size", "print", F.inline(_blocks([0])))
    return (
        asked.join(entered, ["size", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("window", "item").distinct()
    )


def _counts(rows: DataFrame, keys: list[str], width: Column) -> DataFrame:
    return rows.select(*keys, F.explode(_shingles(width)).alias("shingle")).groupBy(*keys, "shingle").agg(F.count("*").alias("n"))


def found(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, start, similarity: each item found in a document, at its most similar window."""
    item_width = F.least(F.lit(width), F.col("size"))
    items = cut(bench.select("item_id", words(F.col("text")).alias("words")).withColumn("size", F.size("words")).filter("size > 0").distinct()
                .withColumn("item", F.monotonically_increasing_id()))
    widths = sorted(r[0] for r in items.select(item_width).distinct().collect())  # at most ``width`` numbers
    if not widths:
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("item_id", "long"), ("start", "long"), ("similarity", "double"))]
        return docs.select("doc_id", *none).filter(F.lit(False))
    anchors = None
    for w in widths:
        own = items.filter(item_width == w).select("size", F.posexplode(_hashes([w])).alias("at", "hash")).filter(F.col("at") <= F.col("size") - w).distinct()
        anchors = own if anchors is None else anchors.unionByName(own)
    begin, n = F.col("place") % F.col("n") - F.col("at"), F.col("n")
    # one pass over the texts for all widths; the hash tells the width
    windows = cut(
        docs.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", "words", F.size("words").alias("n"), F.posexplode(_hashes(widths)).alias("place", "hash"))
        .join(small(anchors), "hash")
        .withColumn("start", F.greatest(F.lit(0), begin).cast("int")).withColumn("end", F.least(n, begin + F.col("size")).cast("int"))
        .select("doc_id", "size", "start", F.slice("words", F.col("start") + 1, F.col("end") - F.col("start")).alias("words"))
        .distinct().withColumn("window", F.monotonically_increasing_id())
    )
    window_counts = cut(_counts(windows, ["window", "size"], item_width))
    item_counts = cut(_counts(items, ["item", "size"], item_width))
    pairs = near_pairs(_fingerprints(window_counts, ["window", "size"]), _fingerprints(item_counts, ["item", "size"]))
    all_w = window_counts.groupBy("window").agg(F.sum("n").alias("of_window"))
    all_i = item_counts.groupBy("item").agg(F.sum("n").alias("of_item"))
    shared = (
        pairs.join(window_counts.select("window", "shingle", F.col("n").alias("nw")), "window")
        .join(item_counts.select("item", "shingle", F.col("n").alias("ni")), ["item", "shingle"])
        .groupBy("window", "item").agg(F.sum(F.least("nw", "ni")).alias("both"))
    )
    checked = (
        shared.join(all_w, "window").join(all_i, "item")
        .withColumn("similarity", F.col("both") / (F.col("of_window") + F.col("of_item") - F.col("both")))
        .filter(F.col("similarity") >= threshold)
    )
    best = F.min_by(F.struct("start", "similarity"), F.struct(-F.col("similarity"), F.col("start")))
    return (
        checked.join(windows.select("window", "doc_id", "start"), "window").join(items.select("item", "item_id"), "item")
        .groupBy("doc_id", "item_id").agg(best.alias("best"))
        .select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), "best.similarity")
    )


def clean(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in whose text no item of ``bench`` is found; each row is decided by doc_id and text."""
    rows = packed(docs, doc_id=F.struct(F.col("doc_id").alias("id"), *text_key(F.col("text"))), text=F.col("text"))
    bad = small(found(rows.select("doc_id", "text"), bench, **options).select(F.col("doc_id").alias("_bad")).distinct())
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[[:space:][:punct:]]+'), lambda x: x <> '') AS words FROM documents
), i AS (
  SELECT *, len(words) AS size, least(5, len(words)) AS width FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[[:space:][:punct:]]+'), lambda x: x <> '') AS words FROM benchmark)
  WHERE len(words) > 0
), its AS (
  SELECT item_id, size, width, pos, array_to_string(words[pos + 1:pos + width], ' ') AS shingle FROM (SELECT *, unnest(range(0, size - width + 1)) AS pos FROM i)
), widths AS (SELECT DISTINCT width FROM i), ds AS (
  SELECT doc_id, width, place, n, array_to_string(words[place + 1:place + width], ' ') AS shingle
  FROM (SELECT d.doc_id, d.words, len(d.words) AS n, w.width, unnest(range(0, len(d.words) - w.width + 1)) AS place FROM d, widths w)
), win AS (
  SELECT DISTINCT ds.doc_id, its.size, its.width, greatest(0, place - pos) AS start, least(n, place - pos + its.size) AS stop
  FROM ds JOIN its USING (width, shingle)
), wc AS (
  SELECT w.doc_id, w.size, w.start, w.stop, ds.shingle, count(*) AS n FROM win w JOIN ds ON ds.doc_id IS NOT DISTINCT FROM w.doc_id AND ds.width = w.width
  AND ds.place >= w.start AND ds.place + w.width <= w.stop GROUP BY ALL
), ic AS (SELECT item_id, size, width, shingle, count(*) AS n FROM its GROUP BY ALL),
shared AS (
  SELECT wc.doc_id, wc.size, wc.start, wc.stop, ic.item_id, sum(least(wc.n, ic.n)) AS common_n FROM wc JOIN ic USING (size, shingle) GROUP BY ALL
), sims AS (
  SELECT s.doc_id, s.item_id, s.start, CAST(common_n AS DOUBLE) / ((s.stop - s.start - width + 1) + (s.size - width + 1) - common_n) AS similarity
  FROM shared s JOIN i USING (item_id)
)
SELECT doc_id, item_id, CAST(arg_min(start, (-similarity, start)) AS BIGINT) AS start, round(max(similarity), 6) AS similarity
FROM sims WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
