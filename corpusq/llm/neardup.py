"""Near-duplicate documents by DartMinHash signatures and exact verification.

Documents are multisets of shingles of five words (lower-cased, split at white
space); a shorter text is one shingle.  Two documents are linked if their
weighted Jaccard similarity, the sum of smaller over the sum of larger shingle
counts, is 0.8 or more; a class is a connected component of links.

Equal multisets are one node from the start, so copies never form pairs.
Nodes get signatures of 42 bands of 7 coordinates; two nodes of similarity 0.8
share a band but for 5 in 100,000, and nearer ones miss far less often; texts
that only share a passage, at similarity 0.2, meet in 1 of 2,000 cases.  In a
bucket (nodes with one band in common) all are checked against one centre,
the node that shares most buckets with others, which in a family of edited copies
is the original.  Nodes with too many shingles that no other candidate has are
then out, since they reach no one.  In further rounds the nodes outside a bucket's largest component
are checked against one member of it that changes with bucket and round, as
long as that joins a fifth of them and many are left.  At last all pairs of a bucket that are still in
different components are compared inside the join, by their sizes, by how many of their shingles any other has, and
by their signatures, which at similarity 0.8 agree in too few places for 1 pair in
100,000; those that pass are checked exactly.  So every pair of nodes that shares a band
is either checked or already in one class, and a large family costs a few checks for
each member, not one for each pair.

A band may be that of any share of the nodes: its rows are dealt out in
parts, and the one row that all of them meet is copied to each part.

Defined cases: texts that are null or have no words are not compared, each is a
class by itself; the class id is its smallest doc_id, null if it has none;
rows with one doc_id are separate documents; empty input gives no rows; other
columns are ignored (``classes``) or kept (``unique_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import dartminhash
from corpusq.llm.common import BROADCAST_ROWS, PART, cut, give_back, hot_keys, packed, small, spread_join, table, text_batches, text_key
from corpusq.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 42
ROWS = 7
PAIRS_EACH = 4  # pairs for each membership of a bucket that are compared without further rounds
TOGETHER = 1000
REMEMBERED = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Shingler(dict):
    """Text to the sorted hashes of its shingles, repeats included; remembers hashes of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        got = self[word] = xxhash.xxh64_intdigest(word)
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        words = (text or "").lower().split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(h))
        if not width:
            return h
        n = len(h) - width + 1
        mixed = h[:n] * _ODD[0]
        for j in range(1, width):
            mixed += dartminhash.mix64(h[j: j + n] + _ODD[j])  * _ODD[j]
        return np.sort(dartminhash.mix64(mixed + np.uint64(width)))


_SHINGLER = Shingler()  # of this Python worker; it serves one task after the other


def _key(shingles: np.ndarray) -> tuple[int, int]:
    import hashlib

    digest = hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _ragged(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        give_back()


def _all_signatures(shingles: list[np.ndarray]) -> list[np.ndarray]:
    """Signature of each of several multisets, empty for an empty one."""
    sets = [np.unique(x, return_counts=True) for x in shingles]
    sizes = np.array([len(x) for x, _ in sets])
    some = np.flatnonzero(sizes)
    sigs: list[np.ndarray] = [np.empty(0, np.uint64)] * len(sets)
    held: list[int] = []
    n_held = 0
    for i in some:
        held.append(i)
        n_held += sizes[i]
        if n_held >= dartminhash.CELLS or i == some[-1]:
            elements, weights = (np.concatenate([sets[j][x] for j in held]) for x in (0, 1))
            for j, row in zip(held, dartminhash.signatures(elements, weights.astype(np.float64), sizes[held], BANDS * ROWS)):
                sigs[j] = row
            held, n_held = [], 0
    return sigs


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        shingles = [_SHINGLER(text) for text in map(pa.StringScalar.as_py, batch.column(1))]
        keys = [_key(x) for x in shingles]
        keyed = [dartminhash.bands(x[None, :], BANDS)[0] if len(x) else x for x in _all_signatures(shingles)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _ragged(keyed), *batch.columns[2:]], ["doc_id", "k1", "k2", "bands", *batch.schema.names[2:]])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each shingle and occurrence, so that sets of them compare as the multisets do, and one byte of each coordinate of the signature."""
    for batch in _slices(batches, 200):
        shingles = [_SHINGLER(text) for text in map(pa.StringScalar.as_py, batch.column(1))]
        keys = [_key(x) for x in shingles]
        sketch = pa.array([(x & np.uint64(255)).astype(np.uint8).view(np.int8) for x in _all_signatures(shingles)], pa.list_(pa.int8()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _ragged([dartminhash.cells(x) for x in shingles]), sketch], ["doc_id", "k1", "k2", "cells", "sketch"])


def _verified(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose cells have the similarity asked for."""
    left = cells.select(F.col("node").alias("a"), F.col("cells").alias("ca"))
    right = cells.select(F.col("node").alias("b"), F.col("cells").alias("cb"))
    both = F.size(F.array_intersect("ca", "cb"))
    near = both >= threshold * (F.size("ca") + F.size("cb") - both)
    # no similarity reaches the threshold if the sizes differ by more
    fits = F.least(F.size("ca"), F.size("cb")) >= threshold * F.greatest(F.size("ca"), F.size("cb"))
    return pairs.join(left, "a").join(right, "b").filter(fits & near).select("a", "b")


def _joined(of: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with the roots of nodes that ``links`` (a, b) connect made one."""
    left, right = (of.select(F.col("node").alias(x), F.col("root").alias(y)) for x, y in (("a", "ra"), ("b", "rb")))
    joined = cut(links.join(left, "a").join(right, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if joined.isEmpty():
        return of
    new = components(joined).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    return cut(of.join(new, "root", "left").select("node", F.coalesce("joined", "root").alias("root")))


def _agreeing(threshold: float) -> int:
    """Coordinates in which two signatures of that similarity agree but for 1 pair in 100,000."""
    n = BANDS * ROWS
    return int(n * threshold - 4.27 * (n * threshold * (1 - threshold)) ** 0.5)


def _possible(open_: DataFrame, cells: DataFrame, threshold: float, hot: DataFrame | None) -> DataFrame:
    """Rows (band, node, size, common) of ``open_`` whose node can reach the threshold with any node of its bucket.

    What two nodes have in common is at most the cells of either that are in
    more than one node, so a node with too many cells of its own is
    out for good; this takes one count of cells, no pairs.
    """
    some = cells.join(open_.select("node").distinct(), "node", "left_semi")
    own = some.select("node", F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    facts = some.select("node", F.size("cells").alias("size")).join(own, "node", "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"))
    rows = open_.select("band", "node").join(facts, "node")
    least = rows.groupBy("band").agg(F.min("size").alias("least"))
    near = F.col("common") >= threshold * (F.col("size") + F.col("least") - F.col("common"))
    return spread_join(rows, least, ["band"], ["node"], hot).filter(near).select("band", "node", "size", "common")


def _apart(live: DataFrame, mixed: DataFrame, threshold: float, hot: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that can reach the threshold.

    ``live`` has band, node, root, size, common and sketch; ``mixed`` the largest
    component of each bucket.  The nodes outside it are dealt out in parts of ``TOGETHER``, and each part meets the bucket.
    """
    parts = F.ceil(F.coalesce("_parts", F.lit(1)) * PART / TOGETHER).cast("int")
    part = lambda df: df.withColumn("_parts", F.lit(1)) if hot is None else df.join(hot, "band", "left").withColumn("_parts", parts)
    minor = part(live.join(mixed, "band").filter("root <> major"))
    some = minor.select("band", F.pmod(F.xxhash64("node"), "_parts").cast("int").alias("part"), F.col("node").alias("x"), F.col("root").alias("rx"), F.col("common").alias("mx"), F.col("size").alias("cx"), F.col("sketch").alias("sx"))
    every = part(live).select("band", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.col("node").alias("y"), F.col("root").alias("ry"), F.col("common").alias("my"), F.col("size").alias("cy"), F.col("sketch").alias("sy"))
    every = every.select(F.col("band").alias("_b"), F.col("part").alias("_p"), "y", "ry", "my", "cy", "sy")
    most = F.least("mx", "my")
    can = most >= threshold * (F.col("cx") + F.col("cy") - most)
    agree = F.aggregate(F.zip_with("sx", "sy", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    on = (F.col("band") == F.col("_b")) & (F.col("part") == F.col("_p")) & (F.col("rx") != F.col("ry")) & can & (agree >= _agreeing(threshold))
    return some.join(every, on).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id: one row for each row of ``docs``."""
    return _classes(docs.select("doc_id", "text"), threshold)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, class_id and the columns (long) that ``docs`` has besides doc_id and text."""
    text_batches(docs.sparkSession)
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    sigs = cut(ids.mapInArrow(_signatures, ", ".join(["doc_id long, k1 long, k2 long, bands array<long>", *[f"{c} long" for c in carried]])))
    ids = ids.select("doc_id", "text")
    nodes = cut(
        sigs.filter(F.size("bands") > 0).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    shared = cut(keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    hot = hot_keys(shared, ["band"])
    members = cut(spread_join(keyed, shared, ["band"], ["node"], hot))
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "node").select("band", "node", "degree")
    centres = ranked.groupBy("band").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre"))
    stars = cut(spread_join(members.select("band", "node"), centres, ["band"], ["node"], hot).filter("node <> centre").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct())

    wanted = nodes.join(degree.select("node"), "node", "left_semi").select("node", F.col("doc_id").alias("d"), F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    if degree.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = ids.join(wanted.select("d").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    hashed = texts.mapInArrow(_cells, "doc_id long, k1 long, k2 long, cells array<long>, sketch array<tinyint>")
    on = hashed["doc_id"].eqNullSafe(wanted["d"]) & (hashed["k1"] == wanted["x1"]) & (hashed["k2"] == wanted["x2"])
    cells = cut(hashed.join(wanted, on).select("node", "cells", "sketch").dropDuplicates(["node"]))

    of = _joined(cut(degree.select("node", F.col("node").alias("root"))), cut(_verified(stars, cells, threshold)))
    live, left, turn = None, None, 0
    while True:
        labelled = (members.select("band", "node") if live is None else live).join(of, "node")
        sizes = labelled.groupBy("band", "root").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1").select("band", "major", "n")
        # a bucket whose nodes are in one component is done with
        open_ = cut(spread_join(labelled, mixed, ["band"], ["node"], hot))
        if live is None:
            live = cut(_possible(open_, cells, threshold, hot))
            n_members = live.count()
            continue
        live = open_.select("band", "node", "size", "common")
        minor = open_.filter("root <> major")
        before, left = left, minor.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if left <= PAIRS_EACH * n_members or before is not None and left > 0.8 * before:
            break
        turn += 1
        delegates = open_.filter("root = major").groupBy("band").agg(F.max_by("node", F.xxhash64("node", "band", F.lit(turn))).alias("other"))
        tries = spread_join(minor.select("band", "node"), delegates, ["band"], ["node"], hot).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        of = _joined(of, cut(_verified(cut(tries), cells, threshold)))
    if left:
        live = cut(_possible(live, cells, threshold, hot).join(of, "node").join(cells.select("node", "sketch"), "node"))
        rest = cut(_apart(live, mixed.select("band", "major"), threshold, hot))
        of = _joined(of, cut(_verified(rest, cells, threshold)))

    named = nodes.select("node", "k1", "k2", "doc_id").join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = named.join(smallest, "root").select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), "class_id", F.lit(True).alias("compared"))
    rows = sigs.select("doc_id", "k1", "k2", *carried)
    return (
        rows.join(named, (rows["k1"] == named["x1"]) & (rows["k2"] == named["x2"]), "left")
        .select("doc_id", F.when(F.col("compared"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), *carried)
    )


def unique_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id is that of their class; all rows without doc_id in a class without any.

    Of rows with one doc_id in one class, all stay.  Each row is decided by
    doc_id and text, since rows with one doc_id may be in several classes.
    """
    t1, t2 = text_key(F.col("text"))
    copies = _classes(docs.select("doc_id", "text", t1, t2), threshold).filter(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = small(copies.select(F.col("doc_id").alias("_gone"), F.col("_t1").alias("_g1"), F.col("_t2").alias("_g2")).distinct())
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), t1=t1, t2=t2)
    return rows.join(gone, (F.col("t1") == F.col("_g1")) & (F.col("t2") == F.col("_g2")) & F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti").select("_row.*")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
