"""Approximate nearest neighbours by a hash-prefix forest.

Every distinct vector gets, for each of 12 trees, a string of 32 sign bits of random
projections.  A tree is the sorted array of its strings, so the vectors that
share a prefix with a query are one range of it.  A search descends every tree to
the longest prefixes that the query shares, then ascends all trees together, one
bit at a time and, at the last bit, tree after tree, until the ranges hold enough
entries: a share of the index that is measured on a bounded sample so that recall
there is ``recall`` or more, and so many that k other vectors are surely among them.
Only the entries of these ranges are scored, in double precision.

Entries are dealt out by (tree, first bits of the string), each tree's entry to one such cell,
and queries meet the cells of their prefixes alone: first to count what
shares how many bits, then, once the levels are chosen, to score.  A cell of many
entries or queries is cut into blocks by hash; no task holds more than one block of
each.  Equal vectors are one entry with their k + 1 smallest ids, and equal
queries are searched once.

Vectors of different norms get one more coordinate that makes their norms equal, so
that the largest inner product is the smallest angle; a shorter vector counts as
filled up with zeros.

The share that isotropic data need is large (the README gives figures), since
their nearest neighbours are hardly nearer than other vectors; clustered data need
little.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without id, take no part; equal scores go by smaller vec_id; a query row is
never its own neighbour, but another row with its vec_id or vector is a candidate; rows that repeat
a vec_id are separate rows, and each such query row has its own answer; with fewer
candidates than k all are returned; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.llm.common import cut, spread_join, table

TREES = 12
BITS = 32
CELL = 4096  # entries of a cell that its prefix length aims at
MAX_PREFIX = 14
BLOCK = 16384
QUERY_BLOCK = 2048
CHUNK = 256
SAMPLE = 8192
SAMPLE_QUERIES = 256
RECALL = 0.95
#: Entries in the ranges of all trees together, over the entries of the index; TREES is all of them.
SHARES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.35, 1.5, 1.75, 2.0, 2.4, 2.8, 3.4, 4.0, 5.6, 8.0, TREES)


def planes(dim: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, TREES * BITS))


def codes(vectors: np.ndarray, longest: float, projections: np.ndarray, stored: bool) -> np.ndarray:
    """Strings of sign bits, one u32 for each vector and tree; stored vectors are filled up to norm ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1))) if stored else np.zeros(len(vectors))
    bits = (vectors @ projections[:-1] + rest[:, None] * projections[-1]) > 0
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.uint64)
    return (bits.reshape(len(vectors), TREES, BITS) @ weights).astype(np.uint32)


def matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def shared(ordered: np.ndarray, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string: the range of the sorted array that shares ``level`` bits with it."""
    mask = np.uint32(0) if level == 0 else np.uint32((0xFFFFFFFF << (BITS - level)) & 0xFFFFFFFF)
    first = strings & mask
    return np.searchsorted(ordered, first, "left"), np.searchsorted(ordered, first | ~mask, "right")


def ascend(counts: np.ndarray, enough: int) -> np.ndarray:
    """Level of each tree for each query, from counts (queries, trees, levels 0 to BITS) of entries that share so many bits.

    Starts at the longest prefixes; the last step up is made tree after tree until ``enough`` entries are held.
    """
    total = counts.sum(axis=1)
    level = BITS - np.argmax((total >= enough)[:, ::-1], axis=1)
    level[~(total >= enough).any(axis=1)] = 0
    rows = np.arange(len(counts))
    up, stay = counts[rows, :, level], counts[rows, :, np.minimum(level + 1, BITS)]
    gained = stay.sum(axis=1, keepdims=True) + np.cumsum(up - stay, axis=1)
    moved = np.argmax(gained >= enough, axis=1)  # the first tree with which enough are held
    moved[~(gained >= enough).any(axis=1)] = counts.shape[1] - 1
    return np.where((np.arange(counts.shape[1])[None, :] <= moved[:, None]) | (level[:, None] == BITS), level[:, None], level[:, None] + 1)


def measured_share(sample: np.ndarray, k: int, longest: float, projections, recall: float = RECALL) -> float:
    """The smallest of ``SHARES`` whose candidates hold ``recall`` of the k nearest on a sample."""
    sample = np.unique(sample, axis=0)
    n = len(sample)
    k = min(k, n - 1)
    if k < 1:
        return float(TREES)
    at = np.arange(0, n, max(1, n // SAMPLE_QUERIES))
    stored, asked = codes(sample, longest, projections, True), codes(sample[at], longest, projections, False)
    order = np.argsort(stored, axis=0, kind="stable")
    sorted_ = np.take_along_axis(stored, order, axis=0)
    counts = np.empty((len(at), TREES, BITS + 1), np.int64)
    for t in range(TREES):
        for level in range(BITS + 1):
            low, high = shared(sorted_[:, t], asked[:, t], level)
            counts[:, t, level] = high - low
    scores = sample[at] @ sample.T
    scores[np.arange(len(at)), at] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    # bits that each true neighbour shares with its query, tree by tree
    common = np.stack([BITS - np.ceil(np.log2((stored[true, t] ^ asked[:, t, None]).astype(np.float64) + 1)) for t in range(TREES)], axis=2)
    for share in SHARES[:-1]:
        levels = ascend(counts, max(int(np.ceil(share * n)), (k + 1) * TREES))
        if (common >= levels[:, None, :]).any(axis=2).mean() >= recall:
            return share
    return float(TREES)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (an array of floats or doubles): the rows that take part."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.elementType.typeName() not in ("float", "double"):
        v = F.transform(vector_col, lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(sound)


def _key() -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("vector"), "v").alias("h2")]


def indexed(vectors: DataFrame, k: int, longest: float, dim: int, projections) -> DataFrame:
    """h1, h2, ids, v, codes: one row a distinct vector, with its k + 1 smallest ids and its string in each tree."""
    first = Window.partitionBy("h1", "h2").orderBy("id")
    kinds = (
        vectors.select("id", "v", *_key()).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    )
    return kinds.withColumn("codes", _coder(longest, dim, projections, True)("v"))


def _coder(longest: float, dim: int, projections, stored: bool):
    @F.pandas_udf("array<long>")
    def strings(v: pd.Series) -> pd.Series:
        return pd.Series(list(codes(matrix(v, dim), longest, projections, stored).astype(np.int64)), index=v.index)

    return strings


def _in_cells(rows: DataFrame, p: int) -> DataFrame:
    return rows.select("*", F.posexplode("codes").alias("tree", "code")).drop("codes").withColumn("cell", F.shiftright("code", BITS - p))


def _parts(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("int")


def _dealt(entries: DataFrame, probes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by (tree, cell, block, query block); cells without a probe are left out."""
    asked = probes.groupBy("tree", "cell").agg(F.count("*").alias("nq"))
    cells = F.broadcast(cut(sizes.join(asked, ["tree", "cell"]).select("tree", "cell", _parts(F.col("n"), BLOCK).alias("blocks"), _parts(F.col("nq"), QUERY_BLOCK).alias("q_blocks"))))  # TREES * 2**MAX_PREFIX rows at most
    own = lambda salt, n: F.pmod(F.xxhash64("h1", "h2", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = entries.join(cells, ["tree", "cell"]).withColumn("block", own("entry", "blocks")).withColumn("q_block", every("q_blocks")).drop("blocks", "q_blocks")
    right = probes.join(cells, ["tree", "cell"]).withColumn("q_block", own("query", "q_blocks")).withColumn("block", every("blocks")).drop("blocks", "q_blocks")
    # both sides stem from one index: columns of their own keep them apart
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])


PLACE = ["tree", "cell", "block", "q_block"]


def levels(index: DataFrame, asked: DataFrame, sizes: DataFrame, p: int, enough: int) -> DataFrame:
    """h1, h2, levels, entries: for each query the level of every tree and the entries that are then in its ranges."""
    grid = np.zeros((TREES, 1 << p), np.int64)
    for r in sizes.collect():  # TREES * 2**MAX_PREFIX rows at most
        grid[r["tree"], r["cell"]] = r["n"]
    left, right = _dealt(_in_cells(index.select("h1", "h2", "codes"), p).select("h1", "h2", "tree", "cell", "code"), _in_cells(asked.select("h1", "h2", "codes"), p), sizes)

    def count(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ordered, strings = np.sort(entries["code"].to_numpy().astype(np.uint32)), queries["code"].to_numpy().astype(np.uint32)
        out = np.empty((len(strings), BITS - p + 1), np.int64)
        for i, level in enumerate(range(p, BITS + 1)):
            low, high = shared(ordered, strings, level)
            out[:, i] = high - low
        return pd.DataFrame({"h1": queries["h1"], "h2": queries["h2"], "tree": queries["tree"], "cell": queries["cell"], "n": list(out)})

    deep = left.groupBy(*PLACE).cogroup(right.groupBy(*PLACE)).applyInPandas(count, "h1 long, h2 long, tree int, cell long, n array<long>")
    summed = deep.groupBy("h1", "h2", "tree", "cell").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(BITS - p + 1)]).alias("n"))
    by_query = summed.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("tree", "cell", "n"))).alias("trees"))  # TREES each

    @F.pandas_udf("struct<levels:array<int>,entries:long>")
    def choose(trees: pd.Series) -> pd.DataFrame:
        counts = np.zeros((len(trees), TREES, BITS + 1), np.int64)
        for i, each in enumerate(trees):
            for r in each:
                t, cell = r["tree"], r["cell"]
                counts[i, t, p:] = r["n"]
                for level in range(p):
                    first = cell >> (p - level) << (p - level)
                    counts[i, t, level] = grid[t, first: first + (1 << (p - level))].sum()
            for t in set(range(TREES)) - {r["tree"] for r in each}:  # its cell is empty
                counts[i, t, 0] = grid[t].sum()
        chosen = ascend(counts, enough)
        held = np.take_along_axis(counts, chosen[:, :, None], axis=2).sum(axis=(1, 2))
        return pd.DataFrame({"levels": list(chosen.astype(np.int32)), "entries": held})

    return by_query.select("h1", "h2", choose("trees").alias("got")).select("h1", "h2", "got.levels", "got.entries")


def best_of(strings, v, firsts, q_strings, q, q_levels, p: int, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, entries, scores): the ``top`` entries of each query's range in one block, nearest first.

    Entries are in order of their strings; ``firsts`` are their smallest ids.
    """
    whole = q_levels <= p  # the cell lies within the range
    for a in range(0, len(q), CHUNK):
        at = np.flatnonzero(whole[a: a + CHUNK]) + a
        if len(at):
            rough = q[at] @ v.T
            n = min(top, len(v))
            edge = np.partition(rough, len(v) - n, axis=1)[:, len(v) - n]
            for i, row, e in zip(at, rough, edge):
                yield i, *_exact(np.flatnonzero(row >= e - 1e-9 * (1 + abs(e))), v, q[i], firsts, top)
    for level in np.unique(q_levels[~whole]):
        at = np.flatnonzero(q_levels == level)
        low, high = shared(strings, q_strings[at], int(level))
        for i, lo, hi in zip(at, low, high):
            if hi > lo:
                yield i, *_exact(np.arange(lo, hi), v, q[i], firsts, top)


def _exact(at: np.ndarray, v: np.ndarray, q: np.ndarray, firsts: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    score = (v[at] * q).sum(axis=1)
    order = np.lexsort((firsts[at], -score))[:top]
    return at[order], score[order]


def prepared(vectors: DataFrame, queries: DataFrame, k: int, recall: float, seed: int):
    """index, asked, sizes, p, enough, dim: what levels and scores are computed from; None for an empty index."""
    facts = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m"), F.max(F.size("v")).alias("dim")).first()
    if facts["dim"] is None:
        return None
    longest, dim = float(facts["m"]) ** 0.5, facts["dim"]
    projections = planes(dim, seed)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
    share = measured_share(matrix([r["v"] for r in sample], dim), k, longest, projections, recall)
    index = cut(indexed(vectors, k, longest, dim, projections))
    n = index.count()
    p = int(min(MAX_PREFIX, max(0, np.ceil(np.log2(n / CELL)))))
    sizes = cut(_in_cells(index.select("codes"), p).groupBy("tree", "cell").agg(F.count("*").alias("n")))
    wanted = queries.select("v").select(*_key()).distinct()
    asked = index.join(wanted, ["h1", "h2"], "left_semi").select("h1", "h2", "v", _coder(longest, dim, projections, False)("v").alias("codes"))
    return index, cut(asked), sizes, p, max(int(np.ceil(share * n)), (k + 1) * TREES), dim


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query.

    ``vectors`` and ``queries`` are (id, v) as of ``valid``; the queries are rows of ``vectors``.
    """
    ready = prepared(vectors, queries, k, recall, seed)
    if ready is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, asked, sizes, p, enough, dim = ready
    chosen = levels(index, asked, sizes, p, enough).select("h1", "h2", "levels")
    probes = (
        asked.join(chosen, ["h1", "h2"]).select("h1", "h2", "v", F.posexplode(F.arrays_zip("codes", "levels")).alias("tree", "at"))
        .select("h1", "h2", "v", "tree", F.col("at.codes").alias("code"), F.col("at.levels").alias("level"))
        .withColumn("own", F.shiftright("code", BITS - p)).withColumn("span", F.expr(f"shiftleft(1L, greatest(0, {p} - level))"))
        .withColumn("low", F.col("own") - F.col("own") % F.col("span"))
        .withColumn("cell", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("span") - 1))).drop("own", "span", "low")
    )
    left, right = _dealt(_in_cells(index, p), cut(probes), sizes)

    def score(entries: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(asked_):
            strings = entries["code"].to_numpy().astype(np.uint32)
            order = np.argsort(strings, kind="stable")
            v, ids = matrix(entries["v"], dim)[order], entries["ids"].to_numpy()[order]
            keys, q_keys = (x[["h1", "h2"]].to_numpy() for x in (entries.iloc[order], asked_))
            found = best_of(strings[order], v, np.array([x[0] for x in ids]), asked_["code"].to_numpy().astype(np.uint32), matrix(asked_["v"], dim), asked_["level"].to_numpy(), p, k + 1)
            for i, at, scores in found:
                out.append(pd.DataFrame({"h1": q_keys[i, 0], "h2": q_keys[i, 1], "e1": keys[at, 0], "e2": keys[at, 1], "score": scores, "ids": list(ids[at])}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("h1", "int64"), ("h2", "int64"), ("e1", "int64"), ("e2", "int64"), ("score", "float64"), ("ids", "object"))})

    some = left.groupBy(*PLACE).cogroup(right.groupBy(*PLACE)).applyInPandas(score, "h1 long, h2 long, e1 long, e2 long, score double, ids array<long>")
    # an entry found in several trees counts once; k + 1 entries hold the k nearest and the query itself
    nearest = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0])
    once = some.repartition("h1", "h2").dropDuplicates(["h1", "h2", "e1", "e2"]).withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k + 1)
    own = (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2"))
    hits = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"), own.alias("own")))
    best = once.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.flatten(F.collect_list(hits))), 1, k + 1).alias("best"))
    rows = spread_join(queries.select(F.col("id").alias("query_id"), *_key()), best, ["h1", "h2"], ["query_id"])
    # the query's own row is among the hits by its id and vector, unless k + 1 smaller ids have that vector
    self_at = F.array_position(F.transform("best", lambda x: x["own"] & (x["id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("best", lambda x, i: i + 1 != self_at), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(vectors, vectors.filter("id % 20 = 0"))
