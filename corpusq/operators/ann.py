"""Approximate vector search: vectors in cells around centroids, in full or as short codes.

Centroids are fitted on a bounded sample, their number grows with the whole table; every vector gets
the cell of its nearest centroid as a column, which partitions the table that ``write`` makes, so a
search reads only the cells nearest to its query.

``Quantiser`` codes what a vector differs from its centroid by in ``subs`` bytes, one for each of as many slices of the
vector: the number of the nearest of 256 points fitted for the slice.  A query makes one table of inner products with
those points, and a code's score is a sum of ``subs`` entries.  ``nearest`` scores codes so, keeps the best of each query,
reads the vectors of those alone and ranks them by their exact scores.

Vectors that are null take no part; without any the tables are empty and nothing is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.functions.vectors import dot
from corpusq.session import cut

SAMPLE = 50_000
MAX_CELLS = 10_000
BLOCK = 2_000  # vectors that meet all centroids at a time


def n_cells(n: int) -> int:
    return min(MAX_CELLS, max(4, math.isqrt(n)))


def _sample(vectors: DataFrame) -> np.ndarray:
    """At most ``SAMPLE`` of the vectors, the same each time."""
    sample = vectors.orderBy(F.xxhash64("rowid"), "rowid").limit(SAMPLE).select(F.col("vector").cast("array<double>")).toArrow().column(0).combine_chunks()  # bounded
    return np.asarray(sample.flatten()).reshape(len(sample), -1) if len(sample) else np.zeros((0, 0))


def fit(vectors: DataFrame, cells: int | None = None, steps: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors (rowid, vector) by spherical k-means on at most ``SAMPLE`` of them, ``n_cells`` of all by default."""
    some = vectors.filter("vector is not null")
    return _cells(_sample(some), cells or n_cells(some.count()), steps, seed)


def _cells(x: np.ndarray, cells: int, steps: int, seed: int) -> np.ndarray:
    k = min(len(x), cells)
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = np.concatenate([(x[i: i + BLOCK] @ c.T).argmax(axis=1) for i in range(0, len(x), BLOCK)]) if len(x) else np.zeros(0, int)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-12), c)
    return c


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with ``cell``."""

    def near(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v.to_numpy()) @ centroids.T).argmax(axis=1) if len(v) else [], dtype="int32")

    return vectors.filter("vector is not null").withColumn("cell", F.pandas_udf(near, "int")(F.col("vector")))


def write(indexed: DataFrame, path: str) -> None:
    """The table by cells; a cell of many vectors is written by several tasks."""
    indexed.repartitionByRange("cell", "rowid").write.mode("overwrite").partitionBy("cell").parquet(path)


def search(indexed: DataFrame, centroids: np.ndarray, query: list[float], k: int, probes: int) -> DataFrame:
    """rowid, score of the best k in the ``probes`` cells nearest to the query."""
    q = np.asarray(query, np.float64)
    cells = [int(i) for i in np.argsort(-(centroids @ q), kind="stable")[:probes]]
    column = F.array(*[F.lit(float(v)) for v in q])
    return indexed.filter(F.col("cell").isin(*cells)).select("rowid", dot(F.col("vector"), column).alias("score")).orderBy(F.desc("score"), "rowid").limit(k)


CODES = 256  # a code is one byte
#: Rows that are asked for one by one, so that the scan of a table sorted by rowid skips the pages between.
PICKED = 2_000


def _points(x: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """At most ``CODES`` means of the rows of ``x``."""
    c = x[np.random.default_rng(seed).choice(len(x), min(len(x), CODES), replace=False)]
    for _ in range(steps):
        near = _closest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
        np.add.at(sums, near, x)
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the nearest row of ``c``."""
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, int), *[(x[i: i + BLOCK] @ c.T - half).argmax(axis=1) for i in range(0, len(x), BLOCK)]])


@dataclass
class Quantiser:
    """Centroids of the cells, and for each slice of what is left of a vector the points that stand for it."""

    centroids: np.ndarray
    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.books[0].shape[1] if self.books else 0

    def _slices(self, x: np.ndarray) -> list[np.ndarray]:
        padded = np.zeros((len(x), self.width * len(self.books)))
        padded[:, : x.shape[1]] = x
        return [padded[:, j * self.width: (j + 1) * self.width] for j in range(len(self.books))]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each row of ``x``."""
        cell = np.concatenate([np.zeros(0, int), *[(x[i: i + BLOCK] @ self.centroids.T).argmax(axis=1) for i in range(0, len(x), BLOCK)]])
        rest = self._slices(x - self.centroids[cell])
        return cell.astype(np.int32), np.stack([_closest(r, b) for r, b in zip(rest, self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries ``q``: inner products with the centroids, and with the points of each slice."""
        of = np.zeros((len(q), len(self.books), CODES))
        for j, (part, book) in enumerate(zip(self._slices(q), self.books)):
            of[:, j, : len(book)] = part @ book.T
        return q @ self.centroids.T, of


def fit_quantiser(vectors: DataFrame, cells: int | None = None, subs: int = 16, steps: int = 8, seed: int = 5) -> Quantiser:
    """Fitted on at most ``SAMPLE`` of the unit vectors (rowid, vector); ``subs`` bytes a vector."""
    some = vectors.filter("vector is not null")
    x = _sample(some)
    if not len(x):
        return Quantiser(np.zeros((0, 0)), [])
    centroids = _cells(x, cells or n_cells(some.count()), steps, seed)
    width = -(-x.shape[1] // subs)
    model = Quantiser(centroids, [np.zeros((1, width))] * subs)
    rest = model._slices(x - centroids[(x @ centroids.T).argmax(axis=1)])
    model.books = [_points(r, steps, seed + j) for j, r in enumerate(rest)]
    return model


def write_codes(vectors: DataFrame, model: Quantiser, path: str) -> None:
    """``path``/codes (rowid, code, by cell) and ``path``/vectors (rowid, vector, in order of rowid)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = model.code(np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1))
                packed = pa.Array.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), packed], ["rowid", "cell", "code"])

    some = vectors.filter("vector is not null").select(F.col("rowid").cast("long").alias("rowid"), "vector")
    coded = some.mapInArrow(encode, "rowid long, cell int, code binary")
    coded.repartitionByRange("cell", "rowid").sortWithinPartitions("cell", "rowid").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    some.repartitionByRange("rowid").sortWithinPartitions("rowid").write.mode("overwrite").option("parquet.page.row.count.limit", 128).parquet(f"{path}/vectors")


def _any(conditions: list[Column]) -> Column:
    """OR of all, as a shallow tree."""
    while len(conditions) > 1:
        conditions = [conditions[i] | conditions[i + 1] if i + 1 < len(conditions) else conditions[i] for i in range(0, len(conditions), 2)]
    return conditions[0]


def nearest(spark: SparkSession, path: str, model: Quantiser, queries: list[tuple[int, list[float]]], k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """query_id, rank, rowid, score: the ``k`` nearest found for each query (id, unit vector), with their exact scores.

    Codes of the ``probes`` cells nearest to each query are scored (all, if None), all queries in one pass over them,
    and the vectors of the best ``rerank`` (10 k) of each are read.  Ties go to the smaller rowid.
    """
    out = "query_id long, rank int, rowid long, score double"
    if not queries or not model.books:
        return spark.createDataFrame([], out)
    keep = rerank or 10 * k
    ids, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)
    to_cells, to_points = model.tables(q)
    n_cells_, subs = to_cells.shape[1], np.arange(len(model.books))
    ask = np.ones((len(q), n_cells_), bool)
    if probes is not None and probes < n_cells_:
        ask = np.argsort(np.argsort(-to_cells, axis=1, kind="stable"), axis=1, kind="stable") < probes
    codes = spark.read.schema("rowid long, code binary, cell int").parquet(f"{path}/codes")
    if not ask.all(axis=1).any():
        codes = codes.filter(F.col("cell").isin(*map(int, np.flatnonzero(ask.any(axis=0)))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rowid, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(rowid), -1)
            for i in range(len(ids)):
                at = np.flatnonzero(ask[i, cell])
                s = to_cells[i, cell[at]] + to_points[i][subs, code[at]].sum(axis=1)
                best = np.lexsort((rowid[at], -s))[:keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids[i])), pa.array(rowid[at[best]]), pa.array(s[best])], ["query_id", "rowid", "near"])

    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "rowid")  # a rank limit, applied before the shuffle too
    scored = codes.select("rowid", "code", "cell").mapInArrow(score, "query_id long, rowid long, near double")
    candidates = cut(scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).select("query_id", "rowid"))
    vectors = spark.read.parquet(f"{path}/vectors")
    if len(queries) * keep <= PICKED:
        picked = sorted(r[0] for r in candidates.select("rowid").distinct().collect())  # ``PICKED`` at most
        if not picked:
            return spark.createDataFrame([], out)
        vectors = vectors.filter(_any([F.col("rowid") == i for i in picked]))
    asked = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in queries], "query_id long, asked array<double>")
    exact = candidates.join(vectors, "rowid").join(F.broadcast(asked), "query_id").select("query_id", "rowid", dot(F.col("vector"), F.col("asked")).alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rowid")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "rowid", "score")
