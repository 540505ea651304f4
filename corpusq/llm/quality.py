"""Quality classifier: attention over a document's passages (multiple-instance learning).

A document is a bag of passages of 64 words.  A passage's surface features
(kinds of characters, lengths, repetition) go through a small encoder; gated
attention, learnt from document labels alone, weighs the passages; the
weighted sum of their codes is scored by a logistic output.  So one bad passage can
decide a document, and nobody has to label passages.

The model is fitted on the driver, in batches of documents, on at most ``TRAIN_DOCS`` labelled
documents outside the held-out fold, chosen by a hash of doc_id, with all their passages.
Scores read every passage of every text.

Defined cases: a null text is empty; an empty text is a bag with one passage
of zeros; a null doc_id is not held out and carries no label; rows with one doc_id are scored each by its own text; several labels
of a doc_id count by their mean; without labels of both kinds every score is
0.5; texts of over ``PIECE`` bytes are cut at white space into pieces whose
passages all belong to the bag; other columns are kept, and an added column whose name the input has gets ``_`` after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import free_name, give_back, packed, table, text_batches

FOLDS = 5
CUTOFF = 0.3
PASSAGE_WORDS = 64
TRAIN_DOCS = 6000
BATCH_DOCS, BATCH_PASSAGES = 256, 1 << 15
PIECE = 1 << 22
SLICE = 1 << 19
HIDDEN, GATE = 16, 8

_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _BANG, _PIPE, _PUNCT, _HIGH = range(9)
_KIND = np.full(256, _PUNCT, np.uint8)
_KIND[:33] = _SPACE
_KIND[ord("a"): ord("z") + 1] = _LOWER
_KIND[ord("A"): ord("Z") + 1] = _UPPER
_KIND[ord("0"): ord("9") + 1] = _DIGIT
_KIND[[ord(x) for x in "*$#%&@^~<>{}\\"]] = _SYMBOL
_KIND[ord("!")] = _BANG
_KIND[ord("|")] = _PIPE
_KIND[128:] = _HIGH
N_FEATURES = 8 + 5


def passage_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts data[bounds[i]:bounds[i + 1]] (UTF-8), and passages a text."""
    n_docs = len(bounds) - 1
    kind = _KIND[data]
    solid = kind != _SPACE
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[edges] = solid[edges]
    last[edges[1:] - 1] = solid[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return np.zeros((0, N_FEATURES)), np.zeros(n_docs, np.int64)
    doc = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(doc, minlength=n_docs)
    nth = np.arange(len(starts)) - (np.cumsum(words) - words)[doc]
    heads = np.flatnonzero(nth % PASSAGE_WORDS == 0)
    length = ends - starts + 1
    total = np.cumsum(data, dtype=np.int64)
    moment = np.cumsum(data * np.arange(len(data), dtype=np.int64))
    below = np.where(starts > 0, starts - 1, 0)
    weight = total[ends] - np.where(starts > 0, total[below], 0)
    moved = moment[ends] - np.where(starts > 0, moment[below], 0) - starts * weight
    again = np.zeros(len(starts))
    again[1:] = (length[1:] == length[:-1]) & (weight[1:] == weight[:-1]) & (moved[1:] == moved[:-1]) & (nth[1:] > 0)
    passage = np.zeros(len(data), np.int64)
    passage[starts[heads]] = 1
    passage = np.maximum(np.cumsum(passage) - 1, 0)
    kinds = np.bincount(passage * 16 + kind, minlength=len(heads) * 16).reshape(-1, 16)[:, 1:9].astype(np.float64)
    n_words = np.add.reduceat(np.ones(len(starts)), heads)
    per_word = [np.add.reduceat(x, heads) / n_words for x in (length / 10.0, again, (length == 1).astype(np.float64), (kind[ends] == _SYMBOL).astype(np.float64))]
    x = np.column_stack([kinds / kinds.sum(axis=1, keepdims=True), *per_word, np.log1p(n_words) / 5])
    return x, np.bincount(doc[heads], minlength=n_docs)


def _pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    out = []
    while len(raw) > PIECE:
        at = max(raw.rfind(c, 1, PIECE) for c in (b" ", b"\n"))
        at = at if at > 0 else PIECE
        out.append(raw[:at])
        raw = raw[at:]
    return [*out, raw]


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passage features and passages a text, for slices of the texts in order; an empty text has one passage of zeros."""

    def of(raw: list[bytes], owner: list[int], n: int):
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        x, count = passage_features(np.frombuffer(b"".join(raw), np.uint8), bounds)
        per = np.bincount(owner, count, minlength=n).astype(np.int64)
        if (per == 0).any():
            x = np.insert(x, np.cumsum(per)[per == 0], 0.0, axis=0)
            per = np.maximum(per, 1)
        return x, per

    raw, owner, n, held = [], [], 0, 0
    for text in map(pa.StringScalar.as_py, texts):
        parts = _pieces(text or "")
        raw += parts
        owner += [n] * len(parts)
        n, held = n + 1, held + sum(map(len, parts))
        if held >= SLICE:
            yield of(raw, owner, n)
            raw, owner, n, held = [], [], 0, 0
    if n:
        yield of(raw, owner, n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionMIL:
    """Encoder, gated attention and logistic output; plain arrays in ``p``."""

    def __init__(self, p: dict[str, np.ndarray] | None = None):
        self.p = p

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, heads = self.p, np.cumsum(counts) - counts
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), counts))
        a = e / np.repeat(np.add.reduceat(e, heads), counts)
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"]), "heads": heads}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), 0.5) if self.p is None else self._forward(x, counts)["y"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of the documents."""
        p, f = self.p, self._forward(x, counts)
        dy = (f["y"] - y) / len(y)
        dz = dy[:, None] * p["c"]
        dz_each = np.repeat(dz, counts, axis=0)
        da = (dz_each * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["heads"]), counts))
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz_each + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 500, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> AttentionMIL:
        """Adam over batches of whole documents; ``x`` may be single precision."""
        if len(y) == 0 or y.min() == y.max():
            self.p = None
            return self
        r = np.random.default_rng(seed)
        mean = x.mean(axis=0, dtype=np.float64)
        scale = np.sqrt(np.maximum(0.0, np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean**2))
        self.p = p = {
            "mean": mean, "scale": np.where(scale > 1e-6, scale, 1.0), "W": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
            "V": r.normal(0, 0.2, (HIDDEN, GATE)), "U": r.normal(0, 0.2, (HIDDEN, GATE)), "w": r.normal(0, 0.2, GATE), "c": r.normal(0, 0.2, HIDDEN), "d": np.zeros(1),
        }
        learnt = ("W", "b", "V", "U", "w", "c", "d")
        m, v = ({k: np.zeros_like(p[k]) for k in learnt} for _ in range(2))
        starts = np.cumsum(counts) - counts
        step = 0
        while step < steps:
            order = r.permutation(len(y))
            held = np.cumsum(counts[order])
            a = 0
            while a < len(y) and step < steps:
                b = min(a + BATCH_DOCS, max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + BATCH_PASSAGES, "right"))))
                docs = order[a:b]
                a, step = b, step + 1
                rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in docs])
                grads = self.gradients(x[rows].astype(np.float64), counts[docs], y[docs])
                for k in learnt:
                    grad = grads[k] + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    p[k] = p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> AttentionMIL:
    """Fit on labelled documents outside the held-out fold, ``max_docs`` at most."""
    text_batches(docs.sparkSession)
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.avg(F.col("quality").cast("double")).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x, counts in bags(batch.column(2)):
                out, edge = [], 0
                for n in counts:
                    bag = x[edge: edge + n]
                    edge += n
                    out.append(bag.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), batch.column(1).slice(at, len(counts)), pa.array(out, pa.binary())], ["id", "y", "bag"])
                at += len(counts)
            give_back()

    sample = (
        docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "_y", "text").mapInArrow(features, "id long, y double, bag binary")
        .orderBy("id", "bag").limit(max_docs).collect()  # bounded by max_docs
    )
    if not sample:
        return AttentionMIL()
    parts = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in sample]
    return AttentionMIL().fit(np.concatenate(parts), np.array(list(map(len, parts))), np.array([float(r["y"] >= 0.5) for r in sample]))


def scorer(model: AttentionMIL):
    """A column function: text to the probability of label 1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        got = [model.score(x, counts) for x, counts in bags(texts)]
        give_back()
        return pa.array(np.concatenate(got) if got else np.empty(0), pa.float64())

    return score


def scored(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` with held_out, score and predicted added."""
    score = scorer(fit(docs, labels, max_docs))
    names = [free_name(docs, c) for c in ("held_out", "score", "predicted")]
    got = packed(docs, score=score(F.col("text")), held_out=held_out(F.col("doc_id")))
    return got.select("_row.*", F.col("held_out").alias(names[0]), F.col("score").alias(names[1]), F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias(names[2]))


def accepted(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return packed(docs, score=scorer(fit(docs, labels, max_docs))(F.col("text"))).filter(F.col("score") >= CUTOFF).select("_row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
