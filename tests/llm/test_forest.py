import numpy as np
from pyspark.sql import functions as F

from corpusq.llm import forest


def brute(ids, v, queries, k):
    """Rows are apart even if ids repeat; ``queries`` are places."""
    out = []
    for q in queries:
        scores = (v * v[q]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(scores[i])) for r, i in enumerate(order)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def found(spark, v, k=20, **options):
    rows = forest.valid(frame(spark, [(i, v[i].tolist(), 0) for i in range(len(v))]).repartition(3))
    return forest.search(rows, rows.filter("id % 20 = 0"), k=k, **options).collect()


def recall(v, got, k=20):
    near = {}
    for g in got:
        near.setdefault(g.query_id, []).append(g.vec_id)
    share = []
    for q in range(0, len(v), 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        share.append(len(set(np.argsort(-scores, kind="stable")[:k]) & set(near[q])) / k)
        assert len(near[q]) == k and q not in near[q]
    return np.mean(share)


def test_small_and_odd_rows(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(13, 4)).astype(np.float32)
    v[6:12] = v[6]  # a group of equal vectors
    good = [(int(i), v[i].tolist(), 0) for i in range(13)] + [(0, v[3].tolist(), 0), (0, v[3].tolist(), 0), (5, [2.0, 1.0], 0), (20, [1.5], 0)]
    bad = [(40, None, 0), (60, [0.0] * 4, 0), (80, [1.0, None, 0.0, 0.0], 0), (100, [float("nan"), 1.0, 1.0, 1.0], 0), (120, [float("inf"), 1.0, 1.0, 1.0], 0), (140, [], 0), (None, [1.0] * 4, 0)]
    rows = forest.valid(frame(spark, good + bad).repartition(4))
    got = sorted(map(tuple, forest.search(rows, rows.filter("id % 20 = 0"), k=20).collect()))
    filled = np.array([x + [0.0] * (4 - len(x)) for _, x, _ in good])
    want = sorted(brute([i for i, *_ in good], filled, [i for i, (q, *_) in enumerate(good) if q % 20 == 0], 20))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    few = rows.filter("id < 3 and id > 0")
    assert [x.rank for x in forest.search(few, few.filter("id = 1"), k=12).collect()] == [1]
    assert forest.search(rows.filter("id < 0"), rows.filter("id < 0")).collect() == []
    assert forest.search(rows, rows.filter("id < 0")).collect() == []


def test_equal_vectors_are_all_candidates(spark):
    v = np.ones((90, 3), np.float32)
    got = found(spark, v, k=20)
    for q in (0, 20, 80):
        assert [g.vec_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == [i for i in range(22) if i != q][:20]


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(4)
    v = (r.normal(size=(4000, 16)) * r.uniform(0.5, 2, size=(4000, 1))).astype(np.float32)
    got, exact = found(spark, v), v.astype(np.float64)
    for g in got:
        assert abs(g.score - float((exact[g.query_id] * exact[g.vec_id]).sum())) < 1e-12 * 64
    assert recall(exact, got) >= 0.9


def test_clustered_vectors_need_few_scores(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(100, 32))
    v = (centres[r.integers(0, 100, 6000)] + 0.2 * r.normal(size=(6000, 32))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert recall(v.astype(np.float64), found(spark, v)) >= 0.9
    rows = forest.valid(frame(spark, [(i, v[i].tolist(), 0) for i in range(6000)]))
    index, asked, sizes, p, enough, _ = forest.prepared(rows, rows.filter("id % 20 = 0"), 20, forest.RECALL, 17)
    scored = forest.levels(index, asked, sizes, p, enough).agg(F.avg("entries")).first()[0]
    assert scored < 0.25 * 6000, scored  # entries scored for each query, repeats in several trees counted


def test_levels_against_counting(spark):
    r = np.random.default_rng(1)
    strings = np.sort(r.integers(0, 2**32, 500).astype(np.uint32))
    asked = r.integers(0, 2**32, 20).astype(np.uint32)
    for level in (0, 1, 5, 32):
        low, high = forest.shared(strings, asked, level)
        assert (high - low).tolist() == [sum(int(s) >> (32 - level) == int(a) >> (32 - level) for s in strings) for a in asked]
    counts = np.zeros((1, forest.TREES, 33), np.int64)
    counts[0, :, :4] = [100, 40, 9, 2]
    for enough in (1, 24, 25, 100, 108, 109, 500, 1200, 5000):
        got = forest.ascend(counts, enough)[0]
        held = counts[0, np.arange(forest.TREES), got].sum()
        assert held >= min(enough, 1200) and got.max() - got.min() <= 1
        deeper = got.copy()
        deeper[np.flatnonzero(got == got.min())[-1]] += 1
        if held > 24:
            assert counts[0, np.arange(forest.TREES), np.minimum(deeper, 32)].sum() < enough
