"""Search over quantised vectors against brute force."""

import os

import numpy as np
import pytest

from corpusq.operators import ann

SF = "/root/testdata/sf0.1"


def exact(ids, x, q, k):
    s = x @ q
    return ids[np.lexsort((ids, -s))[:k]]


def clustered(n=6000, dim=50, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(80, dim))[r.integers(0, 80, n)] + 0.4 * r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Isotropic vectors of the test data, and clustered ones whose dimension the slices do not divide."""
    out = {}
    data = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS rowid", "embedding AS vector")
    x = clustered()
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "rowid long, vector array<double>").repartition(5)
    for name, df in (("data", data), ("clustered", made)):
        model = ann.fit_quantiser(df)
        path = str(tmp_path_factory.mktemp(name))
        ann.write_codes(df, model, path)
        rows = df.filter("vector is not null").orderBy("rowid").collect()
        out[name] = path, model, np.array([r.rowid for r in rows]), np.array([r.vector for r in rows], np.float64)
    return out


@pytest.mark.parametrize("name, probes, least", [("data", None, 0.95), ("clustered", None, 0.95), ("clustered", 15, 0.9)])
def test_recall(spark, tables, name, probes, least):
    path, model, ids, x = tables[name]
    chosen = range(0, len(x), len(x) // 60)
    got = {}
    for r in ann.nearest(spark, path, model, [(int(ids[i]), x[i].tolist()) for i in chosen], 20, probes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.rowid, r.score))
    found = 0
    for i in chosen:
        rows = sorted(got[int(ids[i])])
        assert [r[0] for r in rows] == list(range(1, 21))
        at = np.searchsorted(ids, [r[1] for r in rows])
        assert np.allclose([r[2] for r in rows], x[at] @ x[i], atol=1e-9)
        found += len({r[1] for r in rows} & set(exact(ids, x, x[i], 20).tolist()))
    assert found / (20 * len(chosen)) >= least


def test_codes_are_short(spark, tables):
    path, model, ids, x = tables["data"]
    cell, code = model.code(x)
    assert code.shape == (len(x), 16) and code.dtype == np.uint8 and len(model.centroids) == ann.n_cells(len(x))
    size = lambda part: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/{part}") for f in fs if f.endswith(".parquet"))
    assert x[0].size * 4 == 16 * code.shape[1] and size("vectors") > 400_000
    # the table's scores are those of the points that stand for a vector
    q = x[:3]
    to_cells, to_points = model.tables(q)
    whole = np.concatenate([b[c] for b, c in zip(model.books, code.T)], axis=1)
    assert np.allclose(to_cells[:, cell] + to_points[:, np.arange(16), code].sum(axis=2), q @ (model.centroids[cell] + whole).T)


def test_one_query_reads_the_pages_of_its_candidates(spark, tables):
    path, model, ids, x = tables["data"]
    plan = ann.nearest(spark, path, model, [(0, x[0].tolist())], 5, rerank=8)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "EqualTo(rowid" in plan


def test_cells_are_pruned(spark, tables):
    path, model, ids, x = tables["clustered"]
    a = ann.nearest(spark, path, model, [(0, x[0].tolist())], 5, probes=2)
    assert a.count() == 5
    assert ann.nearest(spark, path, model, [], 5).collect() == []


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "rowid long, vector array<float>")
    model = ann.fit_quantiser(none)
    ann.write_codes(none, model, str(tmp_path))
    assert ann.nearest(spark, str(tmp_path), model, [(1, [1.0, 0.0])], 5).collect() == []
