import random
import sqlite3

import pytest

from corpusq.operators import search

CHUNKS = [
    (1, "Réunion plan", "/kb/a/report.pdf"), (2, "foo-bar baz", "/kb/a/x.docx"), (3, "质量 管理", "/kb/b/质量.docx"), (4, "质量管理体系", "/kb/b/y.docx"),
    (5, "foo baz bar", "/kb/a/foo_bar.txt"), (6, "", ""), (7, "snake_case Word", "/kb/c/z.pdf"), (8, "12 apples", ""),
]
QUERIES = ["reunion", "foo-bar", "质量", "质量管理", "pdf", "管", "???", "foo ???", 'say "foo', "snake", "Word apples", "bar.txt", "x-docx", "管 foo"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, f"c{i}", t, p, "text", i, 8, [float(i % 3), 1.0]) for i, t, p in CHUNKS]
    return spark.createDataFrame(rows, "rowid long, chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long, vector array<float>")


def fts(query):
    """Matches of an SQLite full-text index for the OR of the query's phrases."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, source_file)")
    db.executemany("INSERT INTO f(rowid, text, source_file) VALUES (?, ?, ?)", CHUNKS)
    phrases = search.query_phrases(query)
    try:
        return [r[0] for r in db.execute("SELECT rowid FROM f WHERE f MATCH ? ORDER BY rowid", (" OR ".join(f'"{p}"' for p in phrases) if phrases else query,))]
    except sqlite3.OperationalError:
        return None


@pytest.mark.parametrize("query", QUERIES)
def test_keyword_agrees_with_full_text_index(chunks, query):
    want = fts(query)
    got = [r.rowid for r in search.keyword_search(chunks, query, 50).collect()]
    if want is not None:
        assert got == want


def test_bigram_mode(chunks):
    got = [r.rowid for r in search.keyword_search(chunks, "质量", 50, mode="cjk_bigram").collect()]
    assert got == [3, 4]


def test_keyword_is_not_cut_to_top_k(spark):
    rows = [(i, str(i), "same word", f"/f{i % 9}", "text", 0, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "rowid long, chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long")
    assert [r.rowid for r in search.keyword_search(df, "word", 5).collect()] == list(range(200))


def test_hybrid_against_model(chunks):
    query, vector, k = "foo 质量 pdf", [0.6, 0.8], 6
    rows = {r.rowid: r for r in chunks.collect()}
    kw = [r.rowid for r in search.keyword_search(chunks, query, k).collect()]
    cos = {i: sum(a * b for a, b in zip(r.vector, vector)) for i, r in rows.items()}
    near = sorted(cos, key=lambda i: (-cos[i], i))[: max(5 * k, len(rows))]
    merged = {i: 2.0 + cos[i] if i in near else 2.0 for i in kw} | {i: cos[i] for i in near if i not in kw}
    order = sorted(merged, key=lambda i: (-merged[i], i not in kw, i if i in kw else near.index(i)))
    seen, first, rest = set(), [], []
    for i in order:
        f = rows[i].source_file
        (rest if not f or f in seen else first).append(i)
        seen.add(f)
    got = search.hybrid_search(chunks, query, vector, k).orderBy("rank").collect()
    assert [r.rowid for r in got] == (first + rest)[:k]
    assert all(abs(r.score - merged[r.rowid]) < 1e-6 for r in got)


def test_dispatch(chunks):
    assert search.search(chunks, "foo", "vector", None, 3).first().match_type == "keyword"
    assert search.search(chunks, "foo", "fuzzy", lambda q: None, 3).first().score == 3.0
    got = search.search(chunks, "foo", "vector", lambda q: [1.0, 0.0], 1).collect()
    assert [r.rowid for r in got][:3] == [2, 5, 8] and got[0].match_type == "vector"


def test_arrow_scores_agree(spark, chunks):
    r = random.Random(1)
    q = [r.random(), r.random()]
    a = [(x.rowid, round(x.score, 9)) for x in search.vector_search_arrow(chunks, q, 5).collect()]
    b = [(x.rowid, round(x.score, 9)) for x in search.vector_search(chunks, q, 1, 5).collect()]
    assert a == b


def test_many_queries_in_one_pass(chunks):
    queries = [("a", "foo 质量 pdf", [0.6, 0.8]), ("b", "word", None), ("c", 'say "foo', [1.0, 0.0]), ("d", "none", [0.0, 1.0])]
    got = {}
    for r in search.hybrid_search_many(chunks, queries, 5, 8).collect():
        got.setdefault(r.point, []).append((r.rank, r.rowid, round(r.score, 6), r.match_type))
    for p, q, v in queries:
        one = search.hybrid_search(chunks, q, v, 5).collect()
        assert sorted(got.get(p, [])) == sorted((r.rank, r.rowid, round(r.score, 6), r.match_type) for r in one)
