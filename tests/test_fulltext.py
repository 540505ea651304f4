"""The full-text language against SQLite's own index: which queries are syntax, and what they find."""

import random
import sqlite3

import pytest

from corpusq.operators import fulltext, postings, search

WORDS = ["foo", "bar", "baz", "qux", "fool"]
FIXED = [
    '"bar foo"', '"foo bar"', "foo bar", "foo OR bar NOT baz", "bar AND foo NOT baz", "foo NOT bar baz", "foo NOT bar NOT baz", "foo AND (bar OR qux)", 'foo "???"', 'foo AND "???"', '"???" OR foo', "foo NOT \"???\"", '"???"',
    "NEAR(foo bar)", "NEAR(foo bar, 0)", "NEAR(foo bar baz, 1)", 'NEAR("foo bar" qux, 2)', 'NEAR(foo "???" bar, 1)', "NEAR(fo* ba*, 1)", "^foo", '^"foo bar"', "fo*", '"foo ba"*', "foo + ba*", "fo* + bar", "text : foo", "- text : foo",
    "{text source_file} : foo", "source_file : (foo OR txt) AND text : bar", "- source_file : NEAR(foo bar, 1)", "réunion", "REUNION", "café", "Ελλάδα", "ελλαδα", "質量", "text : ^baz", '"say ""foo"" bar"', "NEAR", "source_file : foo text : foo",
]


def table():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(9))), r.choice(["", "/foo/bar.txt", "/x/baz foo.pdf"])) for i in range(40)]
    return [*rows, (100, "Réunion de café", ""), (101, "Ελλάδα ΕΛΛΑΔΑ", "/質量.docx"), (102, 'say "foo", bar', ""), (103, "", ""), (104, "near and or", "")]


@pytest.fixture(scope="module")
def db():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, source_file)")
    con.executemany("INSERT INTO f(rowid, text, source_file) VALUES (?, ?, ?)", table())
    return con


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, f"c{i}", t, p, "text", i, 8) for i, t, p in table()]
    return spark.createDataFrame(rows, "rowid long, chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long").cache()


def asked(db, query):
    try:
        return [r[0] for r in db.execute("SELECT rowid FROM f WHERE f MATCH ? ORDER BY rowid", (query,))]
    except sqlite3.OperationalError:
        return None


def test_syntax_is_that_of_the_index(db):
    r = random.Random(1)
    atoms = ["foo", "bar", '"a b"', "(", ")", "AND", "OR", "NOT", "NEAR(", "NEAR", ",", "3", "*", "+", "^", "-", ":", "text", "source_file", "{", "}", '"', '""', '"?"', " ", "|", "é"]
    seen = [0, 0]
    for query in [*FIXED, *(" ".join(r.choice(atoms) for _ in range(r.randrange(1, 9))) for _ in range(20000))]:
        want = asked(db, query) is not None
        try:
            fulltext.parse(query)
            got = True
        except fulltext.QueryError:
            got = False
        assert got == want, query
        seen[want] += 1
    assert min(seen) > 500


@pytest.mark.parametrize("query", FIXED)
def test_finds_what_the_index_finds(db, chunks, query):
    assert sorted(r.rowid for r in fulltext.search(chunks, query).select("rowid").collect()) == asked(db, query)


def test_random_queries_over_stored_postings(db, chunks, spark, tmp_path):
    postings.write(postings.build(chunks), f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    r = random.Random(8)

    def tree(depth):
        if depth == 0:
            return r.choice(["foo", "bar", "qux", '"foo bar"', "ba*", "NEAR(foo bar, 1)", "NEAR(baz qux bar, 2)", "^foo", "text : baz"])
        return f"({tree(depth - 1)}) {r.choice(['AND', 'OR', 'NOT'])} ({tree(r.randrange(depth))})"

    found = 0
    for _ in range(12):
        query = tree(2)
        got = sorted(x.rowid for x in fulltext.rows(stored, fulltext.parse(query)).collect())
        assert got == asked(db, query), query
        found += len(got)
    assert found > 50


def test_keyword_search_reads_quotes(chunks, spark):
    rows = spark.createDataFrame([(1, "1", "foo bar", "", "text", 0, 2), (2, "2", "bar foo", "", "text", 1, 2)], chunks.schema)
    for find in (lambda q: search.keyword_search(rows, q), lambda q: search.exhaustive_search(rows, q), lambda q: postings.keyword_search(rows, postings.build(rows), q), lambda q: search.hybrid_search(rows, q, None)):
        assert [r.rowid for r in find('"bar foo"').collect()] == [2]
    assert [r.rowid for r in search.keyword_search(rows, '"bar" NOT "foo bar"').collect()] == [2]
    # no syntax: all its words
    assert [r.rowid for r in search.keyword_search(rows, 'bar "foo').collect()] == [1, 2]


def test_postings_are_read_by_token(chunks, spark, tmp_path):
    postings.write(postings.build(chunks), f"{tmp_path}/p")
    plan = fulltext.rows(spark.read.parquet(f"{tmp_path}/p"), fulltext.parse('"foo bar" AND ba*'))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,foo)" in plan and "StringStartsWith(token,ba)" in plan
