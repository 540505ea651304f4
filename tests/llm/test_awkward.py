"""Every operator's query and every stage on empty tables and on nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random

import pytest

import corpus_pipeline
from corpusq.llm import license_scan, mix, quality, registry, secret_scan

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn int, role string, text string",
}
#: Names that operators use for columns of their own.
CLASHES = (
    "_n _row _id _source _size _score _t1 _t2 _g1 _g2 _gone _part _parts _range _r _band _batch score predicted held_out rules sentences licences secrets spans k1 k2 bands band node root class_id compared "
    "size source_size target taken repeats finish t1 t2 key n part start n_tokens ids_crc32 cells sketch site etag modified full revisit stored outcome response_id h own speaker perspective place rendered masks row rows id rank query_id vector found item width"
).split()
ONE_A_DOCUMENT = {"op1_mix_sources", "op4_secrets", "op6_token_files", "op7_near_duplicates", "op10_quality", "op11_line_dedup", "op13_merkle_manifest"}


def awkward():
    r = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, copy, long_ = prose(12), prose(60), prose(12_000)
    docs = [(i, prose(40) if i % 3 else "JUNK!! " * 30, "en", ["a", "a", "b", None][i % 4], 1) for i in range(40)]
    docs += [(100 + i, copy, "en", "a", 1) for i in range(8)] + [(110, copy, "en", "a", 1)] * 3
    docs += [(120, None, None, None, None), (121, "", "en", "a", 0), (122, " \t\r\n", None, "b", 4), (123, long_, "en", "b", 1), (124, long_ + " end", "en", "b", 1), (125, "x" * 100_000, "en", "b", 1), (126, f"{prose(20)} {item} {prose(20)}", "en", "a", 1), (127, 'password = "abcdefghijkl1234"\nMIT License', "en", "a", 1)]
    docs += [(None, prose(30), "en", "a", 1), (None, None, None, None, None), (None, "", None, None, None)]
    vectors = [(i, [r.uniform(-1, 1) for _ in range(8)], 0) for i in range(60)] + [(60, None, None), (61, [0.0] * 8, 0), (62, [None] + [1.0] * 7, 0), (63, [float("nan")] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (40, [1.0] * 8, 0), (40, [1.0] * 8, 0), (20, [], 0)]
    pages = [(i, f"http://a.com/{i % 3}", "body", ) for i in range(20)] + [(20, None, "n"), (21, "http://a.com/1", None), (22, "", ""), (None, "http://a.com/1", "n"), (21, "http://a.com/1", None), (23, "http://b.com", long_)]
    turns = [(1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 2, "assistant", None), (1, None, None, "who"), (2, 1, "", ""), (None, None, None, None), (3, 1, "user", long_), (3, 2, "bob", "short")]
    return {
        "documents": docs, "embeddings": vectors, "pages": pages, "benchmark": [(1, item), (2, None), (3, ""), (None, prose(15)), (1, item)],
        "labels": [(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, None), (5, None, None), (999, 1, 0)], "conversations": turns,
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("awkward")
    for name, rows in awkward().items():
        df = spark.createDataFrame(rows, TABLES[name]).repartition(3)
        clashing = df
        for c in CLASHES:
            if c not in df.columns:
                clashing = clashing.selectExpr("*", f"'own' AS {c}")
        for folder, table in (("plain", df), ("clashing", clashing), ("empty", df.limit(0))):
            table.write.parquet(f"{at}/{folder}/{name}.parquet")
    return at


def rows_of(df):
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[c]) for c in df.columns) for r in df.collect())


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, folders, name):
    query = registry.QUERIES[name]
    got = rows_of(query(spark, f"{folders}/plain"))
    if name in ONE_A_DOCUMENT:
        assert len(got) == len(awkward()["documents"])
    assert got and got == rows_of(query(spark, f"{folders}/clashing"))
    assert query(spark, f"{folders}/empty").collect() == []


def test_operators_keep_clashing_columns(spark, folders):
    docs = spark.read.parquet(f"{folders}/clashing/documents.parquet")
    labels = spark.read.parquet(f"{folders}/clashing/labels.parquet")
    for made in (mix.taken(docs), secret_scan.scan(docs), license_scan.recognise(docs), quality.scored(docs, labels)):
        kept = [c for c in docs.columns if c in made.columns]
        assert len({c.lower() for c in made.columns}) == len(made.columns)
        if len(kept) == len(docs.columns):
            assert rows_of(made.select(*kept)) == rows_of(docs)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, folders, name, stage):
    given = {f: spark.read.parquet(f"{folders}/{f}/documents.parquet") for f in ("plain", "clashing", "empty")}
    out = {f: stage(spark, docs, f"{folders}/{f}") for f, docs in given.items()}
    assert out["empty"].collect() == []
    plain = rows_of(out["plain"])
    if name == "tokens":
        assert plain == rows_of(out["clashing"]) and len(plain) == len(awkward()["documents"])
        return
    assert out["clashing"].columns == given["clashing"].columns and out["plain"].columns == given["plain"].columns
    assert plain and plain == rows_of(out["clashing"].select(*given["plain"].columns))
    extra = [c for c in CLASHES if c not in given["plain"].columns]
    assert out["clashing"].select(*extra).distinct().collect() == [("own",) * len(extra)]


def test_run_on_empty_tables(spark, folders):
    assert corpus_pipeline.run(spark, f"{folders}/empty").collect() == []
