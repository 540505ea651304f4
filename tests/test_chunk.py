from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.operators import chunk

WORDS = st.lists(st.sampled_from(["alpha", "质量管理", "x1", "end.", "über", "问？", "no!"]), min_size=1, max_size=40).map(" ".join)
DOCS = st.lists(st.lists(WORDS, min_size=1, max_size=4).map("\n".join), max_size=12).map("\n\n".join)


@settings(max_examples=80, deadline=None)
@given(DOCS, st.integers(5, 200), st.integers(0, 30))
def test_lossless_fold_keeps_every_piece(text, size, overlap):
    parts = [t for t, _ in chunk.chunk_one(text, None, size, overlap, lossless=True)]
    joined = "\n\n".join(parts)
    for p in filter(None, map(str.strip, text.split("\n\n"))):
        for piece in chunk.split_long(p) if chunk.estimate(p) > size else [p]:
            assert all(line.strip() in joined for line in piece.split("\n"))
    assert bool(parts) == bool(text.strip())


def test_overlap_and_flush():
    paragraphs = [f"word{i} " * 4 for i in range(6)]
    one = chunk.estimate(paragraphs[0].strip())
    parts = chunk.fold("\n\n".join(paragraphs), size=3 * one, overlap=one)
    names = [[p.split()[0] for p in c.split("\n\n")] for c in parts]
    assert names == [["word0", "word1", "word2"], ["word2", "word3", "word4"], ["word4", "word5"]]


def test_long_paragraphs():
    sentences = "".join(f"第{i}句。" for i in range(25))
    assert [p.count("。") for p in chunk.split_long(sentences)] == [10, 10, 5]
    lines = "\n".join("y" * 1400 for _ in range(5)) + "\n" + "z" * 5000
    assert [len(p) for p in chunk.split_long(lines)] == [2801, 2801, 1400, 5000]
    assert chunk.cap("a" * 10 + "\n" + "b" * 3000) == ["a" * 10]
    assert chunk.cap("a" * 10 + "\n" + "b" * 3000, lossless=True) == ["a" * 10, "b" * 3000]


def test_pages():
    pages = ["first page about apples", "second page about quite other things", "third"]
    assert chunk.page_of("about quite other things", pages) == 2
    assert chunk.page_of("zzz yyy", pages) is None and chunk.page_of("first page", pages[:1]) is None


def test_chunk_documents(spark):
    docs = spark.createDataFrame(
        [("/a/x.txt", "text", "one two\n\nthree", ["one two", "three four"], {"k": "v"}), ("/a/blank.txt", "text", " \n ", None, None), ("/a/null.txt", "text", None, None, None)],
        "file_path string, file_type string, content string, pages array<string>, metadata map<string,string>")
    got = chunk.chunk_documents(docs).collect()
    assert [(r.text, r.chunk_index, r.total_chunks, r.metadata) for r in got] == [("one two\n\nthree", 0, 1, '{"k": "v", "page": 1}')]
    assert [r.chunk_id for r in got] == [r.chunk_id for r in chunk.chunk_documents(docs).collect()]


def test_batches_of_documents_are_small(spark):
    docs = spark.range(1000).selectExpr("concat('/a/', id) file_path", "'text' file_type", "concat('text ', id) content", "cast(null as array<string>) pages", "cast(null as map<string,string>) metadata").coalesce(1)
    assert chunk.chunk_documents(docs).count() == 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= chunk.BATCH_ROWS
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= chunk.BATCH_BYTES
