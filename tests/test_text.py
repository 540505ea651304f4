import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.functions.vectors import l2_normalize
from corpusq.operators.chunk import estimate
from corpusq.operators.rag import annotate_citations


def value(spark, column, *row):
    return spark.createDataFrame([row], ", ".join(f"c{i} {'string' if isinstance(x, str) or x is None else 'long'}" for i, x in enumerate(row))).select(column).first()[0]


@pytest.mark.parametrize("text", ["", "plain words here", "质量 mixed TEXT 12!", "日本語テキスト", "한국어  x", "a\u3000b\u00a0c", "\n\t "])
def test_estimates(spark, text):
    wide = sum(any(a <= ord(c) <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF))) for c in text)
    other = sum(not c.isspace() for c in text) - wide
    assert value(spark, tx.budget_tokens(F.col("c0")), text) == (int(wide * 1.5 + other * 0.25) + 1 if text else 0)
    assert value(spark, tx.chunk_tokens(F.col("c0")), text) == estimate(text)


@pytest.mark.parametrize(("path", "want"), [("/a/b.PDF", ("b.PDF", "pdf", "b", "a", "pdf")), ("C:\\x\\y.tar.gz", ("y.tar.gz", "gz", "y.tar", "x", "other")), ("noext", ("noext", "", "noext", "", "other")), (".hidden", (".hidden", "", ".hidden", "", "other")), ("/k/d.md", ("d.md", "md", "d", "k", "text"))])
def test_paths(spark, path, want):
    c = F.col("c0")
    got = spark.createDataFrame([(path,)], "c0 string").select(tx.basename(c), tx.extension(c), tx.stem(c), tx.parent_name(c), tx.file_type(c)).first()
    assert tuple(got)[:3] == want[:3] and got[4] == want[4]
    if "/" in path or "\\" in path:
        assert got[3] == want[3]


@pytest.mark.parametrize(("size", "want"), [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536 * 1024, "1.5 MB"), (5 * 1024**4, "5.0 TB"), (897280, "876.2 KB")])
def test_format_size(spark, size, want):
    assert value(spark, tx.format_size(F.col("c0")), size) == want


def test_small_functions(spark):
    assert value(spark, tx.bigrams(F.col("c0")), "abc") == ["ab", "bc"] and value(spark, tx.bigrams(F.col("c0")), "a") == []
    assert value(spark, tx.trigram_containment(F.col("c0"), F.col("c1")), "abcd", "xabcx") == 0.5
    assert value(spark, tx.clean(F.col("c0")), "\u3000 x \u00a0") == "x"
    assert value(spark, tx.tagged_text(F.col("c0")), "a<|ref|>b<|/ref|>c<|ref|>d\ne<|/ref|>") == "b\nd\ne" and value(spark, tx.tagged_text(F.col("c0")), "none") == "none"
    assert value(spark, tx.place_label(F.col("c0"), F.col("c1"), F.col("c1")), 0, 3) == ", Chunk 4/3" and value(spark, tx.place_label(F.col("c0"), F.col("c1"), F.col("c1")), 2, 3) == ", Page 2"
    names = F.create_map(F.lit(1), F.lit("a.pdf"))
    assert value(spark, annotate_citations(F.col("c0"), names), "see [1] and [2] [x]") == "see [1](指上轮「a.pdf」) and [2] [x]"
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(l2_normalize(F.col("v")).alias("v")).collect()
    assert [r.v for r in zero] == [[0.0, 0.0], [0.6, 0.8]]


def test_pieces_of_long_texts(spark):
    page = "x" * 300_000 + "abc"  # its own pieces would be counted off 300,000 times
    assert value(spark, tx.share_held(tx.trigrams(F.col("c0")), F.col("c1")), "abcd", page) == 0.5
    assert value(spark, tx.share_held(tx.trigrams(F.col("c0")), F.col("c1")), "ab", page) is None
