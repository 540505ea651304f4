"""A whole scan: outline to report, all sections in one pass."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from corpusq.operators import analysis, fulltext, outline, search
from corpusq.session import shared_dir

ROWS = [(1, "质量 管理 notes", "/kb/质量.docx"), (2, "foo-bar baz", "/kb/a.txt"), (3, "bar foo 质量管理体系", "/kb/a.txt"), (4, "nothing", "/kb/b.txt"), (5, None, None), (6, "", "/kb/c.txt")]
OUTLINE = 'preamble\n1. Foo-Bar\n质量管理 "baz"\n2. absent\nmore words\n3. 质'


def tables(spark):
    c = spark.createDataFrame([(i, f"c{i}", t, p, "text", i, 6) for i, t, p in ROWS], "rowid long, chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long")
    return spark.createDataFrame([(7, OUTLINE), (8, ""), (9, None)], "id long, text string"), c


def test_sections_find_what_keyword_search_finds(spark):
    outlines, c = tables(spark)
    sections = outline.flat_sections(outlines)
    got = {}
    for r in analysis.section_hits(sections, fulltext.postings(c)).collect():
        got.setdefault((r.id, r.ord), set()).add(r.rowid)
    for s in sections.collect():
        asked = f"{s.title} {s.detail}".replace('"', " ")  # quotes are punctuation in an outline
        assert got.get((s.id, s.ord), set()) == {r.rowid for r in search.exhaustive_search(c, asked).collect()}, asked
    assert got == {(7, 1): {1, 2}}


def test_report(spark):
    outlines, c = tables(spark)
    asked = []
    sections, documents = analysis.scan(outlines, c, lambda prompt: f"<{prompt}>" if "Foo-Bar" in prompt else None)
    told = {(r.id, r.ord): (r.title, r.files, r.body) for r in sections.collect()}
    assert told[7, 1][1] == 2 and told[7, 1][2].startswith('<1. Foo-Bar\n质量管理 "baz"\n\n【') and "foo-bar baz" in told[7, 1][2]
    assert told[7, 2] == ("2. absent", 0, analysis.NO_FILES) and asked == []
    whole = {r.id: r for r in documents.collect()}
    assert whole[7].document == "\n\n".join(f"## {t}\n\n{b}\n" for _, (t, _, b) in sorted((k, v) for k, v in told.items() if k[0] == 7))
    assert whole[7].files == 2 and {s.file for s in whole[7].sources} == {"质量.docx", "a.txt"}
    assert whole[8].document == whole[9].document == analysis.NOTHING and whole[8].sources == []


def test_one_pass_for_any_number_of_sections(spark, tmp_path):
    _, c = tables(spark)
    fulltext.postings(c).write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    many = spark.createDataFrame([(1, "\n".join(f"{i}. word{i} foo" for i in range(50)))], "id long, text string")
    hits = analysis.section_hits(outline.flat_sections(many), stored)
    assert hits._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert hits.count() == 100


def long_file(spark):
    rows = [(i, f"foo{' bar' * (i % 2)} {''.join(hashlib.sha512(f'{i} {j}'.encode()).hexdigest() for j in range(16))}" if i % 11 else None, "/kb/foo.txt" if i < 90 else "/kb/short foo.txt", i, 100) for i in range(100)]
    return spark.createDataFrame(rows, "rowid long, text string, source_file string, chunk_index long, total_chunks long")


def test_texts_read_by_block_are_the_context_of_each_file(spark):
    c = long_file(spark)
    sections = spark.createDataFrame([(1, 1, "foo", ""), (1, 2, "bar", ""), (2, 1, "short", "")], "id long, ord long, title string, detail string")
    hits = analysis.section_hits(sections, fulltext.postings(c)).join(c.withColumn("size", F.coalesce(F.length("text"), F.lit(0))), "rowid")
    key, digest = ("id", "ord", "source_file"), lambda prompt: hashlib.md5(prompt.encode()).hexdigest() if len(prompt) % 3 else None
    want = sorted(map(tuple, analysis.file_context(hits, digest, key).select(*key, "content").collect()))
    assert len(want) == 5
    for block in (1, 7, 1000):
        assert sorted(map(tuple, analysis.hits_context(hits.drop("text"), c, digest, key, block=block).select(*key, "content").collect())) == want


def test_what_is_kept_does_not_grow_with_the_sections(spark):
    c = long_file(spark)
    outlines = spark.createDataFrame([(1, "\n".join(f"{i}. foo" for i in range(40)))], "id long, text string")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    used = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = used()
    sections, _ = analysis.scan(outlines, c, lambda prompt: "said")
    assert {r.files for r in sections.collect()} == {2}
    texts = c.agg(F.sum(F.length("text"))).first()[0]  # each section hits nearly all of them
    assert used() - before < 5 * texts
