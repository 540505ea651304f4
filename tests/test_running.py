"""Stopping running work, progress of a stream, metadata of any shape, paths of sections."""

import time

import pytest
from pyspark.sql import functions as F

from corpusq.functions import metadata
from corpusq.operators import ingest as ing
from corpusq.operators import outline
from corpusq.operators.running import Running, Stopped
from corpusq.operators.store import ChunkStore
from corpusq.streaming import ingest as stream
from tests import doubles


def folder(path, n):
    path.mkdir()
    for i in range(n):
        (path / f"f{i}.csv").write_text(f"file,{i}\n")
    return str(path)


def test_a_running_ingest_is_stopped(spark, tmp_path):
    src, store, log = folder(tmp_path / "src", 6), ChunkStore(spark, str(tmp_path / "kb")), tmp_path / "asked"

    def never(batch):
        log.write_text("x")
        time.sleep(50)

    run = Running(spark, lambda: ing.ingest(spark, src, store, never))
    for _ in range(600):
        if log.exists():
            break
        time.sleep(0.1)
    assert log.exists() and run.thread.is_alive()
    with pytest.raises(TimeoutError):
        run.result(0.01)
    began = time.time()
    run.stop()
    assert time.time() - began < 30
    with pytest.raises(Stopped):
        run.result()
    assert store.version() == 0 and store.load().count() == 0
    # others go on, and the work can be done again
    manifest, _ = Running(spark, lambda: ing.ingest(spark, src, store, doubles.hash_embed)).result()
    assert manifest.count() == 6 and store.load().count() == 6


def test_errors_of_running_work(spark):
    def fail():
        raise KeyError("x")

    with pytest.raises(KeyError):
        Running(spark, fail).result()
    assert Running(spark, lambda: 7).result() == 7


def test_progress_is_a_table_and_a_restart_goes_on(spark, tmp_path):
    src, store = tmp_path / "src", ChunkStore(spark, str(tmp_path / "kb"))
    folder(src, 5)
    table = stream.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(table)
    try:
        go = lambda: stream.ingest_stream(spark, str(src), store, doubles.hash_embed, str(tmp_path / "checkpoint"), per_batch=2).awaitTermination()
        go()
        (src / "late.csv").write_text("late,1\n")
        go()
        for _ in range(100):  # the listener is told a little later
            if (tmp_path / "progress").exists() and table.load().count() == 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(table)
    rows = table.load().orderBy("batch").collect()
    assert [(r.batch, r.files) for r in rows] == [(0, 2), (1, 2), (2, 1), (3, 1)]
    assert sum(r.bytes for r in rows) == 5 * 7 + 7 and len({r["run"] for r in rows}) == 2
    assert store.load().count() == 6


MIXED = ['{"page": 3, "tags": ["a", "b"]}', '{"page": "12", "deep": {"k": [1, {"x": 2.5}]}}', "[1, 2]", '{"broken": ', None, "null", '"text"', '{"page": null}', ""]


def test_metadata_of_any_shape(spark):
    df = spark.createDataFrame(list(enumerate(MIXED)), "i int, metadata string")
    v = metadata.parsed(F.col("metadata"))
    got = df.select("i", metadata.value(v, "$.page", "int").alias("page"), metadata.value(v, "$.tags[1]", "string").alias("tag"), metadata.value(v, "$.deep.k[1].x", "double").alias("x"), metadata.kind(v).alias("kind")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(3, "b", None, "object"), (12, None, 2.5, "object"), (None, None, None, "array"), *[(None,) * 4] * 2, (None, None, None, "null"), (None, None, None, "value"), (None, None, None, "object"), (None,) * 4]
    told = metadata.schema(df.filter("metadata like '{\"p%' or metadata is null"))
    assert told.startswith("OBJECT<") and "page: VARIANT" in told and "tags: ARRAY<STRING>" in told
    each = {(r.i, r.key) for r in metadata.entries(df).select("i", "key").collect()}
    assert each == {(0, "page"), (0, "tags"), (1, "page"), (1, "deep"), (7, "page")}


def test_paths_of_sections(spark):
    text = "1. A\nfirst note\n1.1 B\n1.1.1 C\nsecond note\n1.1.1.1 D\n2. E\n2.1.1 F\n2.1 G\n2.1.2 H"
    rows = outline.section_paths(outline.tree_sections(spark.createDataFrame([(1, text)], "id long, text string"))).orderBy("ord").collect()
    assert [(r.number, r.parent_ord, " > ".join(r.path), r.top_ord) for r in rows] == [
        ("1", None, "A", 1), ("1.1", 1, "A > B", 1), ("1.1.1", 2, "A > B > C", 1), ("1.1.1.1", 2, "A > B > D", 1), ("2", None, "E", 5), ("2.1.1", None, "F", 6), ("2.1", 6, "F > G", 6), ("2.1.2", 7, "F > G > H", 6)]
    assert rows[0].extra == ["first note", "second note"] and rows[4].extra == []
