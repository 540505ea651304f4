import os
import time
import uuid
import zipfile

import pytest

from corpusq.operators import ingest as ing
from corpusq.operators import search, status
from corpusq.operators.store import ChunkStore, Libraries
from corpusq.sources import files, parsers
from corpusq.streaming import ingest as stream
from tests import doubles


def put(folder, **names):
    folder.mkdir(exist_ok=True)
    for name, text in names.items():
        (folder / f"{name}.csv").write_text(text)


def texts(store):
    return sorted(r.text for r in store.load().collect())


def test_ingest_is_incremental(spark, tmp_path):
    src, store = tmp_path / "src", ChunkStore(spark, str(tmp_path / "kb"))
    put(src, a="one,1\n", b="two,2\n", copy="one,1\n")
    manifest, state = ing.ingest(spark, str(src), store, doubles.hash_embed)
    manifest = spark.createDataFrame(manifest.collect(), ing.MANIFEST)
    assert {r.path.rsplit("/", 1)[1]: r.status for r in state.collect()} == {"a.csv": "embedded", "b.csv": "embedded", "copy.csv": "duplicate"}
    assert texts(store) == ["one\t1", "two\t2"] and store.status()["vectors"] == 2
    version = store.status()["version"]
    again, _ = ing.ingest(spark, str(src), store, doubles.hash_embed, manifest)
    assert store.status()["version"] == version and again.count() == 2
    put(src, a="changed,1\n", c="three,3\n")
    again, state = ing.ingest(spark, str(src), store, doubles.hash_embed, manifest)
    assert texts(store) == ["changed\t1", "three\t3", "two\t2"] and again.count() >= 3
    assert [r.text for r in store.load(version).orderBy("rowid").collect()] == ["one\t1", "two\t2"]
    hits = search.search(store.load(), "three", "hybrid", lambda q: doubles.hash_embed([q])[0], 2).collect()
    assert hits[0].text == "three\t3"


def test_errors_and_retry(spark, tmp_path):
    src, store = tmp_path / "src", ChunkStore(spark, str(tmp_path / "kb"))
    put(src, good="x,y\n", empty="\n")
    (src / "bad.docx").write_bytes(b"PKno")
    manifest, state = ing.ingest(spark, str(src), store, doubles.hash_embed)
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.error is not None) for r in state.collect()}
    assert got == {"good.csv": ("embedded", False), "empty.csv": ("parsed", False), "bad.docx": ("error", True)}
    path = next(r.path for r in state.collect() if r.path.endswith("good.csv"))
    manifest = spark.createDataFrame(manifest.collect(), ing.MANIFEST)
    after, state = ing.retry_file(spark, path, store, doubles.hash_embed, manifest)
    assert [r.status for r in state.collect()] == ["embedded"] and texts(store) == ["x\ty"] and after.count() == 1


class Answer(Exception):
    def __init__(self, code):
        self.code = code


def test_embedding_failures(spark, tmp_path):
    """Only a 413 halves the texts; a busy service gets the same texts again; other codes are final."""
    df = spark.createDataFrame([("c", "x" * 35)] * 3, "chunk_id string, text string").coalesce(1)

    def vectors(*codes):
        calls, log = list(codes), str(tmp_path / uuid.uuid4().hex)

        def embed(batch):
            with open(log, "a") as f:
                f.write(f"{max(map(len, batch))}\n")
            code = calls.pop(0) if calls else None
            if code is not None:
                raise code if isinstance(code, Exception) else Answer(code)
            return [[float(len(t)), 0.0] for t in batch]

        got = [r.vector and r.vector[0] for r in ing.embed_chunks(df, embed, sleep=lambda s: open(log, "a").write(f"wait {s:g}\n")).collect()]
        return got, open(log).read().split("\n")[:-1]

    assert vectors() == ([35.0] * 3, ["35"])
    assert vectors(503, TimeoutError()) == ([35.0] * 3, ["35", "wait 1", "35", "wait 2", "35"])
    assert vectors(413) == ([17.0] * 3, ["35", "17"])
    assert vectors(413, 413) == ([None] * 3, ["35", "17"])
    assert vectors(429, 429, 500) == ([None] * 3, ["35", "wait 1", "35", "wait 2", "35"])
    assert vectors(401) == ([None] * 3, ["35"])


def slow_parser(name, data, context):
    if name.startswith("hang"):
        time.sleep(600)
    if name.startswith("die"):
        os._exit(1)
    if name.startswith("bad"):
        raise ValueError("broken")
    return parsers.Parsed(data.decode(), [], {})


def test_a_file_that_hangs_costs_itself_only(spark):
    names = ["a.csv", "hang1.csv", "b.csv", "die.csv", "c.csv", "bad.csv", "hang2.csv", "d.csv", "none.xyz"]
    given = spark.createDataFrame([(f"/k/{n}", n.encode()) for n in names], "path string, content binary").coalesce(1)
    began = time.time()
    got = {r.file_name: (r.content, r.error) for r in files.parse_files(given, known={"csv": slow_parser}, seconds=(1.5, 1.5)).collect()}
    assert time.time() - began < 60
    assert {n: got[n] for n in ("a.csv", "b.csv", "c.csv", "d.csv")} == {n: (n, None) for n in ("a.csv", "b.csv", "c.csv", "d.csv")}
    assert got["hang1.csv"] == got["hang2.csv"] == (None, "timeout: over 1.5 s")
    assert got["die.csv"][1].startswith("ChildDied") and got["bad.csv"] == (None, "ValueError: broken") and got["none.xyz"][1] == "ValueError: no parser for .xyz"


def test_failed_files_of_runs(spark, tmp_path):
    """A run saves what failed, a retry with success takes it out, one without keeps it."""
    src = tmp_path / "src"
    put(src, good="x\n")
    (src / "bad.docx").write_bytes(b"PKno")
    (src / "worse.docx").write_bytes(b"PKworse")
    store, kept = ChunkStore(spark, str(tmp_path / "store")), status.FailedFiles(spark, str(tmp_path / "failed"))
    manifest, state = ing.ingest(spark, str(src), store, doubles.hash_embed, failed=kept)
    assert sorted((r.group, r.name) for r in kept.load().collect()) == [("parse_error", "bad.docx"), ("parse_error", "worse.docx")]
    manifest = spark.createDataFrame(manifest.collect(), ing.MANIFEST)
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in state.collect()}
    again = lambda name: ing.retry_file(spark, paths[name], store, doubles.hash_embed, manifest, parsers.Context(), failed=kept)
    again("worse.docx")
    assert sorted(r.name for r in kept.load().collect()) == ["bad.docx", "worse.docx"]
    with zipfile.ZipFile(src / "bad.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p><w:r><w:t>mended</w:t></w:r></w:p></w:document>")
    again("bad.docx")
    assert [r.name for r in kept.load().collect()] == ["worse.docx"] and "mended" in texts(store)


def test_store_and_libraries(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "kb"))
    row = lambda i, text, f="f": (f"c{i}", text, f, "text", i, 2, "{}", [3.0, 4.0])
    schema = "chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long, metadata string, vector array<float>"
    assert store.load().collect() == []
    store.upsert(spark.createDataFrame([row(0, "a"), row(1, "b")], schema))
    store.upsert(spark.createDataFrame([row(1, "B"), row(2, "c", "g")], schema))
    assert texts(store) == ["B", "a", "c"] and [round(x, 6) for x in store.load().first().vector] == [0.6, 0.8]
    store.delete_sources(["g"])
    assert texts(store) == ["B", "a"]
    store.upsert(spark.createDataFrame([row(2, "c2", "g")], schema))
    store.compact()
    assert texts(store) == ["B", "a", "c2"] and store._record()[1]["deletes"] == []
    store.vacuum()
    assert texts(store) == ["B", "a", "c2"] and len(store._numbers()) == 1
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("n", "t", "f", "text", 0, 1, "{}", [1.0])], schema))
    store.clear()
    assert store.load().collect() == []

    libs = Libraries(spark, str(tmp_path / "libs"))
    libs.create("Main")
    for bad in ("main", " MAIN ", "..", "a/b", ""):
        with pytest.raises(ValueError):
            libs.create(bad)
    with pytest.raises(ValueError):
        libs.delete("main")
    libs.create("Other")
    libs.delete("MAIN")
    assert libs.names() == ["Other"] and libs.open().base.endswith("Other")


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    put(src, a="one,1\n", b="two,2\n", copy="one,1\n")
    batch, store = ChunkStore(spark, str(tmp_path / "batch")), ChunkStore(spark, str(tmp_path / "stream"))
    ing.ingest(spark, str(src), batch, doubles.hash_embed)
    run = lambda: stream.ingest_stream(spark, str(src), store, doubles.hash_embed, str(tmp_path / "ck"), per_batch=2).awaitTermination()
    run()
    assert texts(store) == texts(batch)
    put(src, d="four,4\n")
    run()
    assert texts(store) == sorted([*texts(batch), "four\t4"]) and stream.read_manifest(store).count() == 3


def test_event_streams(spark, tmp_path):
    events = spark.createDataFrame([(i, f"/f{i % 3}", ("pending", "parsed", "embedded")[i // 3 % 3]) for i in range(9)], "seq long, path string, status string")
    events.write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = stream.status_stream(live).writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    assert {r.path: (r.status, r.events) for r in spark.sql("select * from states").collect()} == {f"/f{i}": ("embedded", 3) for i in range(3)}


def test_long_chunks_are_ingested_whole(spark, tmp_path):
    src, store = tmp_path / "src", ChunkStore(spark, str(tmp_path / "kb"))
    words = [f"word{i}." for i in range(900)]
    put(src, long=" ".join(words) + "\n")
    ing.ingest(spark, str(src), store, doubles.hash_embed)
    got = [r.text for r in store.load().orderBy("chunk_index").collect()]
    assert len(got) > 1 and "".join("".join(got).split()) == "".join(words)
    cut = ChunkStore(spark, str(tmp_path / "cut"))
    ing.ingest(spark, str(src), cut, doubles.hash_embed, lossless=False)
    assert cut.load().count() == 1
