import pytest
from pyspark.sql import functions as F

from corpusq.operators.store import ChunkStore

SCHEMA = "chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long, metadata string, vector array<float>"


def rows(spark, *items):
    return spark.createDataFrame([(f"c{i}", t, f, "text", i, 2, "{}", [3.0, 4.0]) for i, t, f in items], SCHEMA)


def texts(store):
    return sorted(r.text for r in store.load().collect())


class Stop(Exception):
    pass


def stops_at(store, step):
    """A store whose n-th write of data, or the record after them, does not happen."""
    n = 0
    put, publish = store._put, store._publish

    def once(f):
        def run(*a):
            nonlocal n
            n += 1
            if n == step:
                raise Stop
            return f(*a)
        return run

    store._put, store._publish = once(put), once(publish)
    return store


@pytest.mark.parametrize("change", ["upsert", "delete", "compact"])
def test_a_broken_change_changes_nothing(spark, tmp_path, change):
    base = str(tmp_path / "kb")
    store = ChunkStore(spark, base)
    store.upsert(rows(spark, (0, "a", "f"), (1, "b", "g")))
    store.upsert(rows(spark, (0, "A", "f")))
    act = {"upsert": lambda s: s.upsert(rows(spark, (0, "x", "f"), (2, "y", "h")), spark.createDataFrame([("g",)], "path string")), "delete": lambda s: s.delete_sources(["f"]), "compact": lambda s: s.compact()}[change]
    for step in range(1, 5):
        broken = stops_at(ChunkStore(spark, base), step)
        try:
            act(broken)
        except Stop:
            assert texts(store) == ["A", "b"], step
        else:
            break
    assert texts(store) == {"upsert": ["x", "y"], "delete": ["b"], "compact": ["A", "b"]}[change]
    store.vacuum()
    assert texts(store) == {"upsert": ["x", "y"], "delete": ["b"], "compact": ["A", "b"]}[change]


def test_a_record_that_broke_off_is_not_read(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "kb"))
    store.upsert(rows(spark, (0, "a", "f")))
    (tmp_path / "kb" / "versions" / f"{2:012d}.json").write_text('{"segments": [')
    assert texts(store) == ["a"] and store.version() == 1
    assert store.upsert(rows(spark, (1, "b", "f"))) == 3 and texts(store) == ["a", "b"]


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    first, second = (ChunkStore(spark, str(tmp_path / "kb")) for _ in range(2))
    put = second._put

    def late(*a):
        got = put(*a)
        if not first._numbers():
            first.upsert(rows(spark, (0, "a", "f")))
        return got

    second._put = late
    with pytest.raises(OSError):
        second.upsert(rows(spark, (1, "b", "f")))
    assert texts(first) == ["a"]
    with pytest.raises(OSError):
        first._publish(1, {})
    second._put = put
    second.upsert(rows(spark, (1, "b", "f")))
    assert texts(first) == ["a", "b"] and first.load().agg(F.countDistinct("rowid")).first()[0] == 2
