"""The session log: ids, limits, tables bucketed by session."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusq.operators import sessions


def turns(spark, rows):
    return spark.createDataFrame(rows, "session_id string, role string, content string, at long").coalesce(1)


def test_turns_of_one_time_have_ids_of_their_own(spark, tmp_path):
    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    one, two = log.create(1, "a"), log.create(1, "b")
    log.append_turns(turns(spark, [(one, "user", "q1", 6), (one, "assistant", "a1", 6), (two, "user", "x", 6), (one, "user", "q2", 6)]))
    log.add_turn(one, "assistant", "a2", 6)
    got = [(r.session_id, r.id, r.content) for r in log.turns().orderBy("session_id", "id").collect()]
    assert sorted(got) == sorted([(one, 1, "q1"), (one, 2, "a1"), (one, 3, "q2"), (one, 4, "a2"), (two, 1, "x")])


def test_topics_of_one_time_are_taken_in_order(spark, tmp_path):
    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    one = log.create(1, "first")
    for topic in ("second", "third", "fourth"):
        assert log.change(one, "topic", 1, topic)
    assert log.sessions().first().topic == "fourth"
    log.append_events(spark.createDataFrame([(one, "topic", f"t{i}", 1) for i in range(5)], "session_id string, kind string, value string, at long").coalesce(1))
    assert log.sessions().first().topic == "t4"


def test_retention_when_turns_are_added(spark, tmp_path):
    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    one, two = log.create(1), log.create(2)
    for part in range(6):
        log.append_turns(turns(spark, [(one, "user", f"{part * 100 + i}", 10 + part) for i in range(100)] + [(two, "user", "other", 10 + part)]))
    got = log.turns().filter(F.col("session_id") == one).orderBy("id").collect()
    assert [r.content for r in got] == [str(i) for i in range(100, 600)] and [r.id for r in got] == list(range(101, 601))
    assert log.turns().filter(F.col("session_id") == two).count() == 6
    log.append_turns(turns(spark, [(two, "user", f"{i}", 99) for i in range(1200)]))
    got = log.turns().filter(F.col("session_id") == two).orderBy("id").collect()
    assert [r.content for r in got] == [str(i) for i in range(700, 1200)] and got[-1].id == 1206
    assert {r.id: r.turn_count for r in log.sessions().collect()} == {one: 500, two: 500}


def test_sessions_beyond_the_limit_go_when_turns_are_added(spark, tmp_path):
    log = sessions.SessionLog(spark, str(tmp_path / "log"), max_sessions=3)
    ids = [log.create(n, f"t{n}") for n in range(5)]
    for i in ids[:3]:
        log.change(i, "close", 10)
    assert log.sessions().count() == 5
    log.add_turn(ids[0], "user", "q", 20)
    # two too many: the oldest inactive ones go, and ids[0] has just been used
    assert {r.id for r in log.sessions().collect()} == {ids[0], ids[3], ids[4]}
    assert not log.change(ids[1], "switch", 30)


def test_the_view_needs_no_shuffle(spark, tmp_path):
    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    ids = [log.create(n, f"t{n}") for n in range(20)]
    log.append_turns(turns(spark, [(i, "user", "q", 5) for i in ids]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (log.sessions(), sessions.session_turns(log.sessions(), log.turns()).orderBy("session_id"), log.turns().groupBy("session_id").count()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan, plan
            assert df.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("fresh", [False, True])
def test_a_log_is_found_again(spark, tmp_path, fresh):
    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    one = log.create(1, "kept")
    log.add_turn(one, "user", "q", 2, [{"file": "f", "file_path": "/f", "snippet": "s", "score": 1.0}])
    if fresh:  # a catalog that does not know the tables
        for part in ("events", "turns"):
            spark.sql(f"DROP TABLE {log._table(part)}")
    again = sessions.SessionLog(spark, str(tmp_path / "log"))
    assert [(r.id, r.topic, r.turn_count) for r in again.sessions().collect()] == [(one, "kept", 1)]
    again.add_turn(one, "user", "r", 3)
    assert [(r.id, r.content) for r in again.turns().orderBy("id").collect()] == [(1, "q"), (2, "r")]
    assert again.turns().filter("id = 1").first().sources[0].file == "f"


def test_empty_appends(spark, tmp_path):
    log = sessions.SessionLog(spark, str(tmp_path / "log"))
    log.append_turns(turns(spark, []))
    assert log.turns().count() == 0 and log.sessions().count() == 0 and isinstance(spark, SparkSession)
