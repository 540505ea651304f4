"""Conversation log: sessions and their turns.

Turns are rows (id, session_id, role, content, sources, created_at), numbered within their session; the view of
sessions is derived from them and from session events.  ``SessionLog`` keeps both in tables bucketed by
session, so that the view and joins by session need no shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.functions.text import budget_tokens
from corpusq.session import cut, exists
from corpusq.settings import MAX_INPUT_TOKENS, MAX_SESSIONS, MAX_TURNS

SOURCES = "array<struct<file:string,file_path:string,snippet:string,score:double>>"


def decode_sources(turns: DataFrame) -> DataFrame:
    """``sources`` from JSON text to structs."""
    return turns.withColumn("sources", F.from_json("sources", SOURCES))


def current_sessions(events: DataFrame, turns: DataFrame) -> DataFrame:
    """id, topic, is_active, created_at, updated_at, turn_count from events (seq, session_id, kind, value, at) and turns.

    Kinds: create (value is the topic), topic, switch (makes active), close and delete.
    """
    last = lambda kinds: F.max_by(F.when(F.col("kind").isin(*kinds), F.col("value")), F.when(F.col("kind").isin(*kinds), F.col("seq")))
    flag = F.when(F.col("kind").isin("create", "switch"), 1).when(F.col("kind") == "close", 0)
    s = events.groupBy("session_id").agg(
        last(("create", "topic")).alias("topic"), F.max_by(flag, F.when(flag.isNotNull(), F.col("seq"))).alias("is_active"), F.min("at").alias("created_at"), F.max("at").alias("event_at"),
        F.max(F.col("kind") == "delete").alias("gone"), F.max(F.col("kind") == "create").alias("made"),
    ).filter("made and not gone")
    t = turns.groupBy("session_id").agg(F.count("*").alias("turn_count"), F.max("created_at").alias("turn_at"))
    return s.join(t, "session_id", "left").select(
        F.col("session_id").alias("id"), "topic", "is_active", "created_at", F.greatest("event_at", "turn_at").alias("updated_at"), F.coalesce("turn_count", F.lit(0)).alias("turn_count"))


EVENTS = "session_id string, seq long, kind string, value string, at long"
TURNS = f"session_id string, id long, role string, content string, sources {SOURCES}, created_at long"
BUCKETS = 8
#: A change of turns rewrites the slots of its sessions only.
SLOTS = 16


def _slot(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(SLOTS)).cast("int")


@dataclass
class SessionLog:
    """Sessions and turns below a folder; times are numbers that the caller gives.

    Events are appended, numbered within their session.  Turns are numbered within their session in order of time, those
    of one time in the order given, after all that it ever had; its newest ``max_turns`` stay.  After turns were added
    the oldest inactive sessions beyond ``max_sessions`` are deleted.  A limit of None is none.  A slot is replaced as a whole; one writer at a time.
    """

    spark: SparkSession
    base: str
    max_turns: int | None = MAX_TURNS
    max_sessions: int | None = MAX_SESSIONS

    def _table(self, part: str) -> str:
        """The name of the table over ``part``, which this session's catalog gets to know."""
        name = f"{part}_{hashlib.md5(self.base.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(name):
            path = f"{self.base}/{part}".replace("\\", "\\\\").replace("'", "\\'")
            columns, slots = (TURNS + ", slot int", "PARTITIONED BY (slot)") if part == "turns" else (EVENTS, "")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {slots} CLUSTERED BY (session_id) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
            if slots and exists(self.spark, f"{self.base}/{part}"):
                self.spark.catalog.recoverPartitions(name)
        return name

    def _events(self) -> DataFrame:
        return self.spark.table(self._table("events"))

    def append_events(self, events: DataFrame) -> None:
        """Rows (session_id, kind, value, at) of any number of sessions."""
        new = events.select(F.col("session_id").cast("string").alias("session_id"), "kind", "value", F.col("at").cast("long").alias("at"), F.monotonically_increasing_id().alias("_p"))
        before = self._events().groupBy("session_id").agg(F.max("seq").alias("_top"))
        number = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "_p"))  # the events of one session
        numbered = new.join(before, "session_id", "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + number)
        rows = cut(numbered.select("session_id", "seq", "kind", "value", "at"))
        rows.repartition(BUCKETS, "session_id").write.insertInto(self._table("events"))

    def append_turns(self, turns: DataFrame) -> None:
        """Rows (session_id, role, content, at), and sources if there are."""
        sources = F.col("sources").cast(SOURCES) if "sources" in turns.columns else F.lit(None).cast(SOURCES)
        new = cut(turns.select(F.col("session_id").cast("string").alias("session_id"), "role", "content", sources.alias("sources"), F.col("at").cast("long").alias("created_at"), F.monotonically_increasing_id().alias("_p")).withColumn("slot", _slot(F.col("session_id"))))
        slots = [r[0] for r in new.select("slot").distinct().collect()]  # ``SLOTS`` at most
        if not slots:
            return
        table = self._table("turns")
        old = self.spark.table(table).filter(F.col("slot").isin(*slots))
        top = old.groupBy("session_id").agg(F.max("id").alias("_top"))
        facts = new.groupBy("session_id").agg(F.count("*").alias("_n")).join(top, "session_id", "left").select("session_id", (F.col("_n") + F.coalesce("_top", F.lit(0))).alias("_last"))
        # counted from the newest on, so that Spark drops what is beyond the limit before it shuffles
        back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("_p")))
        newest = new.withColumn("_back", back).filter(F.lit(True) if self.max_turns is None else F.col("_back") <= self.max_turns).join(facts, "session_id").withColumn("id", F.col("_last") - F.col("_back") + 1)
        kept = old if self.max_turns is None else old.join(facts, "session_id", "left").filter(F.col("_last").isNull() | (F.col("id") > F.col("_last") - self.max_turns))
        names = self.spark.table(table).columns
        rows = cut(kept.select(*names).unionByName(newest.select(*names)))
        conf, key = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")
        try:
            rows.repartition(BUCKETS, "session_id").write.insertInto(table, overwrite=True)
        finally:
            conf.set(key, before)
        self.enforce_limits(rows.agg(F.max("created_at")).first()[0])

    def _one(self, session_id: str, kind: str, value: str, at: int) -> None:
        self.append_events(self.spark.createDataFrame([(session_id, kind, value, at)], "session_id string, kind string, value string, at long"))

    def turns(self) -> DataFrame:
        gone = self._events().filter("kind = 'delete'").select("session_id").distinct()
        return delete_sessions(self.spark.table(self._table("turns")).drop("slot"), gone)

    def sessions(self) -> DataFrame:
        return current_sessions(self._events(), self.turns())

    def create(self, at: int, topic: str = "") -> str:
        made = uuid.uuid4().hex[:12]
        self._one(made, "create", topic, at)
        return made

    def _known(self, session_id: str) -> bool:
        kinds = self._events().filter(F.col("session_id") == session_id).agg(F.max(F.col("kind") == "create"), F.max(F.col("kind") == "delete")).first()
        return bool(kinds[0]) and not kinds[1]

    def change(self, session_id: str, kind: str, at: int, value: str = "") -> bool:
        """topic, switch, close or delete; False for a session that is not there."""
        if not self._known(session_id):
            return False
        self._one(session_id, kind, value, at)
        return True

    def active(self, at: int, session_id: str | None = None) -> str:
        """The session asked for, or without one the active one updated last; a new one where there is none."""
        found = active_session(self.sessions(), session_id).select("id").first()
        return found["id"] if found else self.create(at)

    def add_turn(self, session_id: str, role: str, content: str, at: int, sources: list[dict] | None = None) -> None:
        one = self.spark.createDataFrame([(session_id, role, content, at, [tuple(s.get(k) for k in ("file", "file_path", "snippet", "score")) for s in sources or []])], f"session_id string, role string, content string, at long, sources {SOURCES}")
        self.append_turns(one)

    def enforce_limits(self, at: int, keep: int | None = None) -> None:
        """Delete the oldest inactive sessions in excess of ``keep`` (``max_sessions``)."""
        keep = self.max_sessions if keep is None else keep
        old = None if keep is None else excess_sessions(self.sessions(), keep)
        if old is not None:
            self.append_events(old.select(F.col("id").alias("session_id"), F.lit("delete").alias("kind"), F.lit("").alias("value"), F.lit(at).alias("at")))


def session_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    return sessions.select(F.col("id").alias("session_id"), "topic").join(turns, "session_id").orderBy("session_id", "id")


def list_sessions(sessions: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(limit)


def active_session(sessions: DataFrame, session_id: str | None = None) -> DataFrame:
    """The session asked for if it exists, else the active one updated last; no row if neither."""
    if session_id is not None:
        return sessions.filter(F.col("id") == session_id)
    return sessions.filter("is_active = 1").orderBy(F.desc("updated_at"), F.desc("id")).limit(1)


def history(turns: DataFrame, session_id) -> DataFrame:
    return turns.filter(F.col("session_id") == session_id).orderBy("id")


def retained_turns(turns: DataFrame, keep: int = MAX_TURNS) -> DataFrame:
    """The newest ``keep`` turns of every session."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")


def excess_sessions(sessions: DataFrame, keep: int = MAX_SESSIONS) -> DataFrame | None:
    """The oldest inactive sessions in excess of ``keep``; None if there is no excess."""
    excess = max(0, sessions.count() - keep)
    return sessions.filter("is_active = 0").orderBy("updated_at", "id").limit(excess) if excess else None


def retained_sessions(sessions: DataFrame, keep: int = MAX_SESSIONS) -> DataFrame:
    """All but the oldest inactive sessions in excess of ``keep``."""
    old = excess_sessions(sessions, keep)
    return sessions if old is None else sessions.join(old.select("id"), "id", "left_anti")


def delete_sessions(table: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def message_tokens(turns: DataFrame) -> DataFrame:
    """session_id, messages, tokens, over_budget: 4 a message plus its estimate."""
    return turns.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(budget_tokens(F.col("content")) + 4).alias("tokens")).withColumn("over_budget", F.col("tokens") > MAX_INPUT_TOKENS)


def _label(role: Column) -> Column:
    return F.when(role == "user", "用户").otherwise("AI")


def export_markdown(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """id, markdown: each session as a document, its turns in order."""
    with_sources = turns if "sources" in turns.columns else turns.withColumn("sources", F.lit(None).cast(SOURCES))
    t = with_sources.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("id", "role", "content", "created_at", "sources"))).alias("t"))
    listed = lambda x: F.when(F.size(x["sources"]) > 0, F.concat(F.lit("**参考资料:**\n"), F.array_join(F.transform(x["sources"], lambda s: F.concat(F.lit("- "), F.coalesce(s["file"], F.lit("")))), "\n"), F.lit("\n\n"))).otherwise("")
    turn = lambda x, i: F.concat(F.lit("## ["), (i + 1).cast("string"), F.lit("] "), _label(x["role"]), F.lit(" ("), F.coalesce(x["created_at"].cast("string"), F.lit("")), F.lit(")\n\n"), F.coalesce(x["content"], F.lit("")), F.lit("\n\n"), listed(x))
    s = sessions.join(t, sessions["id"] == t["session_id"], "left")
    head = F.concat(F.lit("# 审计记录\n\n- **会话ID**: "), F.col("id").cast("string"), F.lit("\n- **主题**: "), F.coalesce(F.nullif("topic", F.lit("")), F.lit("未设置")), F.lit("\n- **开始时间**: "), F.col("created_at").cast("string"), F.lit("\n- **问答轮次**: "), F.coalesce(F.size("t"), F.lit(0)).cast("string"), F.lit("\n\n"))
    return s.select("id", F.concat(head, F.coalesce(F.array_join(F.transform("t", turn), ""), F.lit(""))).alias("markdown"))


def sessions_from_json(spark: SparkSession, path: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns of JSON files (one object or array each); sessions that exist are left out."""
    raw = spark.read.option("multiLine", True).schema(
        "session_id string, topic string, start_time string, turns array<struct<role:string,content:string,sources:array<string>,timestamp:string>>").json(path)
    if existing is not None:
        raw = raw.join(existing.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    sessions = raw.select(F.col("session_id").alias("id"), "topic", F.col("start_time").alias("created_at"), F.col("start_time").alias("updated_at"), F.lit(0).alias("is_active"), F.coalesce(F.size("turns"), F.lit(0)).alias("turn_count"))
    turns = raw.select("session_id", F.posexplode("turns").alias("pos", "t")).select("session_id", (F.col("pos") + 1).cast("long").alias("id"), "t.role", "t.content", "t.sources", F.col("t.timestamp").alias("created_at"))
    return sessions, turns
