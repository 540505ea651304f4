"""Statuses of files as a stream with state: which moves are allowed, which were not, and which files are stuck.

Events (path, seq, ts, status) of a file are applied in order of (ts, seq).  A move that ``MOVES`` allows changes the file's
status; any other is reported as illegal and changes nothing.  A file that stays in an unfinished status for longer than
``patience`` is reported once as stuck, by a timer of event time, or by its next event if that comes first.

Micro-batches have to come in order of time; within one the order is made here.  An event older than the file's last
one, which only happens when they do not, is reported as late.  A null path is a file of its own; an event without status or ts is illegal.

Spark's cost for a call in Python with state is a thousand times that for an event, so the state that Spark keeps is that of a group of
files, by a hash of their paths, and one call takes the events of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

#: The statuses a file may take after each; a file begins with none.
MOVES = {
    "": ("pending", "duplicate"),
    "pending": ("parsing", "cancelling"),
    "parsing": ("parsed", "error", "cancelling", "cancelled", "pending"),
    "parsed": ("embedding", "error", "cancelling"),
    "embedding": ("embedded", "error", "cancelling"),
    "cancelling": ("cancelled",),
    "embedded": ("pending",),
    "duplicate": ("pending",),
    "error": ("pending",),
    "cancelled": ("pending",),
}
GROUPS = 1024
UNFINISHED = ("pending", "parsing", "parsed", "embedding", "cancelling")
CHANGES = "path string, seq long, at timestamp, before string, status string, verdict string"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]
_STATE = "paths array<string>, statuses array<string>, since array<long>, last array<long>, seq array<long>, told array<boolean>"
#: In Python a missing time is after all others, as events without one are sorted last; a missing seq is before all others.
_NEVER, _NO_SEQ = (1 << 63) - 1, -(1 << 63)


def _apply(patience: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """A function of a group's events of a micro-batch, or of its timer, and its state; times are in microseconds, timers in milliseconds."""

    def apply(key: tuple, given: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {path: tuple(rest) for path, *rest in zip(*state.get)} if state.exists else {}
        events = [] if state.hasTimedOut else sorted((x for some in given for x in zip(*[some[c].tolist() for c in ("us", "seq", "path", "status")])), key=lambda x: x[:2])
        out: list[tuple] = []
        for at, seq, path, to in events:
            status, since, last, last_seq, told = held.get(path, ("", -1, -1, -1, True))
            if at == _NEVER:
                out.append((path, seq, at, status, to, "illegal"))
                continue
            if (at, seq) < (last, last_seq):
                out.append((path, seq, at, status, to, "late"))
                continue
            if not told and status in UNFINISHED and at > since + patience:
                out.append((path, _NO_SEQ, since + patience, status, status, "stuck"))
                told = True
            if to in MOVES[status]:
                out.append((path, seq, at, status, to, "moved"))
                status, since, told = to, at, False
            else:
                out.append((path, seq, at, status, to, "illegal"))
            held[path] = (status, since, at, seq, told)
        now, first = state.getCurrentWatermarkMs(), None
        for path, (status, since, last, last_seq, told) in held.items():
            if status in UNFINISHED and not told:
                ends = since // 1000 + patience // 1000
                if ends <= now:
                    out.append((path, _NO_SEQ, since + patience, status, status, "stuck"))
                    held[path] = (status, since, last, last_seq, True)
                elif first is None or ends < first:
                    first = ends
        if held:
            state.update((list(held), *map(list, zip(*held.values()))))
        if first is not None:
            state.setTimeoutTimestamp(first - 1)  # a timer runs out when the watermark is after it
        yield pd.DataFrame(dict(zip(_NAMES, zip(*out))) if out else {n: [] for n in _NAMES})

    return apply


def file_states(events: DataFrame, patience: str = "1 hour", late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """The changes (path, seq, at, before, status, verdict) of a stream of events (path, seq, ts, status).

    ``groups`` is how many groups the files are dealt out to; some 64 files in each are enough to make calls
    cheap, and a thousand times as many still fit a task.  It is fixed for the life of a checkpoint.
    """
    given = events.select("path", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late)
    given = given.select(F.pmod(F.xxhash64("path"), F.lit(groups)).alias("files"), "path", F.coalesce("seq", F.lit(_NO_SEQ)).alias("seq"), "ts", F.coalesce(F.unix_micros("ts"), F.lit(_NEVER)).alias("us"), "status")
    micros = int(pd.Timedelta(patience).value // 1000)
    found = given.groupBy("files").applyInPandasWithState(_apply(micros), CHANGES.replace("at timestamp", "at long"), _STATE, "append", "EventTimeTimeout")
    at, seq = F.col("at"), F.col("seq")
    return found.withColumns({"seq": F.when(seq != _NO_SEQ, seq), "at": F.when(at != _NEVER, F.timestamp_micros(at))})


def start_states(events: DataFrame, target: str, checkpoint: str, patience: str = "1 hour", groups: int = GROUPS) -> StreamingQuery:
    """Write ``file_states`` as Parquet to ``target``; state is kept by the RocksDB store, which this query alone is told to use."""
    conf, key = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return file_states(events, patience, groups=groups).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
