"""The stream of file statuses: state by groups of files, against a plain fold of each file's events."""

from datetime import datetime, timedelta

from corpusq.streaming import states

SCHEMA = "path string, seq long, ts timestamp, status string"
T0 = datetime(2024, 1, 1, 12)


def expected(rows, patience, now):
    """Changes of each file's events, which come in order of time, and files stuck at the time ``now``."""
    out, held = [], {}
    for path, seq, ts, to in sorted(rows, key=lambda r: (r[2] is None, r[2] or T0, r[1])):
        status, since, told = held.get(path, ("", None, True))
        if ts is None:
            out.append((path, seq, ts, status, to, "illegal"))
            continue
        if status in states.UNFINISHED and not told and ts > since + patience:
            out.append((path, None, since + patience, status, status, "stuck"))
            told = True
        moved = to in states.MOVES[status]
        out.append((path, seq, ts, status, to, "moved" if moved else "illegal"))
        held[path] = (to, ts, False) if moved else (status, since, told)
    return out + [(p, None, since + patience, s, s, "stuck") for p, (s, since, told) in held.items() if s in states.UNFINISHED and not told and since + patience <= now]


def test_state_is_kept_by_groups_of_files(spark, tmp_path):
    statuses = [*states.MOVES, "no such status", None][1:]
    rows = [(f"/f{i % 97}" if i % 97 else None, i, T0 + timedelta(minutes=i // 7 * 3), statuses[i * i % 31 % len(statuses)]) for i in range(1500)]
    rows += [(f"/new{i}", 2000 + i, T0 + timedelta(minutes=400 + i), "pending") for i in range(40)]
    cuts = [T0 + timedelta(minutes=300), T0 + timedelta(minutes=520), None]
    low, total = None, None
    for high in cuts:
        some = [r for r in rows if (low is None or r[2] > low) and (high is None or r[2] <= high)]
        if high is None:
            some += [("/f5", 9000, None, "pending"), (None, 9001, None, None)]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        q = states.start_states(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/events"), f"{tmp_path}/changes", f"{tmp_path}/checkpoint", "90 minutes", groups=5)
        q.awaitTermination()
        total = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
        low = high
    assert total == 5  # a call and a row of state a group, for 137 files
    got = [tuple(r) for r in spark.read.schema(states.CHANGES).parquet(f"{tmp_path}/changes").collect()]
    want = expected(rows + [("/f5", 9000, None, "pending"), (None, 9001, None, None)], timedelta(minutes=90), max(r[2] for r in rows))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_event_older_than_the_last_is_late(spark, tmp_path):
    """Within what the watermark lets through, an event before a file's last one is told apart and changes nothing."""
    base = f"{tmp_path}/events"
    for rows in ([("/a", 2, T0, "pending"), ("/b", 1, T0, "pending")], [("/a", 1, T0 - timedelta(minutes=1), "parsing"), ("/b", 3, T0 + timedelta(seconds=1), "parsing")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(base)
        found = states.file_states(spark.readStream.schema(SCHEMA).parquet(base), late="10 minutes", groups=1)
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = sorted((r.path, r.seq, r.before, r.status, r.verdict) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert changes == [("/a", 1, "pending", "parsing", "late"), ("/a", 2, "", "pending", "moved"), ("/b", 1, "", "pending", "moved"), ("/b", 3, "pending", "parsing", "moved")]
