"""Streams over several files and micro-batches."""

from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from stepline.session import scratch_path
from stepline.streaming import decisions as S
from stepline.streaming.sessions import PIECE, Sessions, closed_sessions, cut, read
from stepline.streaming.versions import POINTER, VersionedTable

SCHEMA = "session long, step_id long, ts timestamp, request string, operation string"


def test_repeats_are_told_by_every_part_and_null(spark):
    start = datetime(2024, 1, 1)
    keys = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("a", ""), ("a|b", "c"), (None, "a")]
    rows = [(1, i, start + timedelta(minutes=i), r, o) for i, (r, o) in enumerate(keys)]
    path = scratch_path(spark, "repeats")
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    kept = S.drain(S.drop_repeats(stream, ["request", "operation"]).select("request", "operation"), "kept")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(set(keys), key=str)


LOG = "session long, step_id long, ts timestamp, operation string, reason string"


def log_of(spark, name, batches):
    """A log of one file per batch, as a stream that reads one file at a time."""
    path = scratch_path(spark, name)
    start = datetime(2024, 1, 1)
    for k, batch in enumerate(batches):
        rows = [(s, i, None if m is None else start + timedelta(minutes=m), op, why) for s, i, m, op, why in batch]
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    return stream, start


def test_sessions_close_by_last_decision_or_silence_over_batches(spark):
    batches = [
        [(1, 1, 0, "CLICK", "a"), (1, 2, 1, "DONE", "b"), (1, 3, 2, "CLICK", "c"), (2, 10, 0, "CLICK", None), (None, 99, 0, "DONE", ""), (3, 98, None, "DONE", "")],
        [(1, 5, 9, "BLOCKED", "e"), (2, 11, 70, "TYPE_TEXT", "x"), (4, 40, 20, "CLICK", "first")],
        # out of order but not late: the third decision of session 1 stands between two that came before
        [(1, 4, 60, "CLICK", "d"), (2, 12, 75, "DONE", "y"), (4, 41, 65, "DONE", "second")],
        [(5, 50, 400, "CLICK", "moves the watermark")],
        # late: the run it belongs to is over
        [(1, 6, 3, "CLICK", "late"), (5, 51, 401, "CLICK", "open")],
    ]
    stream, start = log_of(spark, "sessions", batches)
    out = S.drain(closed_sessions(stream, 1800, "60 minutes"), "closed", own_state=True).orderBy("session", "opened").collect()
    got = [(r.session, r.closed_by, [d.step_id for d in r.decisions], [d.reason for d in r.decisions], int((r.ended - start).total_seconds() // 60)) for r in out]
    assert got == [
        (1, "DONE", [1, 2], ["a", "b"], 1),
        (1, "BLOCKED", [3, 5], ["c", "e"], 9),
        (1, "silence", [4], ["d"], 60),
        (2, "silence", [10], [None], 0),
        (2, "DONE", [11, 12], ["x", "y"], 75),
        (4, "silence", [40], ["first"], 20),
        (4, "DONE", [41], ["second"], 65),
    ]


def test_cut_waits_for_the_watermark():
    rows = [(0, 1, "CLICK"), (60_000_000, 2, "DONE"), (60_000_000, 3, "CLICK")]
    assert cut(rows, 60_000, 1000) == ([("silence", rows[:1])], rows[1:], 60_000)
    assert cut(rows, 60_001, 1000) == ([("silence", rows[:1]), ("DONE", rows[1:2])], rows[2:], 61_000)
    assert cut(rows, 61_001, 1000)[1:] == ([], None)


def test_versions_are_whole_for_readers_and_replays(spark):
    path = scratch_path(spark, "versions")
    table = VersionedTable(spark, path, ["k"], "k string, n long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    batch = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    assert rows(table.read()) == []
    assert table.update(batch(("a", 1), (None, 1)), 0)
    reader = table.read()  # has found its version, reads it later
    assert table.update(batch(("a", 2), ("b", 1)), 1)
    assert rows(reader) == [("a", 1), (None, 1)]
    whole = [("a", 2), ("b", 1), (None, 1)]
    assert rows(table.read()) == sorted(whole, key=str)
    # the same batch again, as after a restart, and an older one
    assert not table.update(batch(("a", 2), ("b", 1)), 1) and not table.update(batch(("a", 1)), 0)
    assert rows(table.read()) == sorted(whole, key=str)

    class Fails(VersionedTable):
        def _name(self, *args):
            raise RuntimeError("lost before the pointer moved")

    try:
        Fails(spark, path, ["k"], "k string, n long").update(batch(("a", 9)), 2)
    except RuntimeError:
        pass
    assert rows(table.read()) == sorted(whole, key=str) and table.current()[0] == 1
    assert table.update(batch(("a", 3)), 2) and rows(table.read()) == sorted([("a", 3), ("b", 1), (None, 1)], key=str)
    assert table.update(batch(("c", 1)), 3) and len(table.current()[1]) == 2
    assert POINTER.startswith("_")  # readers of folders skip it


def test_update_mode_over_batches_equals_batch(spark):
    stream, _ = log_of(spark, "counts", [[(1, i, i, "CLICK" if i % 3 else "DONE", "") for i in range(k, 40, 4)] for k in range(4)])
    got = S.drain(S.running_counts(stream, ["operation"]), "counts", ["operation"])
    assert sorted(map(tuple, got.collect())) == [("CLICK", 26), ("DONE", 14)]
    rate = S.drain(S.running_rate(stream, "session", F.col("operation") == "DONE"), "rates", ["session"])
    assert [tuple(r) for r in rate.collect()] == [(1, 40, 0.35)]


def test_waiting_decisions_are_few_state_entries(spark):
    class Handle:
        def __init__(self):
            self.entries, self.timers = [], []

        def getListState(self, name, schema):
            return self

        def appendValue(self, entry):
            self.entries.append(entry)

        def registerTimer(self, at):
            self.timers.append(at)

    handle, sessions = Handle(), Sessions(1000)
    sessions.init(handle)
    rows = (Row(session=1, told=f'[{5_000_000 + i},{i},["{"DONE" if i == 7 else "CLICK"}",null]]') for i in range(2 * PIECE + 1))
    assert list(sessions.handleInputRows((1,), rows, None)) == []
    assert len(handle.entries) == 3 and handle.timers == [5000]
    assert [r[1] for r in read(e for (e,) in handle.entries)] == [*range(2 * PIECE + 1)]


def test_sessions_keep_odd_reasons_as_they_are(spark):
    said = ['a "b", [c]', "line\nbreak \\ é 日本", "", None, "\u2028{}"]
    batches = [[(1, i, i, "CLICK", r) for i, r in enumerate(said)], [(2, 50, 400, "CLICK", "moves the watermark")], [(2, 51, 500, None, "later")]]
    stream, _ = log_of(spark, "odd-reasons", batches)
    (run,) = S.drain(closed_sessions(stream, 1800, "60 minutes"), "odd-closed", own_state=True).where("session = 1").collect()
    assert [(d.step_id, d.operation, d.reason) for d in run.decisions] == [(i, "CLICK", r) for i, r in enumerate(said)]
