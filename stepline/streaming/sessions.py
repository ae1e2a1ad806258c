"""Sessions of a decision log, closed by their last decision or by silence, as a stateful stream.

A session key's decisions wait in state until the watermark has passed them, so late rows still
find their place; event-time timers say when a run can be over. What comes out does not depend
on how the log was cut into batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAST = ("DONE", "BLOCKED")  # operations that end a session

# an entry is a JSON list of decisions [at, step_id, [operation, reason]], not one of them: converting values one by one costs more than all else
WAITING = "told string"
PIECE = 10_000  # decisions of an entry at most
CLOSED = "session long, opened_us long, ended_us long, closed_by string, n_decisions long, step_id array<long>, operation array<string>, reason array<string>"


def cut(rows: list[tuple], watermark: int, gap: int) -> tuple[list[tuple[str, list[tuple]]], list[tuple], int | None]:
    """Runs that are over, the rows that wait on, and the time (ms) from which more may be over.

    rows are (at: microseconds, step_id, operation, ...); a run ends with an operation of LAST or
    where nothing follows within gap ms, and is over once the watermark (ms) is past that.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    over, start = [], 0
    for i, row in enumerate(rows):
        now = row[0] // 1000
        if row[2] in LAST:
            due, why = now, row[2]
        elif i + 1 == len(rows) or rows[i + 1][0] - row[0] > gap * 1000:
            due, why = now + gap, "silence"
        else:
            continue
        if due >= watermark:
            return over, rows[start:], due
        over.append((why, rows[start : i + 1]))
        start = i + 1
    return over, [], None


def read(told: Iterable[str]) -> list[tuple]:
    """(at, step_id, operation, reason) of all entries."""
    return [(at, step_id, operation, reason) for entry in told for at, step_id, (operation, reason) in json.loads(entry)]


class Sessions(StatefulProcessor):
    """Collects the decisions of a session and gives each finished run once."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for piece in batched(rows, PIECE):
            entry = f"[{','.join([r.told for r in piece])}]"
            self.waiting.appendValue((entry,))
            at, _, operation, _ = zip(*read([entry]), strict=True)
            ends = [t for t, op in zip(at, operation, strict=True) if op in LAST]
            for due in (min(at) // 1000 + self.gap, *([min(ends) // 1000] if ends else ())):
                first = due if first is None else min(first, due)
        # the list is read when something may be over, not with every batch
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over, wait, due = cut(read(e for (e,) in self.waiting.get()), timerValues.getCurrentWatermarkInMs(), self.gap)
        if wait:
            if over:
                self.waiting.put([(json.dumps([(at, step_id, said) for at, step_id, *said in piece]),) for piece in batched(wait, PIECE)])
            self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        for why, run in over:
            at, step_id, operation, reason = map(list, zip(*run, strict=True))
            yield Row(session=key[0], opened_us=at[0], ended_us=at[-1], closed_by=why, n_decisions=len(run), step_id=step_id, operation=operation, reason=reason)

    def close(self) -> None:
        pass


def closed_sessions(log: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """Runs of decisions (session, ts, step_id, operation, reason), each given once, decisions in order.

    A run ends with DONE or BLOCKED, or when nothing follows within gap_seconds; it comes out when
    the watermark (the latest ts less delay) is past its end, later rows of it are dropped. Rows
    without a session or ts are left out. Equal times are ordered by step_id.
    """
    told = log.where("session is not null and ts is not null").withWatermark("ts", delay)
    one = F.concat(F.lit("["), F.unix_micros("ts"), F.lit(","), F.coalesce(F.col("step_id").cast("string"), F.lit("null")), F.lit(","), F.to_json(F.array("operation", "reason")), F.lit("]"))
    rows = told.select("session", "ts", one.alias("told"))
    closed = rows.groupBy("session").transformWithState(Sessions(gap_seconds * 1000), CLOSED, "append", "eventTime")
    times = [F.timestamp_micros(f"{c}_us").alias(c) for c in ("opened", "ended")]
    return closed.select("session", *times, "closed_by", "n_decisions", F.arrays_zip("step_id", "operation", "reason").alias("decisions"))
