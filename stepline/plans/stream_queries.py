"""Registered queries: the decision log as a stream, compared with the same result in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.operators.metrics import all_right, r6
from stepline.plans import oracle as O
from stepline.plans import views as V
from stepline.plans.registry import query
from stepline.session import scratch_path
from stepline.streaming import decisions as S
from stepline.streaming.sessions import closed_sessions


def _events(spark, folder):
    return S.file_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("decision_log_stream", O.sql("decisions", "SELECT session, step_id, operation, reason, request, 'teacher' AS actor FROM decisions"))
def decision_log_stream(spark, folder):
    """The log is written as JSON lines in several files and read back as a stream."""
    log = V.decisions(spark, folder).select(
        "session", "step_id", F.col("ts").cast("timestamp").alias("ts"), "request", "operation", "reason", F.col("k").alias("latency_ms"),
        F.create_map(F.lit("operation"), F.col("operation")).alias("labels"), F.lit("big").alias("teacher"), F.lit("teacher").alias("actor"),
    )
    path = scratch_path(spark, "log")
    log.repartition(4, "session").write.json(path)
    stream = S.log_stream(spark, path, files_per_trigger=2)
    flat = stream.select("session", "step_id", F.col("labels")["operation"].alias("operation"), "reason", "request", "actor")
    return S.drain(flat, "decision-log")


@query(
    "stream_drop_repeats",
    O.sql("decisions", "SELECT min(step_id) AS step_id, session, request, operation FROM decisions GROUP BY session, request, operation"),
)
def stream_drop_repeats(spark, folder):
    """The first step of each state of a session survives; the log comes in order, some days a batch."""
    d = V.decisions_of(V.steps_of(_events(spark, folder)))
    return S.drain(S.drop_repeats(d, ["request", "operation"]).select("step_id", "session", "request", "operation"), "first-states")


@query(
    "stream_outcome_counts",
    "SELECT CASE user_id%4 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' WHEN 2 THEN 'error' ELSE 'budget' END AS outcome, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def stream_outcome_counts(spark, folder):
    outcome = F.element_at(F.array(*[F.lit(x) for x in V.OUTCOMES]), (F.col("user_id") % 4 + 1).cast("int"))
    log = _events(spark, folder).withColumn("outcome", outcome)
    return S.drain(S.running_counts(log, ["outcome", "event_type"]), "outcomes", ["outcome", "event_type"])


@query(
    "stream_running_success",
    O.sql("qs", "SELECT subset, count(*) AS n, round(avg(ok::INT::DOUBLE),6) AS rate FROM (SELECT step_id, subset, bool_and(correct) AS ok FROM qs GROUP BY ALL) GROUP BY subset"),
)
def stream_running_success(spark, folder):
    s = V.with_questions(V.steps_of(_events(spark, folder)))
    run = S.running_rate(s.select("subset", all_right("questions").alias("ok")), "subset", F.col("ok"))
    return S.drain(run, "success", ["subset"]).select("subset", "n", r6(F.col("rate")).alias("rate"))


_GAP = 1800
_RUNS = f"""SELECT session, r, count(*) AS n_decisions, min(ts) AS opened, max(ts) AS ended, arg_max(operation, (ts, step_id)) AS last, string_agg(step_id::VARCHAR, ',' ORDER BY ts, step_id) AS step_ids,
  string_agg(operation||':'||reason, '|' ORDER BY ts, step_id) AS said FROM (
  SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, step_id) AS r FROM (
  SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY session ORDER BY ts, step_id) + INTERVAL {_GAP} SECOND
    OR lag(operation) OVER (PARTITION BY session ORDER BY ts, step_id) IN ('DONE','BLOCKED') THEN 1 ELSE 0 END AS new FROM decisions)) GROUP BY ALL"""


@query(
    "stream_session_close",
    O.sql(
        "decisions",
        f"""SELECT session, CASE WHEN last IN ('DONE','BLOCKED') THEN last ELSE 'silence' END AS closed_by, n_decisions, step_ids, said, (epoch_us(ended)-epoch_us(opened))::BIGINT AS lasted_us FROM runs
        WHERE date_trunc('millisecond', ended) + CASE WHEN last IN ('DONE','BLOCKED') THEN INTERVAL 0 SECOND ELSE INTERVAL {_GAP} SECOND END
          < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 3600 SECOND FROM decisions)""",
        runs=_RUNS,
    ),
)
def stream_session_close(spark, folder):
    """Only runs that are over, each with its decisions in order: the open ones stay in the state."""
    log = V.decisions_of(V.steps_of(_events(spark, folder)))
    closed = S.drain(closed_sessions(log, _GAP, "1 hour"), "sessions", own_state=True)
    said = F.array_join(F.transform("decisions", lambda d: F.concat_ws(":", d["operation"], d["reason"])), "|")
    lasted = F.unix_micros("ended") - F.unix_micros("opened")
    return closed.select("session", "closed_by", "n_decisions", F.array_join(F.col("decisions.step_id").cast("array<string>"), ",").alias("step_ids"), said.alias("said"), lasted.alias("lasted_us"))


@query(
    "stream_static_enrich",
    O.sql("steps episodes", "SELECT step_id, session, operation, task, outcome FROM steps LEFT JOIN episodes USING (session)"),
)
def stream_static_enrich(spark, folder):
    log = V.steps_of(_events(spark, folder)).select("step_id", "session", "operation")
    outcome = V.episodes(spark, folder).select("session", "task", "outcome")
    return S.drain(S.enrich(log, outcome, "session"), "enriched")
