"""Registered queries: decision logs, episodes, judge verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepline.operators import episodes as E
from stepline.plans import oracle as O
from stepline.plans import views as V
from stepline.plans.registry import query
from stepline.session import scratch_path
from stepline.sources.lines import numbered_lines, parsed
from stepline.sources.tables import table

_BLOCK = E.SITE_BLOCK.removeprefix("(?i)")
_ROW = "row_number() OVER (PARTITION BY session ORDER BY ts, step_id)"
_MARKED = f"""SELECT *, rn AS r, max(CASE WHEN {{acted}}='DONE' THEN rn END) OVER (PARTITION BY session) AS last_done,
  min(CASE WHEN {{acted}}='BLOCKED' AND operation='BLOCKED' AND regexp_matches(lower(reason),'{_BLOCK}') THEN rn END) OVER (PARTITION BY session) AS first_block,
  max(rn) OVER (PARTITION BY session) AS n_rows FROM (SELECT *, {_ROW} AS rn FROM {{src}})"""
_M = dict(m=_MARKED.format(acted="operation", src="decisions"))


@query("prefix_to_last_done", O.sql("decisions", "SELECT session, step_id FROM m WHERE rn<=last_done", **_M))
def prefix_to_last_done(spark, folder):
    d = V.decisions(spark, folder)
    return E.upto(d, E.session_marks(d), "last_done").select("session", "step_id")


@query("prefix_to_first_block", O.sql("decisions", "SELECT session, step_id FROM m WHERE rn<=first_block", **_M))
def prefix_to_first_block(spark, folder):
    d = V.decisions(spark, folder)
    return E.upto(d, E.session_marks(d), "first_block").select("session", "step_id")


@query("prefix_drop_last", O.sql("decisions", "SELECT session, step_id FROM m WHERE rn<n_rows AND n_rows>=3", **_M))
def prefix_drop_last(spark, folder):
    d = V.decisions(spark, folder)
    return E.all_but_last(d, E.session_marks(d)).select("session", "step_id")


@query(
    "drop_repeated_states",
    O.sql("decisions", "SELECT session, step_id FROM decisions QUALIFY row_number() OVER (PARTITION BY session, request, operation ORDER BY ts, step_id)=1"),
)
def drop_repeated_states(spark, folder):
    return E.drop_repeats(V.decisions(spark, folder)).select("session", "step_id")


@query(
    "join_outcomes",
    O.sql("decisions episodes", "SELECT d.step_id, d.session, e.task, e.source, e.outcome FROM decisions d JOIN episodes e USING (session)"),
)
def join_outcomes(spark, folder):
    e = V.episodes(spark, folder).select("session", "task", "source", "outcome")
    joined = V.decisions(spark, folder).join(e, "session", "left")
    return joined.filter("outcome is not null").select("step_id", "session", "task", "source", "outcome")


def _fates_sql(src: str, acted: str) -> dict[str, str]:
    return dict(
        m=_MARKED.format(acted=acted, src=src),
        s="SELECT session, max(n_rows) AS n_rows, max(last_done) AS last_done, max(first_block) AS first_block FROM m GROUP BY session",
        f=f"""SELECT s.*, task, source, CASE WHEN outcome IS NULL THEN 'no_outcome'
          WHEN outcome='done' AND last_done IS NULL THEN 'done_without_done_decision'
          WHEN outcome='done' AND NOT coalesce(judged_done,false) THEN 'done_rejected_by_judge'
          WHEN outcome='done' THEN 'done_kept' WHEN outcome='blocked' AND first_block IS NULL THEN 'blocked_loop_dropped'
          WHEN outcome='blocked' THEN 'site_blocked_kept'
          WHEN outcome='error' AND regexp_matches(error,'{E.INFRA_ERROR}') THEN CASE WHEN n_rows<3 THEN 'infra_error_too_short' ELSE 'infra_error_prefix_kept' END
          ELSE outcome||'_dropped' END AS fate FROM s LEFT JOIN episodes USING (session) LEFT JOIN verdicts USING (session)""",
        kept="""SELECT m.*, f.fate, f.task, f.source FROM m JOIN f USING (session) WHERE
          (fate='done_kept' AND rn<=m.last_done) OR (fate='site_blocked_kept' AND rn<=m.first_block)
          OR (fate='infra_error_prefix_kept' AND rn<m.n_rows)""",
    )


_DEV = f"CASE WHEN {O.hex_mod('sha256(task)', 1000)}<80 THEN 'dev' ELSE 'train' END"
_TRAIN = dict(
    dd="SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY session, request, operation ORDER BY ts, step_id)=1",
    rows=f"SELECT *, {_DEV} AS split FROM dd",
)


def _fate(spark, folder, d, acted="operation"):
    return E.fates(E.session_marks(d, acted), V.episodes(spark, folder).drop("n_events"), V.verdicts(spark, folder))


@query(
    "job_episode_filter",
    O.sql("decisions episodes verdicts", "SELECT split, session, step_id, operation, reason, task, source, fate FROM rows", **_fates_sql("decisions", "operation"), **_TRAIN),
)
def job_episode_filter(spark, folder):
    d = V.decisions(spark, folder)
    rows = E.training_rows(d, _fate(spark, folder, d))
    return rows.select("split", "session", "step_id", "operation", "reason", "task", "source", "fate")


@query(
    "episode_stats",
    O.sql(
        "decisions episodes verdicts",
        """SELECT 'episodes' AS part, fate AS item, count(*) AS n FROM f GROUP BY fate UNION ALL
        SELECT 'rows', 'duplicate_state', (SELECT count(*) FROM kept)-(SELECT count(*) FROM rows) UNION ALL
        SELECT split, operation, count(*) FROM rows GROUP BY ALL""",
        **_fates_sql("decisions", "operation"),
        **_TRAIN,
    ),
)
def episode_stats(spark, folder):
    d = V.decisions(spark, folder)
    fate = _fate(spark, folder, d)
    kept = E.kept_decisions(d, fate)
    rows = E.drop_repeats(kept).withColumn("split", E.task_split(F.col("task")))
    ops = rows.groupBy(F.col("split").alias("part"), F.col("operation").alias("item")).agg(F.count("*").alias("n"))
    eps = fate.groupBy(F.col("fate").alias("item")).agg(F.count("*").alias("n")).select(F.lit("episodes").alias("part"), "item", "n")
    counts = kept.select(F.lit(1).alias("x")).unionAll(rows.select(F.lit(-1)))
    dup = counts.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n")).select(F.lit("rows").alias("part"), F.lit("duplicate_state").alias("item"), "n")
    return eps.unionByName(dup).unionByName(ops)


def _on_policy(spark, folder):
    d = V.decisions(spark, folder)
    ops = F.array(*[F.lit(o) for o in V.OPERATIONS])
    student = F.element_at(ops, (F.col("k") % 5 + 1).cast("int"))
    return d.withColumn("executed", F.when(F.col("step_id") % 2 == 0, student).otherwise(F.col("operation")))


_OP_LOG = dict(
    log="SELECT *, CASE WHEN step_id%2=0 THEN (['CLICK','TYPE_TEXT','SCROLL_DOWN','BLOCKED','DONE'])[(k%5)+1] ELSE operation END AS executed FROM decisions"
)


@query(
    "onpolicy_relabel",
    O.sql(
        "decisions episodes verdicts",
        """SELECT session, step_id, CASE WHEN fate='done_kept' AND rn=last_done THEN 'DONE' ELSE operation END AS operation, fate FROM kept
        WHERE NOT (fate='done_kept' AND rn<last_done AND operation='DONE')""",
        **_OP_LOG,
        **_fates_sql("log", "executed"),
    ),
)
def onpolicy_relabel(spark, folder):
    d = _on_policy(spark, folder)
    kept = E.kept_decisions(d, _fate(spark, folder, d, "executed"))
    return E.relabel_on_policy(kept).select("session", "step_id", "operation", "fate")


@query(
    "decision_sequence",
    O.sql(
        "decisions episodes",
        """SELECT session, outcome, n_decisions, sequence, last_reason FROM (
        SELECT session, count(*) AS n_decisions, substring(string_agg(e,' → ' ORDER BY ts, step_id),1,400) AS sequence,
          substring(arg_max(reason, (ts,step_id)),1,200) AS last_reason FROM (
          SELECT *, operation||CASE WHEN operation='CLICK' THEN '['||(1+step_id%(2+step_id%7))||']' ELSE '' END AS e FROM decisions) GROUP BY session)
        LEFT JOIN episodes USING (session)""",
    ),
)
def decision_sequence(spark, folder):
    sid = F.col("step_id")
    target = F.when(F.col("operation") == "CLICK", (1 + sid % (2 + sid % 7)).cast("string"))
    d = V.decisions(spark, folder).withColumn("target", target)
    return E.decision_sequence(d, V.episodes(spark, folder)).select("session", "outcome", "n_decisions", "sequence", "last_reason")


@query(
    "episode_outcome",
    O.sql(
        "steps",
        """SELECT step_id, CASE WHEN step_id%31=0 THEN 'timeout' WHEN step_id%7=0 AND step_id%2=0 THEN 'budget' WHEN step_id%7=0 THEN 'error'
        WHEN k%10=0 THEN 'no_state' WHEN operation='DONE' THEN 'done' WHEN operation='BLOCKED' THEN 'blocked' ELSE 'running' END AS outcome FROM steps""",
    ),
)
def episode_outcome(spark, folder):
    sid = F.col("step_id")
    s = V.steps(spark, folder).select(
        "step_id",
        (sid % 7 == 0).cast("int").alias("exit_code"),
        F.when(F.col("k") % 10 == 0, F.array().cast("array<string>"))
        .otherwise(
            F.array(
                F.lit("running"),
                F.when(F.col("operation") == "DONE", "done").when(F.col("operation") == "BLOCKED", "blocked").otherwise("running"),
            )
        )
        .alias("statuses"),
        F.when(sid % 7 == 0, F.concat(F.lit("Traceback\n"), F.when(sid % 2 == 0, "action demo budget reached").otherwise("StalePage: x"), F.lit("\n"))).alias("stderr"),
        (sid % 31 == 0).alias("timed_out"),
    )
    return s.select("step_id", E.outcome_of_run(F.col("exit_code"), F.col("statuses"), F.col("stderr"), F.col("timed_out")).alias("outcome"))


# ---- judge verdicts by line number

_LINES = """SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS line, CASE WHEN quality=1 THEN 'DONE' ELSE 'CLICK' END AS operation,
  CASE WHEN doc_id%10<>0 THEN toxic=1 END AS judged, CASE WHEN doc_id%5=0 THEN 'dev' ELSE 'train' END AS split FROM labels"""
_ACTION = """CASE WHEN judged IS NULL THEN 'no_verdict' WHEN operation='DONE' AND NOT judged THEN 'dropped_false_done'
  WHEN operation<>'DONE' AND judged THEN 'relabelled_to_done' ELSE 'kept' END"""


LINE_SCHEMA = T.StructType([T.StructField(c, k) for c, k in (("doc_id", T.LongType()), ("operation", T.StringType()), ("split", T.StringType()))])
VERDICT_SCHEMA = T.StructType([T.StructField("line", T.LongType()), T.StructField("done", T.BooleanType())])


def judged_files(spark, folder):
    """Labelled rows written as the JSON lines of several files, and what a judge wrote who read them line by line."""
    labels = table(spark, folder, "labels")
    operation = F.when(F.col("quality") == 1, "DONE").otherwise("CLICK")
    split = F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")
    row = F.to_json(F.struct("doc_id", operation.alias("operation"), split.alias("split")))
    data, judge = scratch_path(spark, "labelled"), scratch_path(spark, "judged")
    ordered = labels.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    ordered.select(row.alias("value")).write.text(data)
    seen = parsed(numbered_lines(spark, data), LINE_SCHEMA).select(F.col("position").alias("line"), F.col("row.doc_id").alias("doc_id"))
    verdict = seen.join(labels, "doc_id").where(F.col("doc_id") % 10 != 0)
    verdict.select(F.to_json(F.struct("line", (F.col("toxic") == 1).alias("done"))).alias("value")).write.text(judge)
    return data, judge


def _lines(spark, folder):
    """Labelled rows with the number of their line, and the verdicts keyed by it, both read from files."""
    data, judge = judged_files(spark, folder)
    rows = parsed(numbered_lines(spark, data), LINE_SCHEMA).where("not broken").select("row.*", F.col("position").alias("line"))
    verdicts = parsed(spark.read.text(judge), VERDICT_SCHEMA).where("not broken").select("row.line", F.col("row.done").alias("judged"))
    return rows.select("doc_id", "line", "operation", "split"), verdicts


def audit(rows, verdicts):
    """Joins verdicts by line and names what happens to each row."""
    done, judged = F.col("operation") == "DONE", F.col("judged")
    action = (
        F.when(judged.isNull(), "no_verdict")
        .when(done & ~judged, "dropped_false_done")
        .when(~done & judged, "relabelled_to_done")
        .otherwise("kept")
    )
    return rows.join(verdicts, "line", "left").withColumn("action", action)


def apply_audit(rows, verdicts):
    """The cleaned copy: false DONE rows gone, reached goals relabelled with their origin."""
    a = audit(rows, verdicts).filter(F.col("action") != "dropped_false_done")
    moved = F.col("action") == "relabelled_to_done"
    return a.withColumn("relabelled_from", F.when(moved, F.col("operation"))).withColumn(
        "operation", F.when(moved, "DONE").otherwise(F.col("operation"))
    )


_AUDIT = dict(lines=_LINES, a=f"SELECT *, {_ACTION} AS action FROM lines")
_APPLIED = """SELECT doc_id, line, split, action, CASE WHEN action='relabelled_to_done' THEN 'DONE' ELSE operation END AS operation,
  CASE WHEN action='relabelled_to_done' THEN operation END AS relabelled_from FROM a WHERE action<>'dropped_false_done'"""


@query("apply_verdicts", O.sql("", _APPLIED, **_AUDIT))
def apply_verdicts(spark, folder):
    return apply_audit(*_lines(spark, folder)).select("doc_id", "line", "split", "action", "operation", "relabelled_from")


_REPORT = f"""SELECT split, item, count(*) AS n FROM (SELECT split, action AS item FROM a UNION ALL
  SELECT split, unnest(['rows_out','op:'||operation]) FROM ({_APPLIED})) GROUP BY ALL"""


def audit_report(rows, verdicts):
    a = audit(rows, verdicts)
    moved = F.col("action") == "relabelled_to_done"
    final = F.when(moved, "DONE").otherwise(F.col("operation"))
    out = F.col("action") != "dropped_false_done"
    items = F.array_compact(
        F.array(F.col("action"), F.when(out, F.lit("rows_out")), F.when(out, F.concat(F.lit("op:"), final)))
    )
    return a.select("split", F.explode(items).alias("item")).groupBy("split", "item").agg(F.count("*").alias("n"))


@query("relabel_report", O.sql("", _REPORT, **_AUDIT))
def relabel_report(spark, folder):
    return audit_report(*_lines(spark, folder))


@query(
    "job_audit_labels",
    O.sql("", f"SELECT r.split, r.item, r.n, o.rows_out FROM ({_REPORT}) r LEFT JOIN (SELECT split, count(*) AS rows_out FROM ({_APPLIED}) GROUP BY split) o USING (split)", **_AUDIT),
)
def job_audit_labels(spark, folder):
    """Writes the cleaned copy by split, then reports on it beside the audit counts."""
    from stepline.sources.steps import write_splits

    rows, verdicts = _lines(spark, folder)
    path = scratch_path(spark, "audited")
    written = write_splits(apply_audit(rows, verdicts), path, "json")
    return audit_report(rows, verdicts).join(written.withColumnRenamed("rows", "rows_out"), "split", "left").select("split", "item", "n", "rows_out")


@query(
    "label_judge_join",
    O.sql("", "SELECT line, doc_id, operation='DONE' AS label_done, judged FROM lines WHERE judged IS NOT NULL", lines=_LINES),
)
def label_judge_join(spark, folder):
    rows, verdicts = _lines(spark, folder)
    return rows.join(verdicts, "line").select("line", "doc_id", (F.col("operation") == "DONE").alias("label_done"), "judged")


@query(
    "operation_mix",
    O.sql("steps", "SELECT subset AS config, CASE WHEN session%4=0 THEN 'validation' ELSE 'train' END AS split, operation, count(*) AS n FROM steps GROUP BY ALL"),
)
def operation_mix(spark, folder):
    s = V.steps(spark, folder)
    split = F.when(F.col("session") % 4 == 0, "validation").otherwise("train")
    return s.groupBy(F.col("subset").alias("config"), split.alias("split"), "operation").agg(F.count("*").alias("n"))


@query(
    "resume_skip",
    O.sql("decisions", "SELECT step_id, session FROM decisions WHERE session%3<>0 AND operation IN ('CLICK','DONE') AND step_id NOT IN (SELECT step_id FROM decisions WHERE k<30)"),
)
def resume_skip(spark, folder):
    d = V.decisions(spark, folder)
    done = d.filter("k < 30").select("step_id")
    todo = d.filter((F.col("session") % 3 != 0) & F.col("operation").isin("CLICK", "DONE"))
    return todo.join(done, "step_id", "left_anti").select("step_id", "session")
