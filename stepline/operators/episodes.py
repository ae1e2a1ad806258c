"""Decision logs cut by how their episode ended.

What a session needs to know about itself (last DONE, first site block, length) is one
small aggregate row, combined map-side; the log is then filtered by one join against it.
A session that holds a large share of the log is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions.hashing import hex_mod
from stepline.functions.text import strip
from stepline.operators.ordering import first_per_group

# fixed values: how a crash of the browser and a page that turns the agent away are worded
INFRA_ERROR = r"IPCResponseTimeout|StalePage|timed out after|Document is navigating"
SITE_BLOCK = (
    r"(?i)403|captcha|unusual traffic|cloudflare|security verification|access denied|log ?in|sign ?in|"
    r"robot|forbidden|blocked by"
)
MIN_INFRA_ROWS = 3


def moment() -> Column:
    """Order of decisions within a session; the step id breaks ties."""
    return F.struct("ts", "step_id")


def session_marks(decisions: DataFrame, acted: str = "operation") -> DataFrame:
    """One row per session: its length and the decisions it may be cut at."""
    did = F.col(acted)
    blocked = (did == "BLOCKED") & (F.col("operation") == "BLOCKED") & F.col("reason").rlike(SITE_BLOCK)
    return decisions.groupBy("session").agg(
        F.count("*").alias("n_rows"),
        F.max(moment()).alias("last"),
        F.max(F.when(did == "DONE", moment())).alias("last_done"),
        F.min(F.when(blocked, moment())).alias("first_block"),
    )


def upto(decisions: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """Decisions of each session up to and including a marked one; sessions without it drop out."""
    cut = marks.filter(F.col(mark).isNotNull()).select("session", F.col(mark).alias("_cut"))
    return decisions.join(cut, "session").filter(moment() <= F.col("_cut")).drop("_cut")


def all_but_last(decisions: DataFrame, marks: DataFrame, min_rows: int = MIN_INFRA_ROWS) -> DataFrame:
    cut = marks.filter(F.col("n_rows") >= min_rows).select("session", F.col("last").alias("_cut"))
    return decisions.join(cut, "session").filter(moment() < F.col("_cut")).drop("_cut")


def fates(marks: DataFrame, episodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What happens to each session, and the decision it is cut at (``cut_last``: that one excluded)."""
    s = marks.join(episodes, "session", "left").join(verdicts, "session", "left")
    out, infra = F.col("outcome"), F.coalesce(F.col("error").rlike(INFRA_ERROR), F.lit(False))
    fate = (
        F.when(out.isNull(), "no_outcome")
        .when((out == "done") & F.col("last_done").isNull(), "done_without_done_decision")
        .when((out == "done") & ~F.coalesce("judged_done", F.lit(False)), "done_rejected_by_judge")
        .when(out == "done", "done_kept")
        .when((out == "blocked") & F.col("first_block").isNull(), "blocked_loop_dropped")
        .when(out == "blocked", "site_blocked_kept")
        .when((out == "error") & infra & (F.col("n_rows") < MIN_INFRA_ROWS), "infra_error_too_short")
        .when((out == "error") & infra, "infra_error_prefix_kept")
        .otherwise(F.concat(out, F.lit("_dropped")))
    )
    s = s.withColumn("fate", fate)
    cut = (
        F.when(F.col("fate") == "done_kept", F.col("last_done"))
        .when(F.col("fate") == "site_blocked_kept", F.col("first_block"))
        .when(F.col("fate") == "infra_error_prefix_kept", F.col("last"))
    )
    return s.select("session", "task", "source", "fate", cut.alias("cut"))


def kept_decisions(decisions: DataFrame, fate: DataFrame) -> DataFrame:
    cut = fate.filter(F.col("cut").isNotNull())
    inside = F.when(F.col("fate") == "infra_error_prefix_kept", moment() < F.col("cut")).otherwise(moment() <= F.col("cut"))
    return decisions.join(cut, "session").filter(inside)


def relabel_on_policy(kept: DataFrame) -> DataFrame:
    """Student-driven logs: the confirmed final state is DONE, unverified earlier DONE labels go."""
    final = (F.col("fate") == "done_kept") & (moment() == F.col("cut"))
    early = (F.col("fate") == "done_kept") & ~final & (F.col("operation") == "DONE")
    return kept.filter(~early).withColumn("operation", F.when(final, "DONE").otherwise(F.col("operation")))


def drop_repeats(decisions: DataFrame) -> DataFrame:
    """Repeats of (request, label) within a session; the first stays."""
    sig = F.sha2(F.to_json(F.struct("request", "operation"), {"ignoreNullFields": "false"}), 256)
    return first_per_group(decisions, ["session", sig], [F.col("ts"), F.col("step_id")]).drop("_rn")


def task_split(task: Column, dev_fraction: float = 0.08) -> Column:
    return F.when(hex_mod(F.sha2(task, 256), 1000) < dev_fraction * 1000, "dev").otherwise("train")


def training_rows(decisions: DataFrame, fate: DataFrame, on_policy: bool = False) -> DataFrame:
    kept = kept_decisions(decisions, fate)
    if on_policy:
        kept = relabel_on_policy(kept)
    return drop_repeats(kept).withColumn("split", task_split(F.col("task")))


def outcome_of_run(exit_code: Column, statuses: Column, stderr: Column, timed_out: Column) -> Column:
    """done / blocked / budget / error / timeout / no_state from a recorded run."""
    tail = F.element_at(F.split(strip(stderr), r"\r\n|\n|\r"), -1)
    return (
        F.when(timed_out, "timeout")
        .when((exit_code != 0) & F.contains(tail, F.lit("action demo budget")), "budget")
        .when(exit_code != 0, "error")
        .when(F.size(statuses) == 0, "no_state")
        .otherwise(F.try_element_at(statuses, F.lit(-1)))
    )


def decision_sequence(decisions: DataFrame, episodes: DataFrame, width: int = 400, reason_width: int = 200) -> DataFrame:
    """``OP[target] → OP …`` per session, cut to a width, with its length and last reason.

    Decisions without an operation have no entry. An entry takes at least four characters with
    its arrow, so the first width / 4 entries of a session already decide the whole text.
    """
    entry = F.concat("operation", F.when(F.col("target").isNotNull(), F.concat(F.lit("["), F.col("target"), F.lit("]"))).otherwise(""))
    head = first_per_group(
        decisions.select("session", "ts", "step_id", entry.alias("entry")).filter(F.length("entry") > 0), ["session"], [F.col("ts"), F.col("step_id")], width // 4 + 1
    )
    text = head.groupBy("session").agg(
        F.substring(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "entry"))), lambda x: x["entry"]), " → "), 1, width
        ).alias("sequence")
    )
    ends = decisions.groupBy("session").agg(
        F.count("*").alias("n_decisions"), F.substring(F.max_by("reason", moment()), 1, reason_width).alias("last_reason")
    )
    return ends.join(text, "session", "left").join(episodes.select("session", "outcome"), "session", "left")
