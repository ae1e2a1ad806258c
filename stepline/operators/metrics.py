"""Scores over labelled steps and their answers.

Input is the nested step row of ``plans.views``; a score is one partial aggregation over a
narrow projection, so the shuffle carries group rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions import prob
from stepline.functions.text import kind_of
from stepline.operators.ordering import line_position, order_statistics, running_sums

ALL = "(all)"


def share(c: Column) -> Column:
    """Mean of a boolean as a double; null rows do not count."""
    return F.avg(c.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def kinds_of(q_keys: Column, qid: Column) -> Column:
    """All kinds a question counts in."""
    kind = kind_of(qid)
    target = kind == "target"
    return F.array_compact(
        F.array(
            kind,
            F.lit("all_questions"),
            F.when(target, qid),
            F.when(target & (F.size(q_keys) > 1), F.lit("target_k>1")),
        )
    )


def accuracy_by_kind(questions: DataFrame) -> DataFrame:
    """n, accuracy, mean confidence and chance for every kind."""
    return (
        questions.select(
            F.explode_outer(kinds_of(F.col("keys"), F.col("qid"))).alias("kind"),
            "correct",
            "confidence",
            (1.0 / F.size("keys")).alias("chance"),
        )
        .groupBy("kind")
        .agg(
            F.count("*").alias("n"),
            r6(share(F.col("correct"))).alias("accuracy"),
            r6(F.avg("confidence")).alias("mean_confidence"),
            r6(F.avg("chance")).alias("chance"),
        )
    )


def all_right(questions: Column | str) -> Column:
    """Every labelled question of the step is right."""
    return F.forall(questions, lambda q: q["correct"])


def calibration(rows: DataFrame, confidence: str, hit: str, bin_col: Column, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error: bins are summed first, then folded into one number per group."""
    bins = (
        rows.select(*by, F.col(confidence).alias("_c"), F.col(hit).cast("long").alias("_h"), bin_col.alias("_bin"))
        .groupBy(*by, "_bin")
        .agg(F.count("*").alias("_n"), F.sum("_c").alias("_sc"), F.sum("_h").alias("_sh"))
    )
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_sh") / F.col("_n") - F.col("_sc") / F.col("_n")) * F.col("_n"))
    return bins.groupBy(*by).agg(F.sum("_n").alias("n"), r6(F.sum(gap) / F.sum("_n")).alias("ece"))


def read_answers(answers: Column | str) -> Column:
    """choice, confidence, validity and distribution of every recorded answer.

    The distribution counts only when its keys are all offered and it sums to 1 within the
    tolerance; a choice without one is scored at confidence 1.
    """
    items = F.col(answers) if isinstance(answers, str) else answers
    items = prob.extend(
        items,
        valid=lambda a: F.coalesce(F.array_contains(a["options"], a["choice"]), F.lit(False)),
        # in option order, zero where the answer is silent: a map has no order of its own
        p=lambda a: F.transform(a["options"], lambda k: F.coalesce(F.try_element_at(a["probabilities"], k), F.lit(0.0))),
        known=lambda a: F.size(F.array_except(F.map_keys(a["probabilities"]), a["options"])) == 0,
    )
    items = prob.extend(
        items,
        distribution=lambda a: a["valid"]
        & F.coalesce(a["known"] & (F.abs(prob.total(a["p"]) - 1) <= prob.SUM_TOLERANCE), F.lit(False)),
        correct=lambda a: F.coalesce(a["valid"] & (a["choice"] == a["gold"]), F.lit(False)),
    )
    return F.transform(
        items,
        lambda a: F.struct(
            a["qid"].alias("qid"),
            a["gold"].alias("gold"),
            F.when(a["valid"], a["choice"]).alias("choice"),
            F.when(~a["valid"], 0.0)
            .when(~a["distribution"], 1.0)
            .otherwise(F.coalesce(F.try_element_at(a["probabilities"], a["choice"]), F.lit(0.0)))
            .alias("confidence"),
            a["valid"].alias("valid"),
            a["distribution"].alias("distribution"),
            a["correct"].alias("correct"),
            F.when(a["distribution"], prob.brier(a["p"], a["options"], a["gold"])).alias("brier"),
        ),
    )


def score_answers(steps: DataFrame) -> DataFrame:
    """Adds ``scored``: one struct per question, read from ``answers``."""
    return steps.withColumn("scored", read_answers("answers"))


def bench_scores(s: DataFrame) -> DataFrame:
    """The metric block of scored steps without latencies, overall and by subset.

    One pass: every question row falls into (subset, operation?, calibration bin); all
    metrics are sums over those few hundred cells, rolled up per subset and overall.
    """
    every = lambda field: F.forall("scored", lambda q: q[field])
    rows = s.select(
        "subset",
        (F.col("error").isNull()).alias("ok"),
        every("valid").alias("all_valid"),
        every("correct").alias("success"),
        "input_tokens",
        F.explode_outer("scored").alias("q"),
    ).select(
        "*",
        (F.col("q.qid") == "operation").alias("is_op"),
        (F.col("q.gold") == "DONE").alias("gold_done"),
        F.coalesce(F.col("q.choice") == "DONE", F.lit(False)).alias("said_done"),
        prob.bin_floor("q.confidence").alias("bin"),
    )
    op = F.col("is_op")
    n_if = lambda c: F.count_if(c)
    cells = rows.groupBy("subset", "is_op", "bin").agg(
        F.count("*").alias("n"),
        F.sum("q.confidence").alias("conf"),
        n_if(F.col("q.correct")).alias("hits"),
        n_if(op & F.col("ok")).alias("n_ok"),
        n_if(op & F.col("ok") & F.col("all_valid")).alias("n_valid"),
        n_if(op & F.col("success")).alias("n_success"),
        n_if(op & ~F.col("gold_done")).alias("n_not_done"),
        n_if(op & ~F.col("gold_done") & F.col("said_done")).alias("n_premature"),
        n_if(op & F.col("gold_done")).alias("n_done"),
        n_if(op & F.col("gold_done") & F.col("said_done")).alias("n_recalled"),
        F.sum(F.when(op, F.col("q.brier"))).alias("brier"),
        F.count(F.when(op, F.col("q.brier"))).alias("n_brier"),
        n_if(F.col("q.valid") & ~F.col("q.distribution")).alias("n_onehot"),
        F.sum(F.when(op, F.col("input_tokens"))).alias("tokens"),
        F.count(F.when(op, F.col("input_tokens"))).alias("n_tokens"),
    )
    sums = [c for c in cells.columns if c not in ("subset", "is_op", "bin")]
    spread = cells.withColumn("subset", F.explode(F.array(F.lit(ALL), F.col("subset"))))
    cell = spread.groupBy("subset", "is_op", "bin").agg(*[F.sum(c).alias(c) for c in sums])
    # the calibration over both kinds of question needs the bins of both added up
    both = Window.partitionBy("subset", "bin")
    n_b, h_b, c_b = (F.sum(x).over(both) for x in ("n", "hits", "conf"))
    cell = cell.withColumn("gap", F.abs(F.col("hits") - F.col("conf"))).withColumn(
        "gap_all", F.abs(h_b - c_b) * F.col("n") / n_b
    )
    total = lambda c, cond=None: F.sum(F.when(cond, F.col(c)) if cond is not None else F.col(c))
    return cell.groupBy("subset").agg(
        total("n", op).alias("n_items"),
        total("n_ok").alias("n_ok"),
        total("n_valid").alias("n_valid"),
        r6(ratio(total("n_ok"), total("n", op))).alias("coverage"),
        r6(ratio(total("n_valid"), total("n", op))).alias("success_rate"),
        r6(ratio(total("n_success"), total("n", op))).alias("step_success"),
        r6(ratio(total("hits", op), total("n", op))).alias("operation_accuracy"),
        r6(ratio(total("hits", ~op), total("n", ~op))).alias("target_accuracy"),
        F.coalesce(total("n", ~op), F.lit(0)).alias("n_targets"),
        r6(ratio(total("n_premature"), total("n_not_done"))).alias("premature_done_rate"),
        r6(ratio(total("n_recalled"), total("n_done"))).alias("done_recall"),
        r6(F.sum("gap_all") / F.sum("n")).alias("ece"),
        r6(ratio(total("gap", op), total("n", op))).alias("ece_operation"),
        r6(ratio(total("gap", ~op), total("n", ~op))).alias("ece_target"),
        r6(ratio(total("brier"), total("n_brier"))).alias("brier_operation"),
        (total("n_onehot") == 0).alias("has_distribution"),
        r6(ratio(total("tokens"), total("n_tokens"))).alias("mean_input_tokens"),
    )


def bench_report(steps: DataFrame, latency: str = "latency_s") -> DataFrame:
    """The full metric block, overall and by subset: scores, and the percentiles of the latencies."""
    s = score_answers(steps)
    out = bench_scores(s)
    timed = s.filter(F.col("error").isNull()).select(
        F.explode(F.array(F.lit(ALL), F.col("subset"))).alias("subset"), F.col(latency).alias("latency")
    )
    times = order_statistics(timed, ["subset"], "latency", {"p50": (0.5, "linear"), "p95": (0.95, "linear")})
    times = times.select(
        "subset", r6(F.col("p50")).alias("latency_p50_s"), r6(F.col("p95")).alias("latency_p95_s")
    )
    return out.join(times, "subset", "left")


def threshold_counts(rows: DataFrame, p: str, gold_done: str, thresholds: Sequence[float]) -> DataFrame:
    """DONE recall and premature rate per threshold.

    Rows are tallied by the number of thresholds they pass; the curve is a suffix sum over
    those few tallies, instead of every row meeting every threshold.
    """
    ts = sorted(thresholds)
    splits = [float("-inf"), *ts, float("inf")]
    passed = Bucketizer(splits=splits, inputCol=p, outputCol="_passed").transform(rows)
    tally = passed.groupBy("_passed").agg(
        F.count_if(F.col(gold_done)).alias("d"), F.count_if(~F.col(gold_done)).alias("o")
    )
    totals = tally.agg(  # at most one entry per threshold and one below all
        F.sum("d").alias("n_done"), F.sum("o").alias("n_other"), F.collect_list(F.struct("_passed", "d", "o")).alias("_t")
    )
    curve = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("i")) for i, t in enumerate(ts)])
    at = totals.select("n_done", "n_other", "_t", F.explode(curve).alias("c"))
    over = lambda f: F.aggregate(
        "_t", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["_passed"] > F.col("c.i"), x[f]).otherwise(0)
    )
    return at.select(
        F.col("c.threshold").alias("threshold"),
        r6(over("d") / F.greatest("n_done", F.lit(1))).alias("done_recall"),
        r6(over("o") / F.greatest("n_other", F.lit(1))).alias("premature_rate"),
    )


def _mean_nll(rows: DataFrame, z: str, gold: str, temperatures: Sequence[float]) -> DataFrame:
    """One row with one mean per temperature, from one pass; ``z`` is shifted."""
    return rows.agg(*[F.avg(prob.log_loss(z, gold, t)).alias(f"t{i}") for i, t in enumerate(temperatures)])


def nll_at(rows: DataFrame, z: str, gold: str, temperatures: Sequence[float]) -> DataFrame:
    """Mean negative log-likelihood at several temperatures, all in one pass."""
    means = _mean_nll(rows.select(prob.shifted(z).alias(z), gold), z, gold, temperatures)
    pairs = F.array(
        *[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)]
    )
    return means.select(F.explode(pairs).alias("x")).select("x.temperature", "x.nll")


# fixed values: the range searched for a serving temperature and its printed precision
T_LOW, T_HIGH, T_DIGITS = 0.3, 5.0, 4


def fit_temperature(rows: DataFrame, z: str, gold: str, points: int = 9, rounds: int = 10) -> float:
    """The temperature of least negative log-likelihood.

    The loss has a single minimum, so each pass evaluates a grid and keeps the cells around
    the best point; ten passes narrow the bracket below the printed precision. The passes read
    ``rows`` again, so the caller hands over a table.
    """
    lo, hi = T_LOW, T_HIGH
    kept = rows.select(prob.shifted(z).alias(z), gold)
    for _ in range(rounds):
        step = (hi - lo) / (points - 1)
        grid = [lo + i * step for i in range(points)]
        means = _mean_nll(kept, z, gold, grid).first()  # one row of means
        best = grid[min(range(points), key=lambda i: means[i])]
        lo, hi = max(lo, best - step), min(hi, best + step)
    return round((lo + hi) / 2, T_DIGITS)


def mcnemar_exact(gained: Column, lost: Column) -> Column:
    """Two-sided exact McNemar p-value of two discordant counts (binomial sum at one half)."""
    n = gained + lost
    k = F.least(gained, lost)
    # log of binomial(n, i) accumulated term by term; one aggregate row, so the loop is short
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")),
        start,
        lambda acc, i: F.struct(
            (acc["t"] + F.log((n - i + 1) / i)).alias("t"),
            (acc["s"] + F.when(i <= k, F.exp(acc["t"] + F.log((n - i + 1) / i))).otherwise(0.0)).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def running_share(df: DataFrame, order: str, hit: str, every: int) -> DataFrame:
    """seen, share: the share of hits among the first rows, after every so many rows in order.

    Rows are counted by place, whatever the gaps between their numbers; a last part of fewer
    rows is not reported. Blocks are summed first, and only their sums are ordered.
    """
    placed = line_position(df.select(order, hit), order, "_at")
    blocks = placed.groupBy(F.floor((F.col("_at") - 1) / every).alias("_block")).agg(F.sum(hit).alias("_hits"), F.count("*").alias("_rows"))
    run = running_sums(blocks, "_block", {"_hits_to": F.col("_hits")}).filter(F.col("_rows") == every)
    return run.select(((F.col("_block") + 1) * every).alias("seen"), (F.col("_hits_to") / ((F.col("_block") + 1) * every)).alias("share"))


def agreement_rates(df: DataFrame, label: Column, judge: Column, said: Column, p: Column, thresholds: list[float]) -> DataFrame:
    """DONE recall and premature rate by the raw labels and where label and judge agree.

    A row per rule: ``choice`` (the answer given) and every threshold on its probability. Recall is
    over steps that are done, the premature rate over steps that are not; each comes with the
    number of its steps, and a rate without steps is null. One pass over the rows.
    """
    groups = {"recall_raw": label, "recall_agree": label & judge, "premature_raw": ~label, "premature_agree": ~label & ~judge}
    rules = [("choice", said), *[(str(t), p >= t) for t in thresholds]]
    rates = [share(F.when(g, hit)).alias(f"{name}_{i}") for i, (_, hit) in enumerate(rules) for name, g in groups.items()]
    sizes = [F.count_if(g).alias(f"n_{name}") for name, g in groups.items()]
    one = df.agg(*rates, *sizes)
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), *[F.col(f"{name}_{i}").alias(name) for name in groups]) for i, (rule, _) in enumerate(rules)])
    return one.select(F.explode(rows).alias("r"), *[f"n_{name}" for name in groups]).select("r.*", *[f"n_{name}" for name in groups])
