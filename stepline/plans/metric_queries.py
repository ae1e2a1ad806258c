"""Registered queries: scores, calibration, latency, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepline.functions import prob
from stepline.operators import metrics as M
from stepline.operators.ordering import order_statistics
from stepline.plans import oracle as O
from stepline.plans import views as V
from stepline.plans.registry import query
from stepline.session import materialize
from stepline.sources.tables import table


def _scored(spark, folder):
    return V.with_questions(V.steps(spark, folder))


def _questions(spark, folder):
    return V.question_rows(_scored(spark, folder))


def _bench(spark, folder):
    return V.with_answers(_scored(spark, folder))


def _ops(spark, folder):
    """Operation questions with gold, prediction and p(DONE)."""
    q = F.col("questions")[0]
    return _scored(spark, folder).select(
        "step_id",
        "session",
        "subset",
        "k",
        q["keys"][q["gold"]].alias("gold"),
        q["keys"][q["pred"]].alias("pred"),
        q["confidence"].alias("confidence"),
        q["correct"].alias("correct"),
        q["p"][4].alias("p_done"),
        q["w"].alias("w"),
        q["gold"].alias("gold_idx"),
    )


@query(
    "accuracy_by_kind",
    O.sql(
        "qs",
        """SELECT kind, count(*) AS n, round(avg(correct::INT::DOUBLE),6) AS accuracy, round(avg(conf),6) AS mean_confidence,
        round(avg(1.0::DOUBLE/n_opt),6) AS chance FROM (
          SELECT 'all_questions' AS kind, * FROM qs UNION ALL SELECT 'operation', * FROM qs WHERE qid='operation'
          UNION ALL SELECT 'target', * FROM qs WHERE qid<>'operation' UNION ALL SELECT qid, * FROM qs WHERE qid<>'operation'
          UNION ALL SELECT 'target_k>1', * FROM qs WHERE qid<>'operation' AND n_opt>1) GROUP BY kind""",
    ),
)
def accuracy_by_kind(spark, folder):
    return M.accuracy_by_kind(_questions(spark, folder))


@query(
    "step_success",
    O.sql(
        "qs",
        """SELECT count(*) AS n, round(avg(ok::INT::DOUBLE),6) AS step_success FROM (
        SELECT step_id, bool_and(correct) AS ok FROM qs GROUP BY step_id)""",
    ),
)
def step_success(spark, folder):
    s = _scored(spark, folder).select(M.all_right("questions").alias("ok"))
    return s.agg(F.count("*").alias("n"), M.r6(M.share(F.col("ok"))).alias("step_success"))


@query(
    "operation_confusion",
    O.sql(
        "bq",
        """SELECT gold, coalesce(choice,'<invalid>') AS predicted, count(*) AS n FROM bq WHERE qid='operation'
        GROUP BY ALL""",
    ),
)
def operation_confusion(spark, folder):
    q = M.score_answers(_bench(spark, folder)).select(F.col("scored")[0].alias("q"))
    return q.groupBy(
        F.col("q.gold").alias("gold"), F.coalesce("q.choice", F.lit("<invalid>")).alias("predicted")
    ).agg(F.count("*").alias("n"))


@query(
    "recall_by_gold",
    O.sql(
        "qs",
        "SELECT gold, count(*) AS n, round(avg((pred=gold)::INT::DOUBLE),6) AS recall FROM qs WHERE qid='operation' GROUP BY gold",
    ),
)
def recall_by_gold(spark, folder):
    o = _ops(spark, folder)
    return o.groupBy("gold").agg(F.count("*").alias("n"), M.r6(M.share(F.col("pred") == F.col("gold"))).alias("recall"))


@query(
    "premature_done",
    O.sql(
        "qs",
        """SELECT round(avg((pred='DONE')::INT::DOUBLE) FILTER (WHERE gold<>'DONE'),6) AS premature_done_rate,
        round(avg((pred='DONE')::INT::DOUBLE) FILTER (WHERE gold='DONE'),6) AS done_recall FROM qs WHERE qid='operation'""",
    ),
)
def premature_done(spark, folder):
    said = (F.col("pred") == "DONE").cast("double")
    return _ops(spark, folder).agg(
        M.r6(F.avg(F.when(F.col("gold") != "DONE", said))).alias("premature_done_rate"),
        M.r6(F.avg(F.when(F.col("gold") == "DONE", said))).alias("done_recall"),
    )


_EDGES = " ".join(f"WHEN conf>={0.1 * j!r}::DOUBLE THEN {j}" for j in range(9, 0, -1))
_ECE = """SELECT qid, sum(n)::BIGINT AS n, round(sum(n*abs(h/n-c/n))/sum(n),6) AS ece FROM (
  SELECT qid, {bin} AS b, count(*) AS n, sum(correct::INT)::DOUBLE AS h, sum(conf) AS c FROM {src} GROUP BY 1,2) GROUP BY qid"""


@query("ece_edges", O.sql("qs", _ECE.format(bin=f"CASE {_EDGES} ELSE 0 END", src="qs")))
def ece_edges(spark, folder):
    return M.calibration(_questions(spark, folder), "confidence", "correct", prob.bin_edges("confidence"), ["qid"])


@query("ece_floor", O.sql("bq", _ECE.format(bin="least(floor(least(greatest(conf,0),1)*10),9)", src="bq")))
def ece_floor(spark, folder):
    q = M.score_answers(_bench(spark, folder)).select(F.explode_outer("scored").alias("q")).select("q.*")
    return M.calibration(q, "confidence", "correct", prob.bin_floor("confidence"), ["qid"])


@query(
    "brier",
    O.sql(
        "bq",
        """SELECT qid, count(brier) AS n, round(avg(brier),6) AS brier FROM bq GROUP BY qid""",
    ),
)
def brier(spark, folder):
    q = M.score_answers(_bench(spark, folder)).select(F.explode_outer("scored").alias("q"))
    return q.groupBy(F.col("q.qid").alias("qid")).agg(
        F.count("q.brier").alias("n"), M.r6(F.avg("q.brier")).alias("brier")
    )


@query(
    "latency_percentiles",
    O.sql(
        "steps",
        """SELECT subset, count(*) AS n, round(quantile_cont(latency_s,0.5),6) AS p50, round(quantile_cont(latency_s,0.95),6) AS p95,
        round(quantile_cont(latency_s,0.9),6) AS p90,
        round((array_agg(latency_s ORDER BY latency_s))[floor(0.9::DOUBLE*(count(*)-1))::BIGINT+1],6) AS p90_lower
        FROM steps WHERE error IS NULL GROUP BY subset""",
    ),
)
def latency_percentiles(spark, folder):
    s = V.steps(spark, folder).filter("error is null")
    picks = {"p50": (0.5, "linear"), "p95": (0.95, "linear"), "p90": (0.9, "linear"), "p90_lower": (0.9, "lower")}
    out = order_statistics(s, ["subset"], "latency_s", picks)
    return out.select("subset", "n", *[M.r6(F.col(p)).alias(p) for p in picks])


_BLOCK = """SELECT {sub} AS subset, count(*) FILTER (WHERE qid='operation') AS n_items,
  round(avg(ok::INT::DOUBLE) FILTER (WHERE qid='operation'),6) AS step_success,
  round(avg(correct::INT::DOUBLE) FILTER (WHERE qid='operation'),6) AS operation_accuracy,
  round(avg(correct::INT::DOUBLE) FILTER (WHERE qid<>'operation'),6) AS target_accuracy,
  round(avg(coalesce(choice='DONE',false)::INT::DOUBLE) FILTER (WHERE qid='operation' AND gold<>'DONE'),6) AS premature_done_rate,
  round(avg(coalesce(choice='DONE',false)::INT::DOUBLE) FILTER (WHERE qid='operation' AND gold='DONE'),6) AS done_recall,
  count(*) FILTER (WHERE qid='operation' AND error IS NULL) AS n_ok,
  count(*) FILTER (WHERE qid='operation' AND error IS NULL AND allv) AS n_valid,
  round(avg((error IS NULL)::INT::DOUBLE) FILTER (WHERE qid='operation'),6) AS coverage,
  round(avg((error IS NULL AND allv)::INT::DOUBLE) FILTER (WHERE qid='operation'),6) AS success_rate,
  count(*) FILTER (WHERE qid<>'operation') AS n_targets,
  round(avg(brier) FILTER (WHERE qid='operation'),6) AS brier_operation,
  bool_and(dist OR NOT valid) AS has_distribution,
  round(avg(input_tokens) FILTER (WHERE qid='operation'),6) AS mean_input_tokens
  FROM b2 {grp}"""
_B2 = "SELECT *, bool_and(correct) OVER (PARTITION BY step_id) AS ok, bool_and(valid) OVER (PARTITION BY step_id) AS allv FROM bq"
_ECE1 = """SELECT subset, round(sum(abs(h-c))/sum(n),6) AS {name} FROM (
  SELECT subset, least(floor(least(greatest(conf,0),1)*10),9) AS b, count(*) AS n, sum(correct::INT)::DOUBLE AS h, sum(conf) AS c
  FROM b3 WHERE {cond} GROUP BY 1,2) GROUP BY subset"""
_B3 = "SELECT * FROM b2 UNION ALL SELECT * REPLACE ('(all)' AS subset) FROM b2"
_REPORT = dict(
    b2=_B2,
    b3=_B3,
    blk=_BLOCK.format(sub="'(all)'", grp="") + " UNION ALL " + _BLOCK.format(sub="subset", grp="GROUP BY subset"),
    e1=_ECE1.format(name="ece", cond="true"),
    e2=_ECE1.format(name="ece_operation", cond="qid='operation'"),
    e3=_ECE1.format(name="ece_target", cond="qid<>'operation'"),
    lat="""SELECT subset, round(quantile_cont(latency_s,0.5),6) AS latency_p50_s, round(quantile_cont(latency_s,0.95),6) AS latency_p95_s
      FROM b3 WHERE qid='operation' AND error IS NULL GROUP BY subset""",
)
_REPORT_SQL = O.sql(
    "bq", "SELECT * FROM blk LEFT JOIN e1 USING (subset) LEFT JOIN e2 USING (subset) LEFT JOIN e3 USING (subset) LEFT JOIN lat USING (subset)", **_REPORT
)


@query("job_bench_report", _REPORT_SQL)
def job_bench_report(spark, folder):
    return M.bench_report(_bench(spark, folder))


_FAMILY = ["subset", "n_items", "step_success", "operation_accuracy", "target_accuracy", "premature_done_rate", "ece"]


@query("overall_and_by_family", O.sql("bq", f"SELECT {', '.join(_FAMILY)} FROM blk LEFT JOIN e1 USING (subset)", **_REPORT))
def overall_and_by_family(spark, folder):
    return M.bench_scores(M.score_answers(_bench(spark, folder))).select(*_FAMILY)


_COVERAGE = ["subset", "n_items", "n_ok", "n_valid", "coverage", "success_rate", "has_distribution", "mean_input_tokens"]


@query("coverage", O.sql("bq", f"SELECT {', '.join(_COVERAGE)} FROM blk", **_REPORT))
def coverage(spark, folder):
    return M.bench_scores(M.score_answers(_bench(spark, folder))).select(*_COVERAGE)


@query(
    "error_counts",
    O.sql(
        "bq",
        """SELECT 'request:'||split_part(error,':',1) AS failure, count(*) AS n FROM bq WHERE error IS NOT NULL AND qid='operation' GROUP BY 1
        UNION ALL SELECT 'missing:'||split_part(qid,'_',1), count(*) FROM bq WHERE choice IS NULL GROUP BY 1""",
    ),
)
def error_counts(spark, folder):
    s = M.score_answers(_bench(spark, folder))
    missing = F.transform(
        F.filter("scored", lambda q: q["choice"].isNull()),
        lambda q: F.concat(F.lit("missing:"), F.split_part(q["qid"], F.lit("_"), F.lit(1))),
    )
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("request:"), F.split_part("error", F.lit(":"), F.lit(1))))
    both = F.array_compact(F.concat(missing, F.array(failed)))
    return s.select(F.explode_outer(both).alias("failure")).filter("failure is not null").groupBy("failure").agg(F.count("*").alias("n"))


@query(
    "majority_baseline",
    O.sql(
        "steps",
        """SELECT operation, round(n::DOUBLE/sum(n) OVER (),6) AS share FROM (SELECT operation, count(*) AS n FROM steps GROUP BY 1)
        ORDER BY n DESC, operation LIMIT 1""",
    ),
)
def majority_baseline(spark, folder):
    c = V.steps(spark, folder).groupBy("operation").agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("m"), "operation"))
    return c.agg(top.alias("t"), F.sum("n").alias("n")).select(
        F.col("t.operation").alias("operation"), M.r6(-F.col("t.m") / F.col("n")).alias("share")
    )


def _logits(spark, folder):
    return _ops(spark, folder).select("step_id", F.transform("w", lambda w: F.log(w)).alias("z"), "gold_idx")


_TEMPERATURES = [0.5, 1.0, 1.5, 2.0, 3.0]


@query(
    "temperature_nll",
    O.sql(
        "opts",
        """SELECT t AS temperature, round(avg(l),4) AS nll FROM (
        SELECT step_id, t, ln(sum(exp(ln(w)/t)))-max(CASE WHEN is_gold THEN ln(w)/t END) AS l
        FROM opts, (VALUES (0.5::DOUBLE),(1.0::DOUBLE),(1.5::DOUBLE),(2.0::DOUBLE),(3.0::DOUBLE)) v(t) WHERE qid='operation'
        GROUP BY step_id,t) GROUP BY t""",
    ),
)
def temperature_nll(spark, folder):
    out = M.nll_at(_logits(spark, folder), "z", "gold_idx", _TEMPERATURES)
    return out.select("temperature", F.round("nll", 4).alias("nll"))


@query("fit_temperature")
def fit_temperature(spark, folder):
    z = materialize(_logits(spark, folder), "logits")
    t = M.fit_temperature(z, "z", "gold_idx")
    parts = []
    for name, temp in (("before", 1.0), ("after", t)):
        p = z.withColumn("p", prob.softmax("z", temp)).select(
            F.array_max("p").alias("confidence"), (prob.argmax_first("p") == F.col("gold_idx")).alias("correct")
        )
        ece = M.calibration(p, "confidence", "correct", prob.bin_edges("confidence")).withColumn("temperature", F.lit(temp))
        nll = M.nll_at(z, "z", "gold_idx", [temp])
        parts.append(nll.join(ece, "temperature").select(F.lit(name).alias("stage"), "temperature", F.round("nll", 4).alias("nll"), F.round("ece", 4).alias("ece"), "n"))
    return parts[0].unionByName(parts[1])


_DONE_T = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
_CURVE = """SELECT t AS threshold, round(count(*) FILTER (WHERE gold='DONE' AND p_done>=t)::DOUBLE/greatest(count(*) FILTER (WHERE gold='DONE'),1),6) AS done_recall,
 round(count(*) FILTER (WHERE gold<>'DONE' AND p_done>=t)::DOUBLE/greatest(count(*) FILTER (WHERE gold<>'DONE'),1),6) AS premature_rate
 FROM qs, {ts} WHERE qid='operation' GROUP BY t"""


@query("threshold_grid", O.sql("qs", _CURVE.format(ts="(VALUES " + ",".join(f"({t}::DOUBLE)" for t in _DONE_T) + ") v(t)")))
def threshold_grid(spark, folder):
    rows = _ops(spark, folder).select("p_done", (F.col("gold") == "DONE").alias("gold_done"))
    return M.threshold_counts(rows, "p_done", "gold_done", _DONE_T)


@query(
    "threshold_curve",
    O.sql("qs", _CURVE.format(ts="(SELECT i/100::DOUBLE AS t FROM range(1,100) r(i)) v")),
)
def threshold_curve(spark, folder):
    rows = _ops(spark, folder).select("p_done", (F.col("gold") == "DONE").alias("gold_done"))
    return M.threshold_counts(rows, "p_done", "gold_done", [i / 100 for i in range(1, 100)])


_LJ = """SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS line, quality=1 AS label_done, toxic=1 AS judge_done FROM labels"""


@query(
    "label_judge_agreement",
    O.sql(
        "",
        """SELECT label_done, judge_done, count(*) AS n, round(avg((n_chars>=800)::INT::DOUBLE),6) AS said_done_rate
        FROM labels JOIN documents USING (doc_id), (SELECT 1) GROUP BY label_done, judge_done""".replace(
            "FROM labels JOIN documents USING (doc_id), (SELECT 1)",
            "FROM (SELECT quality=1 AS label_done, toxic=1 AS judge_done, n_chars FROM labels JOIN documents USING (doc_id))",
        ),
    ),
)
def label_judge_agreement(spark, folder):
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(
        (F.col("quality") == 1).alias("label_done"), (F.col("toxic") == 1).alias("judge_done")
    ).agg(F.count("*").alias("n"), M.r6(M.share(F.col("n_chars") >= 800)).alias("said_done_rate"))


_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
_AGREE_RULES = "SELECT 'choice' AS rule, -1.0::DOUBLE AS t" + "".join(f" UNION ALL SELECT '{t}', {t}::DOUBLE" for t in _THRESHOLDS)
_AGREE = [("recall_raw", "label"), ("recall_agree", "label AND judge"), ("premature_raw", "NOT label"), ("premature_agree", "NOT label AND NOT judge")]


@query(
    "agreement_analysis",
    O.sql(
        "qs steps verdicts",
        f"""SELECT rule, {", ".join(f"round(avg(hit::INT::DOUBLE) FILTER (WHERE {g}),6) AS {n}" for n, g in _AGREE)},
        {", ".join(f"count(*) FILTER (WHERE {g}) AS n_{n}" for n, g in _AGREE)}
        FROM (SELECT rule, label, judge, CASE WHEN t<0 THEN said ELSE p_done>=t END AS hit FROM ops, rules) GROUP BY rule""",
        rules=_AGREE_RULES,
        ops="""SELECT q.gold='DONE' AS label, q.pred='DONE' AS said, q.p_done, CASE WHEN q.gold='DONE' THEN v.judged_done ELSE NOT v.judged_done AND s.k%4=0 END AS judge
        FROM qs q JOIN steps s USING (step_id) JOIN verdicts v ON v.session=s.session WHERE q.qid='operation'""",
    ),
)
def agreement_analysis(spark, folder):
    """DONE metrics where the label and the episode's judge agree, beside those of the raw labels."""
    rows = _ops(spark, folder).join(V.verdicts(spark, folder), "session")
    label = F.col("gold") == "DONE"
    judge = F.when(label, F.col("judged_done")).otherwise(~F.col("judged_done") & (F.col("k") % 4 == 0))
    out = M.agreement_rates(rows, label, judge, F.col("pred") == "DONE", F.col("p_done"), _THRESHOLDS)
    return out.withColumns({n: M.r6(F.col(n)) for n, _ in _AGREE})


@query(
    "split_manifest",
    O.sql(
        "",
        f"""SELECT split, item, value, n FROM (
        SELECT split, 'rows' AS item, '' AS value, count(*)::DOUBLE AS n FROM p GROUP BY split UNION ALL
        SELECT split, 'sites', '', count(DISTINCT host) FROM p GROUP BY split UNION ALL
        SELECT split, 'mean_k', '', round_even(avg(k),1) FROM p GROUP BY split UNION ALL
        SELECT split, 'site', host, count(*) FROM p GROUP BY ALL UNION ALL
        SELECT split, 'op', op, count(*) FROM p GROUP BY ALL)""",
        h="SELECT page_id, lower(regexp_extract(url,'^https?://([^/:?#]+)',1)) AS host, length(url)::BIGINT AS k, CASE WHEN contains(url,'?') THEN 'CLICK' ELSE 'TYPE_TEXT' END AS op FROM pages",
        p=f"""SELECT *, CASE WHEN u<0.1::DOUBLE THEN 'test' WHEN u<0.1::DOUBLE+0.1::DOUBLE THEN 'dev' ELSE 'train' END AS split
          FROM (SELECT *, {O.unit(O.key(0, 'host'))} AS u FROM h)""",
    ),
)
def split_manifest(spark, folder):
    """Long form, one row per fact: a site list stays a relation, however many sites there are."""
    from stepline.functions.hashing import fraction_split, keyed
    from stepline.functions.text import hostname

    p = table(spark, folder, "pages").select(
        hostname(F.lit(""), "url").alias("host"),
        F.length("url").cast("long").alias("k"),
        F.when(F.contains("url", F.lit("?")), "CLICK").otherwise("TYPE_TEXT").alias("op"),
    ).withColumn("split", fraction_split(keyed(0, "host"), 0.1, 0.1))
    cells = p.groupBy("split", "host", "op").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    facts = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("item"), v.alias("value"))
                for i, v in (("site", F.col("host")), ("op", F.col("op")), ("rows", F.lit("")))
            ]
        )
    )
    counts = cells.select("split", "n", "k", facts.alias("f")).groupBy("split", "f.item", "f.value").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k")
    )
    plain = counts.select("split", "item", "value", F.col("n").cast("double").alias("n"))
    mean_k = counts.filter("item = 'rows'").select(
        "split", F.lit("mean_k").alias("item"), "value", F.bround(F.col("k") / F.col("n"), 1).alias("n")
    )
    sites = counts.filter("item = 'site'").groupBy("split").agg(F.count("*").cast("double").alias("n")).select(
        "split", F.lit("sites").alias("item"), F.lit("").alias("value"), "n"
    )
    return plain.unionByName(mean_k).unionByName(sites)


@query(
    "length_stats",
    O.sql(
        "",
        """SELECT (array_agg(n_chars ORDER BY n_chars))[count(*)//2+1]::DOUBLE AS median, max(n_chars)::DOUBLE AS longest FROM documents""",
    ),
)
def length_stats(spark, folder):
    d = table(spark, folder, "documents")
    out = order_statistics(d, [], "n_chars", {"median": (0.5, "upper"), "longest": (1.0, "lower")})
    return out.select("median", "longest")


@query(
    "leaderboard",
    O.sql(
        "qs",
        """SELECT model, """
        + ", ".join(f"round(max(acc) FILTER (WHERE subset='s{i}'),6) AS s{i}, coalesce(bool_or(acc=best) FILTER (WHERE subset='s{i}'),false) AS s{i}_best" for i in range(5))
        + " FROM g GROUP BY model",
        a="""SELECT 'first' AS model, subset, avg(correct::INT::DOUBLE) AS acc FROM qs GROUP BY subset UNION ALL
          SELECT 'target', subset, avg(correct::INT::DOUBLE) FROM qs WHERE qid<>'operation' AND subset<>'s4' GROUP BY subset""",
        g="SELECT *, max(acc) OVER (PARTITION BY subset) AS best FROM a",
    ),
)
def leaderboard(spark, folder):
    q = _questions(spark, folder)
    runs = q.select("subset", "correct", F.lit("first").alias("model")).unionByName(
        q.filter((F.col("qid") != "operation") & (F.col("subset") != "s4")).select("subset", "correct", F.lit("target").alias("model"))
    )
    acc = runs.groupBy("model", "subset").agg(M.share(F.col("correct")).alias("acc"))
    acc = acc.withColumn("best", F.col("acc") == F.max("acc").over(Window.partitionBy("subset")))
    subsets = [f"s{i}" for i in range(5)]
    wide = acc.groupBy("model").pivot("subset", subsets).agg(F.first("acc").alias("acc"), F.first("best").alias("best"))
    cols = []
    for s in subsets:
        cols += [M.r6(F.col(f"{s}_acc")).alias(s), F.coalesce(f"{s}_best", F.lit(False)).alias(f"{s}_best")]
    return wide.select("model", *cols)


@query("distinct_per_group", "SELECT source, count(DISTINCT lang) AS n_langs, count(DISTINCT text) AS n_texts FROM documents GROUP BY source")
def distinct_per_group(spark, folder):
    d = table(spark, folder, "documents")
    return d.groupBy("source").agg(F.countDistinct("lang").alias("n_langs")).join(
        d.select("source", F.xxhash64("text").alias("a"), F.md5("text").alias("b")).distinct().groupBy("source").agg(F.count("*").alias("n_texts")),
        "source",
    )


@query(
    "verified_success",
    O.sql(
        "episodes verdicts",
        """SELECT coalesce(source,'(all)') AS source, count(*) AS n, count(*) FILTER (WHERE outcome='done') AS claimed,
        count(*) FILTER (WHERE outcome='done' AND n_events>0 AND judged_done) AS verified,
        round(count(*) FILTER (WHERE outcome='done' AND n_events>0 AND judged_done)::DOUBLE/count(*),6) AS rate
        FROM episodes LEFT JOIN verdicts USING (session) GROUP BY ROLLUP(source)""",
    ),
)
def verified_success(spark, folder):
    e = V.episodes(spark, folder).join(V.verdicts(spark, folder), "session", "left")
    claimed = F.col("outcome") == "done"
    good = claimed & (F.col("n_events") > 0) & F.coalesce("judged_done", F.lit(False))
    return e.rollup("source").agg(
        F.count("*").alias("n"),
        F.count_if(claimed).alias("claimed"),
        F.count_if(good).alias("verified"),
        M.r6(F.count_if(good) / F.count("*")).alias("rate"),
    ).withColumn("source", F.coalesce("source", F.lit("(all)")))


@query(
    "paired_outcomes",
    O.sql(
        "episodes verdicts",
        """SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS both_solved, count(*) FILTER (WHERE b AND NOT a) AS gained,
        count(*) FILTER (WHERE a AND NOT b) AS lost FROM r1 JOIN r2 USING (task)""",
        r1="SELECT task, outcome='done' AS a FROM episodes",
        r2="SELECT task, session%3=0 AS b FROM episodes",
    ),
)
def paired_outcomes(spark, folder):
    e = V.episodes(spark, folder)
    r1 = e.select("task", (F.col("outcome") == "done").alias("a"))
    r2 = e.select("task", (F.col("session") % 3 == 0).alias("b"))
    return r1.join(r2, "task").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("a") & F.col("b")).alias("both_solved"),
        F.count_if(F.col("b") & ~F.col("a")).alias("gained"),
        F.count_if(F.col("a") & ~F.col("b")).alias("lost"),
    )


@query(
    "paired_outcomes_p",
    O.sql(
        "episodes",
        """SELECT n, both_solved, gained, lost, CASE WHEN gained+lost=0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2*(SELECT sum(exp(lgamma(gained+lost+1)-lgamma(i+1)-lgamma(gained+lost-i+1)-(gained+lost)*ln(2.0::DOUBLE)))
          FROM range(0,100000) r(i) WHERE i<=least(gained,lost))),6) END AS p_value FROM po""",
        r1="SELECT task, outcome='done' AS a FROM episodes",
        r2="SELECT task, session%3=0 AS b FROM episodes",
        po="""SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS both_solved, count(*) FILTER (WHERE b AND NOT a) AS gained,
          count(*) FILTER (WHERE a AND NOT b) AS lost FROM r1 JOIN r2 USING (task)""",
    ),
)
def paired_outcomes_p(spark, folder):
    return paired_outcomes(spark, folder).withColumn("p_value", M.r6(M.mcnemar_exact(F.col("gained"), F.col("lost"))))


@query(
    "prediction_drift",
    O.sql(
        "opts",
        """SELECT count(*) AS n, round(max(d),6) AS max_dp, count(*) FILTER (WHERE flip) AS flips FROM (
        SELECT step_id, qid, max(abs(p-p2)) AS d,
          (array_agg(j ORDER BY p DESC, j))[1]<>(array_agg(j ORDER BY p2 DESC, j))[1] AS flip
        FROM (SELECT *, w2/sum(w2) OVER (PARTITION BY step_id,qid) AS p2 FROM (
          SELECT *, CASE WHEN qid='operation' THEN (step_id*(j+4)+k*j)%17+1 ELSE (step_id*(j+6)+k)%13+1 END AS w2 FROM opts))
        GROUP BY step_id,qid)""",
    ),
)
def prediction_drift(spark, folder):
    s = V.steps(spark, folder)
    a = V.question_rows(V.with_questions(s, 3)).select("step_id", "qid", "p", "pred")
    b = V.question_rows(V.with_questions(s, 4)).select("step_id", "qid", F.col("p").alias("p2"), F.col("pred").alias("pred2"))
    gap = F.array_max(F.zip_with("p", "p2", lambda x, y: F.abs(x - y)))
    return a.join(b, ["step_id", "qid"]).agg(
        F.count("*").alias("n"), M.r6(F.max(gap)).alias("max_dp"), F.count_if(F.col("pred") != F.col("pred2")).alias("flips")
    )


@query(
    "context_drop_correction",
    O.sql(
        "bq",
        """SELECT system, benchmark, n, round(acc*n/max(n) OVER (PARTITION BY benchmark),6) AS corrected FROM (
        SELECT 'all' AS system, subset AS benchmark, count(*) AS n, avg(correct::INT::DOUBLE) AS acc FROM bq GROUP BY subset
        UNION ALL SELECT 'short', subset, count(*), avg(correct::INT::DOUBLE) FROM bq WHERE input_tokens<=60 GROUP BY subset)""",
    ),
)
def context_drop_correction(spark, folder):
    q = M.score_answers(_bench(spark, folder)).select("subset", "input_tokens", F.explode_outer("scored").alias("q"))
    systems = F.array_compact(F.array(F.lit("all"), F.when(F.col("input_tokens") <= 60, F.lit("short"))))
    acc = (
        q.select(F.explode_outer(systems).alias("system"), F.col("subset").alias("benchmark"), "q.correct")
        .groupBy("system", "benchmark")
        .agg(F.count("*").alias("n"), M.share(F.col("correct")).alias("acc"))
    )
    most = F.max("n").over(Window.partitionBy("benchmark"))
    return acc.select("system", "benchmark", "n", M.r6(F.col("acc") * F.col("n") / most).alias("corrected"))


@query(
    "running_success",
    O.sql(
        "qs",
        """SELECT seen, step_success FROM (SELECT row_number() OVER (ORDER BY step_id) AS seen, round(avg(ok::INT::DOUBLE) OVER (ORDER BY step_id),6) AS step_success
        FROM (SELECT step_id, bool_and(correct) AS ok FROM qs GROUP BY step_id)) WHERE seen%200=0""",
    ),
)
def running_success(spark, folder):
    s = _scored(spark, folder).select("step_id", M.all_right("questions").cast("long").alias("ok"))
    return M.running_share(s, "step_id", "ok", 200).select("seen", M.r6("share").alias("step_success"))


@query(
    "premature_cases",
    O.sql(
        "qs",
        """SELECT q.step_id, q.gold, round(q.p_done,6) AS p_done, substring(s.props,1,1500) AS page_text FROM qs q JOIN steps s USING (step_id)
        WHERE q.qid='operation' AND q.pred='DONE' AND q.gold<>'DONE'""",
    ),
)
def premature_cases(spark, folder):
    q = F.col("questions")[0]
    s = _scored(spark, folder).select(
        "step_id",
        q["keys"][q["gold"]].alias("gold"),
        q["keys"][q["pred"]].alias("pred"),
        M.r6(q["p"][4]).alias("p_done"),
        F.substring("props", 1, 1500).alias("page_text"),
    )
    return s.filter("pred = 'DONE' and gold <> 'DONE'").drop("pred")
