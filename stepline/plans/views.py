"""Decision-step relations derived from the given tables.

Everything a metric needs stays nested in the step row (one array of questions), so that
scoring a step is a narrow, shuffle-free projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.functions import prob
from stepline.sources.tables import table

# fixed values: the operations of the derived steps, in option order, with the event each stands for
OPERATIONS = ["CLICK", "TYPE_TEXT", "SCROLL_DOWN", "BLOCKED", "DONE"]
EVENT_OPERATION = {
    "click": "CLICK",
    "signup": "TYPE_TEXT",
    "view": "SCROLL_DOWN",
    "error": "BLOCKED",
    "purchase": "DONE",
}


def lookup(mapping: dict[str, str], c: Column) -> Column:
    """Value of a small fixed mapping; null when the key is absent."""
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return steps_of(table(spark, folder, "events"))


def steps_of(e: DataFrame) -> DataFrame:
    """Decision steps of an events relation, batch or streaming."""
    return e.select(
        F.col("event_id").alias("step_id"),
        F.col("user_id").alias("session"),
        "ts",
        "event_type",
        lookup(EVENT_OPERATION, F.col("event_type")).alias("operation"),
        F.concat(F.lit("s"), F.col("user_id") % 5).alias("subset"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("value") / 1000).alias("latency_s"),
        "value",
        F.when(F.col("event_id") % 97 == 0, "Timeout: x").alias("error"),
        "props",
    )


def with_questions(s: DataFrame, shift: int = 3) -> DataFrame:
    """Adds ``questions``: the operation question and, for a click, its target question.

    ``shift`` varies the predicted distribution, for comparing two prediction sets.
    """
    sid, k, n = F.col("step_id"), F.col("k"), len(OPERATIONS)
    # the operation question has a fixed menu: plain columns, staged so that each is computed once
    staged = s.withColumns({f"_w{j}": ((sid * (j + shift) + k * j) % 17 + 1).cast("double") for j in range(n)})
    w = [F.col(f"_w{j}") for j in range(n)]
    staged = staged.withColumn("_mass", sum(w[1:], w[0]))
    staged = staged.withColumns({f"_p{j}": w[j] / F.col("_mass") for j in range(n)})
    p = [F.col(f"_p{j}") for j in range(n)]
    staged = staged.withColumn("_top", F.greatest(*p))
    pred, gold = F.lit(n - 1), F.lit(n - 1)
    for j in reversed(range(n - 1)):
        pred = F.when(p[j] == F.col("_top"), j).otherwise(pred)
        gold = F.when(F.col("operation") == OPERATIONS[j], j).otherwise(gold)
    staged = staged.withColumns({"_pred": pred, "_gold": gold})
    op_q = F.struct(
        F.lit("operation").alias("qid"),
        F.array(*[F.lit(o) for o in OPERATIONS]).alias("keys"),
        F.array(*w).alias("w"),
        F.col("_gold").alias("gold"),
        F.col("_mass").alias("mass"),
        F.array(*p).alias("p"),
        F.col("_top").alias("confidence"),
        F.col("_pred").alias("pred"),
        (F.col("_pred") == F.col("_gold")).alias("correct"),
    )
    # the target question has as many options as the page has elements
    n_targets = (F.lit(2) + sid % 7).cast("int")
    indices = F.sequence(F.lit(0), n_targets - 1)
    target = F.array(
        F.struct(
            F.lit("click_target").alias("qid"),
            F.transform(indices, lambda j: (j + 1).cast("string")).alias("keys"),
            F.transform(indices, lambda j: ((sid * (j + 2 + shift) + k) % 13 + 1).cast("double")).alias("w"),
            (sid % n_targets).cast("int").alias("gold"),
        )
    )
    target = prob.extend(target, mass=lambda q: prob.total(q["w"]))
    target = prob.extend(target, p=lambda q: F.transform(q["w"], lambda x: x / q["mass"]))
    target = prob.extend(target, confidence=lambda q: F.array_max(q["p"]))
    target = prob.extend(target, pred=lambda q: (F.array_position(q["p"], q["confidence"]) - 1).cast("int"))
    target = prob.extend(target, correct=lambda q: q["pred"] == q["gold"])
    questions = F.when(F.col("operation") == "CLICK", F.concat(F.array(op_q), target)).otherwise(F.array(op_q))
    return staged.withColumn("questions", questions).select(*s.columns, "questions")


def question_rows(s: DataFrame) -> DataFrame:
    """One row per (step, question).

    Outer, because every step has a question: the inner form would make the optimizer
    evaluate the array a second time below, to drop empty ones.
    """
    return s.select(*[c for c in s.columns if c != "questions"], F.explode_outer("questions").alias("q")).select(
        *[c for c in s.columns if c != "questions"], "q.*"
    )


def with_answers(s: DataFrame) -> DataFrame:
    """Adds what an endpoint returned per question: choice and probabilities, some of them unusable."""
    sid = F.col("step_id")

    def answer(q: Column) -> Column:
        choice = F.when(sid % 89 == 0, F.lit("OTHER")).otherwise(q["keys"][q["pred"]])
        scale = F.when(sid % 79 == 0, F.lit(1.1)).otherwise(F.lit(1.0))
        p = F.map_from_arrays(q["keys"], F.transform(q["p"], lambda x: x * scale))
        return F.struct(
            q["qid"].alias("qid"),
            q["keys"].alias("options"),
            q["keys"][q["gold"]].alias("gold"),
            F.when(F.col("error").isNull(), choice).alias("choice"),
            F.when(F.col("error").isNull() & (sid % 83 != 0), p).alias("probabilities"),
        )

    return s.withColumn("answers", F.transform("questions", answer)).withColumn(
        "input_tokens", F.when(F.col("error").isNull(), F.length("props") + F.col("k"))
    )


# fixed values: outcome and task source of the derived episodes
OUTCOMES = ["done", "blocked", "error", "budget"]
TASK_SOURCES = ["walks", "flights", "wikipedia"]


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """One finished episode per user; some users have none."""
    u = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))
    uid = F.col("user_id")
    return u.filter(uid % 11 != 0).select(
        uid.alias("session"),
        F.format_string("task-%05d", uid).alias("task"),
        F.element_at(F.array(*[F.lit(x) for x in TASK_SOURCES]), (uid % 3 + 1).cast("int")).alias("source"),
        F.element_at(F.array(*[F.lit(x) for x in OUTCOMES]), (uid % 4 + 1).cast("int")).alias("outcome"),
        F.when(uid % 8 == 2, "StalePage: x").otherwise(F.lit("")).alias("error"),
        "n_events",
    )


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The decision log: steps with a reason and a request signature."""
    return decisions_of(steps(spark, folder))


def decisions_of(s: DataFrame) -> DataFrame:
    return s.select(
        "step_id",
        "session",
        "ts",
        "operation",
        F.when(F.col("operation") == "BLOCKED", F.when(F.col("step_id") % 3 == 0, "captcha page").otherwise("loop"))
        .otherwise(F.concat(F.lit("go on "), F.col("k")))
        .alias("reason"),
        F.concat_ws("|", F.col("operation"), F.col("k") % 20).alias("request"),
        "k",
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Judge verdict per episode."""
    u = table(spark, folder, "events").select("user_id").distinct()
    return u.select(F.col("user_id").alias("session"), (F.col("user_id") % 5 != 0).alias("judged_done"))


LOWER = "abcdefghijklmnopqrstuvwxyz"


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Training states: the documents, and re-spaced, re-cased copies of the benchmark items."""
    d = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("state"), "source"
    )
    b = table(spark, folder, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("id"),
        F.translate(F.replace("text", F.lit(" "), F.lit("  ")), LOWER, LOWER.upper()).alias("state"),
        F.lit("benchmark-copy").alias("source"),
    )
    return d.unionByName(b)


FLAT_TAGS = r"<(a|p|li|h1)(?:\s[^>]*)?>([^<]*)"


# fixed values: what the flat tags are called in the pages built from them, where they nest freely
NESTED_TAGS = {"p": "span", "li": "em"}


def built_pages(spark: SparkSession, folder: str) -> DataFrame:
    """HTML of a known tree: the flat tags and texts of each page, in blocks of eight, four and two by their place.

    Every element has an id (f and its place) and two classes (c and its place modulo 3, k and modulo 4).
    """
    p = table(spark, folder, "pages")
    tags = F.regexp_extract_all("html", F.lit(FLAT_TAGS), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(FLAT_TAGS), F.lit(2))
    renamed = F.transform(tags, lambda t: F.coalesce(lookup(NESTED_TAGS, t), t))
    found = p.select("page_id", "url", renamed.alias("tags"), texts.alias("texts")).where(F.size("tags") > 0)

    def close(i: Column) -> Column:
        return F.concat(F.lit("</"), F.get("tags", i), F.lit(">"))

    def element(i: Column) -> Column:
        place = i.cast("string")
        named = F.concat(F.lit('<'), F.get("tags", i), F.lit(' id="f'), place, F.lit('" class="c'), (i % 3).cast("string"), F.lit(" k"), (i % 4).cast("string"), F.lit('">'))
        ends = F.concat(
            F.when(i % 2 == 1, close(i)).otherwise(""),
            F.when(i % 4 == 3, close(i - 1)).otherwise(""),
            F.when(i % 8 == 7, F.concat(close(i - 3), close(i - 7))).otherwise(""),
        )
        return F.concat(named, F.replace(F.get("texts", i), F.lit("&"), F.lit("&amp;")), ends)

    html = F.array_join(F.transform(F.sequence(F.lit(0), F.size("tags") - 1), element), "")
    return found.select("page_id", "url", html.alias("html"))


def flat_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The elements of the built pages, as the page parser finds them, with their own first text."""
    from stepline.functions.text import clip
    from stepline.operators.pages import page_nodes

    pages = built_pages(spark, folder)
    own = F.coalesce(F.get("runs", F.lit(0))["text"], F.lit(""))
    long = {c: F.col(c).cast("long") for c in ("pre", "last", "parent")}
    n = page_nodes(pages.select("page_id", "html"), text_chars=1000).withColumns(long).withColumn("raw", own)
    return n.select("page_id", "pre", "last", "parent", "tag", "attrs", "raw", clip("raw").alias("label"))
