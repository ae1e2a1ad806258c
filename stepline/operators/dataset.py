"""Corpus filters, recasting, leak checks and the published step table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions import prob
from stepline.functions.actions import first_failure
from stepline.functions.text import hostname, norm_goal, norm_state
from stepline.operators.ordering import line_position
from stepline.operators.prompts import row_id

# fixed values: goals with effects in the real world
UNSAFE_GOAL = (
    r"(?iU)\b(buy|purchas|order|book(?!s\b)|reserv|sign ?(in|up)|log ?in|login|register|subscri|post(?!al)|"
    r"comment|repl(y|ies)|send|email|message|pay|checkout|cart|donat|apply|upload|delete|remove|"
    r"save|follow|like|share|rate|review|account|password|download|install)"
)
QUESTION_TYPES = ["choice", "noul", "score"]
MAX_URL, MIN_LOADED_TEXT = 300, 200


def valid_question(kind: Column, n_options: Column) -> Column:
    """A question the request format allows."""
    n = F.coalesce(n_options, F.lit(0))
    return (
        F.when(kind == "choice", n.between(1, prob.MAX_OPTIONS))
        .when(kind == "score", n.between(2, prob.MAX_OPTIONS))
        .otherwise(F.coalesce(kind == "noul", F.lit(False)))
    )


def servable(n_options: Column, lenient: bool = False) -> Column:
    """Every question has 1..255 options. Missing criteria count as none; the lenient rule lets them pass."""
    low = 0 if lenient else 1
    return F.forall(n_options, lambda n: F.coalesce(n, F.lit(0)).between(low, prob.MAX_OPTIONS))


def over_budget(state: Column, question: Column, max_state: int, max_question: int, max_total: int | None = None) -> Column:
    """Which limit a row breaks first, in length units of the caller; null when it fits."""
    rules = [(state > max_state, "state"), (question > max_question, "question")]
    if max_total is not None:
        rules.append((state + question > max_total, "total"))
    return first_failure(rules)


def unsafe_goal(goal: Column) -> Column:
    return goal.rlike(UNSAFE_GOAL)


def unloaded_done(operation: Column, n_elements: Column, text: Column) -> Column:
    """DONE on a page that had not loaded: no elements and almost no text."""
    return (operation == "DONE") & (F.coalesce(n_elements, F.lit(0)) == 0) & (F.length(F.coalesce(text, F.lit(""))) < MIN_LOADED_TEXT)


def recast_single(df: DataFrame) -> DataFrame:
    """One-question corpus rows (kind, options, target, state, question) with ``label`` and ``soft``.

    Rows that do not make a valid question drop out: lengths differ, options repeat or are
    too few or too many, text is missing, a noul without both answers.
    """
    kind, opts, target = F.col("kind"), F.col("options"), F.col("target")
    n = F.size("options")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    sound = (n == F.size("target")) & (n > 0) & text("state") & text("question")
    base = df.filter(sound).withColumn("_best", prob.argmax_first("target"))
    # later entries win when two spellings fold to one
    lowered = F.transform(opts, lambda o: F.lower(o))
    last = lambda name: F.element_at(F.filter(F.transform(F.arrays_zip(lowered.alias("o"), target.alias("t")), lambda x: F.when(x["o"] == name, x["t"])), lambda t: t.isNotNull()), -1)
    have = lambda name: F.array_contains(lowered, name)
    p_true = F.when(have("true"), last("true")).when(have("yes"), last("yes"))
    p_false = F.when(have("false"), last("false")).when(have("no"), last("no"))
    base = base.withColumns({"_t": p_true, "_f": p_false})
    ok = (
        F.when(kind == "choice", (F.size(F.array_distinct(opts)) == n) & n.between(2, prob.MAX_OPTIONS))
        .when(kind == "noul", F.col("_t").isNotNull() & F.col("_f").isNotNull())
        .when(kind == "score", n.between(2, prob.MAX_OPTIONS))
        .otherwise(False)
    )
    label = (
        F.when(kind == "choice", F.element_at(opts, F.col("_best") + 1))
        .when(kind == "noul", (F.col("_t") >= F.col("_f")).cast("string"))
        .otherwise(F.col("_best").cast("string"))
    )
    soft = F.when(kind == "noul", F.array("_f", "_t")).otherwise(target)
    return base.filter(ok).withColumn("label", label).withColumn("soft", soft).drop("_best", "_t", "_f")


def cast_label(kind: Column, raw: Column) -> Column:
    """noul, score or choice value of a raw label, each in its own field."""
    return F.struct(
        F.when(kind == "noul", F.lower(raw) == "true").alias("noul"),
        F.when(kind == "score", raw.try_cast("int")).alias("score"),
        F.when(~kind.isin("noul", "score"), raw).alias("choice"),
    )


def split_embedded_labels(questions_json: Column) -> Column:
    """Questions that carry their label: struct<labels map, questions map> with the label taken out."""
    q = F.from_json(questions_json, "map<string,struct<type:string,instructions:string,criteria:string,label:string>>")
    return F.struct(
        F.transform_values(q, lambda _, v: v["label"]).alias("labels"),
        F.transform_values(
            q, lambda _, v: F.struct(v["type"].alias("type"), v["instructions"].alias("instructions"), v["criteria"].alias("criteria"))
        ).alias("questions"),
    )


def same_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def train_and_eval(df: DataFrame, line: str, n_eval: int) -> DataFrame:
    """Rows of the train split as train; the others as eval, or the last train rows when there are no others.

    ``part`` is set per use, so a fallback row appears in both parts.
    """
    train = df.filter("split = 'train'")
    others = df.filter("split <> 'train'")
    if others.isEmpty():
        n = train.count()
        others = line_position(train, line, "_at").filter(F.col("_at") > n - n_eval).drop("_at")
    return train.withColumn("part", F.lit("train")).unionByName(others.withColumn("part", F.lit("eval")))


def decontaminate(df: DataFrame, state: str, held_out: DataFrame, held_state: str) -> DataFrame:
    """Rows whose normalised state does not occur in a held-out set.

    The held-out side is reduced to distinct digests; Spark broadcasts it only while its
    measured size allows, and joins by shuffle beyond that.
    """
    digest = lambda c: F.sha2(norm_state(c), 256)
    seen = held_out.select(digest(held_state).alias("_d")).distinct()
    return df.withColumn("_d", digest(state)).join(seen, "_d", "left_anti").drop("_d")


def leak_checked_splits(rows: DataFrame, teacher_configs: list[str]) -> DataFrame:
    """Held-out rows of the teacher configs become test only when neither task nor goal is in any train split.

    Null task ids and empty goals match like any other value; one flag each answers for them,
    so that they are no join keys on which all such rows would meet.
    """
    pending = F.col("config").isin(*teacher_configs) & (F.col("split") == "dev")
    train = rows.filter("split = 'train'")
    blank = train.agg(F.max(F.col("task_id").isNull()).alias("id"), F.max(norm_goal("goal") == "").alias("goal")).first()
    ids = train.select(F.col("task_id").alias("_id")).filter("_id is not null").distinct().withColumn("_by_id", F.lit(True))
    goals = train.select(norm_goal("goal").alias("_goal")).filter("_goal <> ''").distinct().withColumn("_by_goal", F.lit(True))
    open_rows = rows.filter(pending).withColumn("_g", F.nullif(norm_goal("goal"), F.lit("")))
    flagged = open_rows.join(ids, F.col("task_id") == F.col("_id"), "left").join(goals, F.col("_g") == F.col("_goal"), "left")
    by_id = F.when(F.col("task_id").isNull(), F.lit(bool(blank["id"]))).otherwise(F.coalesce("_by_id", F.lit(False)))
    by_goal = F.when(F.col("_g").isNull(), F.lit(bool(blank["goal"]))).otherwise(F.coalesce("_by_goal", F.lit(False)))
    seen = by_id | by_goal
    placed = flagged.withColumn("split", F.when(seen, "validation").otherwise("test")).select(*rows.columns)
    rest = rows.filter(~pending).withColumn("split", F.when(F.col("split") == "dev", "validation").otherwise(F.col("split")))
    return rest.unionByName(placed)


def task_overlap(rows: DataFrame, eval_tasks: DataFrame) -> DataFrame:
    """Evaluation tasks met in each config and split, by id or by goal: one row per (place, task) with its row count."""
    ids = eval_tasks.select(F.col("id").alias("task_id"), F.col("id").alias("_by_id")).distinct()
    goals = eval_tasks.groupBy(norm_goal("goal").alias("_g")).agg(F.max("id").alias("_by_goal"))
    hit = rows.withColumn("_g", norm_goal("goal")).join(ids, "task_id", "left").join(goals, "_g", "left")
    task = F.coalesce("_by_id", "_by_goal")
    kind = F.when(F.col("split") == "train", "train").otherwise("other")
    place = F.concat_ws("/", "config", "split")
    return hit.filter(task.isNotNull()).groupBy(kind.alias("kind"), place.alias("place"), task.alias("task")).agg(
        F.count("*").alias("rows")
    )


STATE_TYPE = (
    "struct<page:struct<url:string,title:string,text:string>,"
    "elements:array<struct<role:string,label:string,value:string,index:string,operations:array<string>,"
    "options:array<struct<index:string,label:string,value:string>>>>,"
    "recent_actions:array<struct<action:string,kind:string,text:string,page_changed:boolean>>>"
)
REQUEST_TYPE = (
    f"struct<state:{STATE_TYPE},questions:map<string,struct<type:string,instructions:struct<goal:string>,"
    "criteria:map<string,string>>>>"
)


def flatten_steps(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The published columns of step rows (config, split, collection, request, labels, meta as JSON).

    Each JSON text is parsed once; which field names the task depends on the config.
    """
    parsed = rows.withColumns(
        {
            "_r": F.from_json("request", REQUEST_TYPE),
            "_l": F.from_json("labels", "map<string,string>"),
            "_m": F.from_json("meta", "map<string,string>"),
        }
    )
    m = lambda k: F.try_element_at("_m", F.lit(k))
    page = F.col("_r.state.page")
    empty = lambda c: F.coalesce(c, F.lit(""))
    target_q = F.try_element_at(F.filter(F.map_keys("_l"), lambda k: k != "operation"), F.lit(1))
    question = F.try_element_at("_r.questions", F.col("target_question"))
    human, traced = F.col("config") == "human", F.col("config") == "traces"
    task = F.when(human, m("annotation_id")).when(traced, m("trace")).otherwise(m("task"))
    episode = F.when(human | traced, task).otherwise(F.coalesce(m("episode"), m("id")))
    site = F.when(human, m("website")).when(traced, m("host"))
    flat = parsed.withColumn("target_question", target_q).withColumn("target", F.try_element_at("_l", F.col("target_question")))
    element = F.get_json_object(F.try_element_at(question["criteria"], F.col("target")), "$.element")
    return flat.select(
        "config", "split",
        row_id(F.col("request"), F.col("labels")).alias("id"),
        empty(page["url"]).alias("url"), empty(page["title"]).alias("title"),
        empty(F.try_element_at("_r.questions", F.lit("operation"))["instructions"]["goal"]).alias("goal"),
        F.greatest(F.size("_r.state.elements"), F.lit(0)).alias("n_elements"),
        F.greatest(F.size("_r.state.recent_actions"), F.lit(0)).alias("n_recent_actions"),
        F.try_element_at("_l", F.lit("operation")).alias("operation"),
        "target_question", "target", element.alias("target_element"), m("source").alias("source"), "collection",
        hostname(site, empty(page["url"])).alias("website"), task.alias("task_id"), episode.alias("episode_id"),
        m("actor").alias("actor"), m("teacher").alias("teacher"), m("reason").alias("reason"), "request", "labels", "meta", *keep,
    )


def n_options_of(request_json: Column) -> Column:
    """Options per question of a request: array with null where criteria are missing."""
    q = F.from_json(F.get_json_object(request_json, "$.questions"), "map<string,struct<criteria:string>>")
    count = lambda c: F.coalesce(F.size(F.json_object_keys(c)), F.json_array_length(c))
    sized = lambda v: F.when(v["criteria"].isNotNull(), count(v["criteria"]))
    return F.transform(F.map_values(q), sized)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
