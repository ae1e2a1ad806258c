"""Candidates, questions and requests of one step.

A step's candidates are at most the elements of one page and, after sampling, at most
k_max; grouping by step therefore never gathers more than one page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions.actions import first_failure
from stepline.functions.hashing import keyed, uniform, uniform_int
from stepline.functions.text import norm_ws
from stepline.operators.ordering import first_per_group
from stepline.operators.pages import with_gold_operation

# fixed values: what each operation is called in a question
OPERATION_TEXT = {
    "CLICK": "Click an element, button, menu option, autocomplete suggestion, or calendar day.",
    "TYPE_TEXT": "Enter or replace text in an editable field. A small LLM will supply the value from the goal.",
    "SELECT": "Select an observed dropdown value.",
    "SCROLL_DOWN": "Scroll down",
    "SCROLL_UP": "Scroll up",
    "WAIT": "Wait for the page to update",
    "DONE": "Every requirement is visibly satisfied.",
    "BLOCKED": "No supported operation can progress.",
}
TARGET_OPERATIONS = ["CLICK", "TYPE_TEXT", "SELECT"]
MAX_SELECT_OPTIONS = 60
ENTRY_TYPE = "struct<op:string,key:string,element:string,gold:boolean,current_value:string,target_role:string>"
P_SCROLL_DOWN, P_SCROLL_UP = 0.8, 0.3
K_MIN, K_MAX = 8, 40


def near_gold(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Per step: its gold node, and the candidates of its page that are no kin of it.

    ``steps``: step columns, page_id, gold, gold_last, hit, and positives, the places of all
    recorded positives of the step or null: other positives are no negatives. Everything
    that follows works per step, so the rows are laid out by step once.
    """
    pre = F.col("pre")
    is_gold = F.coalesce(pre == F.col("gold"), F.lit(False))
    kin = pre.between(F.col("gold"), F.col("gold_last")) | F.col("gold").between(pre, F.col("last")) | (pre == F.col("hit"))
    kin = F.coalesce(kin, F.lit(False)) | F.coalesce(F.array_contains("positives", pre.cast("long")), F.lit(False))
    near = nodes.join(steps, "page_id").withColumn("is_gold", is_gold)
    return near.filter(F.col("is_gold") | (F.col("candidate") & ~kin))


def unique_labels(rows: DataFrame, step: Sequence[str]) -> DataFrame:
    """Rows with a label of their own within the step: the gold's wins, else the first in page order."""
    return first_per_group(rows, [*step, F.lower("label")], [F.desc("is_gold"), F.col("pre")]).drop("_rn")


def offered(rows: DataFrame, step: Sequence[str], seed: int | str, k_min: int = K_MIN, k_max: int = K_MAX) -> DataFrame:
    """k elements per step, the gold among them, others drawn by weight; numbered by a keyed order.

    Adds ``index`` (from 1) and ``n_negatives``, the candidates there were to draw from.
    """
    k = uniform_int(f"{seed}-k", k_min, k_max, *step)
    draw = F.pow(uniform(f"{seed}-draw", *step, "pre"), F.lit(1.0) / F.col("weight"))
    drawn = Window.partitionBy(*step).orderBy(F.desc("is_gold"), draw.desc(), "pre")
    every = Window.partitionBy(*step)
    placed = rows.withColumn("_at", F.row_number().over(drawn)).withColumn("n_negatives", F.count_if(~F.col("is_gold")).over(every))
    order = Window.partitionBy(*step).orderBy(keyed(f"{seed}-order", *step, "pre"), "pre")
    return placed.filter(F.col("_at") <= k).drop("_at").withColumn("index", F.row_number().over(order))


def capped_select_options(options: Column, is_gold: Column, wanted: Column, seed: str, *key: str) -> Column:
    """At most 60 options with their 1-based page place ``j``: wanted ones stay, others are drawn, page order holds."""
    placed = F.transform(
        options, lambda o, i: F.struct((i + 1).alias("j"), o["label"].alias("label"), o["value"].alias("value"))
    )
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    match = lambda o: is_gold & (norm(wanted) != "") & ((norm(o["label"]) == norm(wanted)) | (norm(o["value"]) == norm(wanted)))
    ranked = F.array_sort(
        F.transform(
            placed,
            lambda o: F.struct(
                (~match(o)).alias("later"), F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key], o["j"].cast("string")), 256).alias("h"), o.alias("o")
            ),
        )
    )
    kept = F.array_sort(F.transform(F.slice(ranked, 1, MAX_SELECT_OPTIONS), lambda r: r["o"]))
    return F.when(F.size(options) > MAX_SELECT_OPTIONS, kept).otherwise(placed)


def shown_element(index: Column, label: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), label)


def element_targets(e: Column, wanted: Column, with_options: bool = True) -> Column:
    """What an element can be the target of: array of entries, typing, clicking, then its options.

    A click on an editable field reads "Open <label>"; a dropdown offers its options as
    ``index:j``, and the gold's wanted option is the gold target.
    """
    can = lambda op: F.array_contains(e["operations"], op)
    index = e["index"].cast("string")

    def one(op: str, key: Column, label: Column, gold: Column) -> Column:
        return F.struct(
            F.lit(op).alias("op"), key.alias("key"), shown_element(e["index"], label).alias("element"), gold.alias("gold"),
            F.coalesce(e["value"], F.lit("")).alias("current_value"), F.coalesce(e["role"], F.lit("")).alias("target_role"),
        )

    click_label = F.when(can("TYPE_TEXT"), F.concat(F.lit("Open "), e["label"])).otherwise(e["label"])
    plain = F.array_compact(
        F.array(
            F.when(can("TYPE_TEXT"), one("TYPE_TEXT", index, e["label"], e["is_gold"])),
            F.when(can("CLICK"), one("CLICK", index, click_label, e["is_gold"])),
        )
    )
    if not with_options:
        return plain
    w = F.lower(norm_ws(wanted))
    options = F.transform(
        e["options"],
        lambda o: one(
            "SELECT",
            F.concat(index, F.lit(":"), o["j"].cast("string")),
            F.concat(e["label"], F.lit(" → "), o["label"]),
            e["is_gold"] & (w != "") & ((F.lower(norm_ws(o["label"])) == w) | (F.lower(norm_ws(o["value"])) == w)),
        ),
    )
    return F.when(can("SELECT"), F.concat(plain, options)).otherwise(plain)


def criteria_of(entries: Column, op: str) -> Column:
    """Map of target key to its description for one operation, in element order; null without targets."""
    mine = F.filter(entries, lambda t: t["op"] == op)
    described = lambda t: F.struct(t["element"].alias("element"), t["current_value"].alias("current_value"), t["target_role"].alias("role"))
    return F.when(F.size(mine) > 0, F.map_from_entries(F.transform(mine, lambda t: F.struct(t["key"], described(t)))))


def gold_target(entries: Column, op: Column) -> Column:
    """Key of the first gold target of an operation."""
    return F.try_element_at(F.filter(entries, lambda t: t["gold"] & (t["op"] == op)), F.lit(1))["key"]


def operation_menu(present: Column, seed: str, key: Sequence[str], fixed_scroll: bool = False, scrolled: Column | None = None) -> Column:
    """Operations on offer, in order. ``present``: operations that have a target.

    Human traces: scrolling is offered at random. Trees: down always, up only after a
    scroll down (or when it is the answer).
    """
    order = F.array_sort(F.transform(present, lambda o: F.struct(F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key], o), 256).alias("h"), o.alias("o"))))
    shuffled = F.transform(order, lambda x: x["o"])
    down = F.lit(True) if fixed_scroll else uniform(f"{seed}-down", *key) < P_SCROLL_DOWN
    up = scrolled if fixed_scroll else uniform(f"{seed}-up", *key) < P_SCROLL_UP
    fixed = F.array_compact(
        F.array(F.when(down, F.lit("SCROLL_DOWN")), F.when(up, F.lit("SCROLL_UP")), F.lit("WAIT"), F.lit("DONE"), F.lit("BLOCKED"))
    )
    return F.concat(shuffled, fixed)


def operation_criteria(menu: Column) -> Column:
    """Map of offered operations to their wording."""
    words = F.create_map(*[F.lit(x) for kv in OPERATION_TEXT.items() for x in kv])
    return F.map_from_arrays(menu, F.transform(menu, lambda o: F.try_element_at(words, o)))


def assemble(step: DataFrame, op_rules: str = "", target_rules: str = "") -> DataFrame:
    """request and labels as JSON of a step with goal, op, page, elements, history, menu, criteria and gold_key.

    The wording of the rules that go with each question is the caller's.
    """
    op = F.col("op")
    qid = F.concat(F.lower(op), F.lit("_target"))
    target = F.col("gold_key")
    goal = F.col("goal").alias("goal")
    op_q = F.struct(
        F.lit("choice").alias("type"),
        operation_criteria(F.col("menu")).alias("criteria"),
        F.struct(goal, F.lit(op_rules).alias("rules")).alias("instructions"),
    )
    criteria = F.when(op == "CLICK", F.col("criteria_click")).when(op == "TYPE_TEXT", F.col("criteria_type_text")).otherwise(F.col("criteria_select"))
    rules = F.array(F.lit(op_rules), F.lit(target_rules))
    t_q = F.struct(
        F.lit("choice").alias("type"), criteria.alias("criteria"), F.struct(goal, op.alias("operation"), rules.alias("rules")).alias("instructions")
    )
    state = F.struct(
        F.struct("url", "title", F.col("page_text").alias("text")).alias("page"), "elements", F.col("history").alias("recent_actions")
    )
    has = target.isNotNull()
    questions = F.concat(
        F.lit('{"operation":'), F.to_json(op_q), F.when(has, F.concat(F.lit(',"'), qid, F.lit('":'), F.to_json(t_q))).otherwise(""), F.lit("}")
    )
    labels = F.concat(
        F.lit('{"operation":"'), op, F.lit('"'), F.when(has, F.concat(F.lit(',"'), qid, F.lit('":"'), target, F.lit('"'))).otherwise(""), F.lit("}")
    )
    request = F.concat(F.lit('{"state":'), F.to_json(state), F.lit(',"questions":'), questions, F.lit("}"))
    return step.withColumn("request", request).withColumn("labels", labels).withColumn("has_target", has)


def convert_steps(
    nodes: DataFrame, steps: DataFrame, seed: str = "0", k_min: int = K_MIN, k_max: int = K_MAX, need_candidates: bool = True, from_tree: bool = False
) -> DataFrame:
    """Every step with its request and labels, or the reason why there is none.

    nodes   described elements: page_id, pre, last, tag, role, label, value, operations,
            options, candidate, weight, hidden
    steps   step_id, page_id, gold (pre, null for an operation without target), hit (the node
            acted on), op, wanted, goal, url, title, page_text, history, skip_reason (set by
            earlier rules)

    ``steps`` may have positives, an array of places.
    """
    if "positives" not in steps.columns:
        steps = steps.withColumn("positives", F.lit(None).cast("array<long>"))
    has_gold = F.col("gold").isNotNull()
    about = nodes.select("page_id", F.col("pre").alias("gold"), F.col("last").alias("gold_last"), F.col("label").alias("gold_label"), F.col("tag").alias("gold_tag"), F.col("hidden").alias("gold_hidden"))
    s = steps.join(about, ["page_id", "gold"], "left")
    reason = first_failure(
        [
            (F.col("skip_reason").isNotNull(), F.col("skip_reason")),
            (has_gold & (F.col("op") == "SELECT") & (F.col("gold_tag") != "select"), "select_not_a_select"),
            (has_gold & F.coalesce("gold_hidden", F.lit(False)), "gold_hidden"),
        ]
    )
    s = s.withColumn("skip_reason", reason)
    key = s.filter("skip_reason is null").select("step_id", "page_id", "gold", "gold_last", "hit", "positives", F.col("op").alias("gold_op"), "wanted")
    # gold, hit and the action travel with the candidates: the step meets its page once
    near = near_gold(nodes, key).withColumn("wanted", F.when(F.col("is_gold"), F.col("wanted"))).repartition("step_id")
    off = offered(unique_labels(near, ["step_id"]), ["step_id"], seed, k_min, k_max)
    operations = with_gold_operation(F.col("operations"), F.when(F.col("is_gold"), F.col("gold_op")))
    options = capped_select_options(F.col("options"), F.col("is_gold"), F.col("wanted"), seed, "step_id", "pre")
    item = F.struct("index", "role", "label", "value", operations.alias("operations"), options.alias("options"), "is_gold")
    per = off.groupBy("step_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("k"), F.max("n_negatives").alias("n_neg")
    )
    j = s.join(per, "step_id", "left")
    j = j.withColumn("entries", F.flatten(F.transform("items", lambda e: element_targets(e, F.col("wanted")))))
    j = j.withColumns({f"criteria_{o.lower()}": criteria_of(F.col("entries"), o) for o in TARGET_OPERATIONS})
    present = F.array_compact(F.array(*[F.when(F.col(f"criteria_{o.lower()}").isNotNull(), F.lit(o)) for o in TARGET_OPERATIONS]))
    j = j.withColumns({"gold_key": gold_target(F.col("entries"), F.col("op")), "present": present})

    def shown(e: Column) -> Column:
        listed = F.transform(
            e["options"],
            lambda o: F.struct(
                F.concat_ws(":", e["index"], o["j"]).alias("index"), F.concat(e["label"], F.lit(" → "), o["label"]).alias("label"), o["value"].alias("value")
            ),
        )
        return F.struct(
            e["role"].alias("role"), e["label"].alias("label"), e["value"].alias("value"), e["index"].cast("string").alias("index"),
            e["operations"].alias("operations"), F.when(F.array_contains(e["operations"], "SELECT"), listed).alias("options"),
        )

    j = j.withColumn("elements", F.transform("items", shown))
    scrolled = F.exists("history", lambda h: h["action"] == "Scroll down") | (F.col("op") == "SCROLL_UP")
    menu = operation_menu(F.col("present"), seed, ["step_id"], from_tree, F.coalesce(scrolled, F.lit(False)))
    j = j.withColumn("menu", menu)
    targeted = F.col("op").isin(*TARGET_OPERATIONS)
    late = first_failure(
        [
            (F.col("skip_reason").isNotNull(), F.col("skip_reason")),
            (F.lit(need_candidates) & (F.coalesce("n_neg", F.lit(0)) < k_min - 1), "too_few_candidates"),
            (F.coalesce("k", F.lit(0)) == 0, "no_elements"),
            (targeted & F.lit(need_candidates) & F.col("gold_key").isNull(), F.when(F.col("op") == "SELECT", "select_option_not_found").otherwise("no_target")),
            (~F.array_contains("menu", F.col("op")), F.concat(F.lit("op_not_offered:"), F.col("op"))),
        ]
    )
    done = assemble(j.withColumn("skip_reason", late))
    keep = F.col("skip_reason").isNull()
    return done.select(
        *[c for c in steps.columns if c not in ("skip_reason", "page_text", "history", "positives")], "gold_label", "skip_reason",
        *[F.when(keep, F.col(c)).alias(c) for c in ("request", "labels", "k", "has_target")],
    )
