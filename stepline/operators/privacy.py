"""Scan and redact step rows.

A step row here has typed columns: goal, reason, and ``state`` (page, elements,
recent_actions); every text is handled by column functions inside the row, so neither the
scan nor the redaction shuffles. Only the report aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions import privacy as P
from stepline.functions.prob import let
from stepline.functions.text import strip
from stepline.operators.ordering import first_per_group

FIELD_TYPE = "array<struct<field:string,text:string,typed:boolean,label:string>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _field(name: str, text: Column, typed: bool = False, label: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("field"), _text(text).alias("text"), F.lit(typed).alias("typed"),
        _text(label if label is not None else F.lit("")).alias("label"),
    )


def is_typed_value(e: Column) -> Column:
    """An element value the user may have typed: not empty, and not a dropdown's."""
    return (_text(e["value"]) != "") & ~F.coalesce(F.array_contains(e["operations"], "SELECT"), F.lit(False))


def scan_fields(goal: Column, reason: Column, state: Column) -> Column:
    """Every text of a step as array<struct<field,text,typed,label>>."""
    actions, elements = state["recent_actions"], state["elements"]
    or_none = lambda fields: F.coalesce(fields, F.array().cast(FIELD_TYPE))
    typed_actions = F.transform(F.filter(actions, lambda a: _text(a["text"]) != ""), lambda a: _field("typed", a["text"], True, a["action"]))
    action_labels = F.transform(actions, lambda a: _field("labels", a["action"]))
    element_labels = F.transform(elements, lambda e: _field("labels", e["label"]))
    values = F.transform(F.filter(elements, is_typed_value), lambda e: _field("typed", e["value"], True, e["label"]))
    fixed = F.array(_field("url", state["page"]["url"]), _field("page_text", state["page"]["text"]))
    said = F.array_compact(F.array(_field("goal", goal), F.when(_text(reason) != "", _field("labels", reason))))
    return F.concat(fixed, *[or_none(x) for x in (typed_actions, action_labels, element_labels, values)], said)


def findings(fields: Column, goal: Column, first_names: Sequence[str]) -> Column:
    """Findings of a step: array<struct<field,category,context>>; dictated values are told apart."""
    g = F.lower(_text(goal))

    def of_field(f: Column) -> Column:
        found = F.transform(
            P.find(f["text"], f["field"] == "url"),
            lambda s: F.struct(
                f["field"].alias("field"),
                F.when(f["typed"] & F.contains(g, F.lower(s["text"])), F.concat(s["category"], F.lit("_from_goal")))
                .otherwise(s["category"])
                .alias("category"),
                P.context(f["text"], s["start"], s["end"]).alias("context"),
            ),
        )
        shown = F.concat(F.substring(f["label"], 1, 40), F.lit(": ["), P.mask(f["text"]), F.lit("]"))
        one = lambda cat: F.struct(f["field"].alias("field"), cat.alias("category"), shown.alias("context"))
        value = strip(f["text"])
        secret = F.when(f["typed"] & f["label"].rlike(P.PASSWORD_LABEL) & (value != ""), one(F.lit("password_value")))
        name = F.when(
            f["typed"] & P.is_name(f["text"], list(first_names)),
            one(F.when(F.contains(g, F.lower(value)), "name_from_goal").otherwise("name")),
        )
        return F.concat(found, F.array_compact(F.array(secret, name)))

    return F.flatten(F.transform(fields, of_field))


def scan(steps: DataFrame, first_names: Sequence[str]) -> DataFrame:
    """One row per finding: config, split, id, field, category, context."""
    fields = scan_fields(F.col("goal"), F.col("reason"), F.col("state"))
    found = let(fields, lambda f: findings(f, F.col("goal"), first_names))
    # outer and filtered: the inner form would evaluate the detectors twice, to drop empty rows first
    rows = steps.select("config", "split", "id", F.explode_outer(found).alias("f"))
    return rows.filter("f is not null").select("config", "split", "id", "f.*")


BENCH = "bench"  # the config that copies test rows of the others


def without_copies(steps: DataFrame) -> DataFrame:
    """Steps of all configs but the bench, whose rows stand in another one; a row without config stays."""
    return steps.where(~F.col("config").eqNullSafe(F.lit(BENCH)))


def report(found: DataFrame) -> DataFrame:
    """Counts in long form: matches per config and field:category, flagged rows per config and category."""
    per_row = found.groupBy("config", "field", "category", "split", "id").agg(F.count("*").alias("n"))
    matches = per_row.groupBy("config", F.concat_ws(":", "field", "category").alias("item")).agg(F.sum("n").alias("n"))
    rows = per_row.select("config", "category", "split", "id").distinct().groupBy("config", F.col("category").alias("item")).agg(F.count("*").alias("n"))
    return matches.select(F.lit("matches").alias("part"), "config", "item", "n").unionByName(
        rows.select(F.lit("rows_flagged").alias("part"), "config", "item", "n")
    )


def flagged_rows(found: DataFrame) -> DataFrame:
    """Which rows carry which category: a relation, since a category may flag any number of rows."""
    return found.select("category", F.concat_ws("/", "config", "split", "id").alias("row")).distinct()


def examples(found: DataFrame, n: int = 5) -> DataFrame:
    """At most n masked examples per field and category, in row order."""
    return first_per_group(found, ["field", "category"], [F.col("config"), F.col("split"), F.col("id"), F.col("context")], n)


def policy_of(category: Column) -> Column:
    """Proposed rule of a category; all dictated values share one."""
    rules = F.create_map(*[F.lit(x) for kv in P.POLICY.items() for x in kv])
    return F.try_element_at(rules, F.regexp_replace(category, "^.*_from_goal$", "*_from_goal"))


def _exact_replacements(state: Column, goal: Column, first_names: Sequence[str]) -> Column:
    """Typed values to replace everywhere, longest first: array<struct<old,new>>."""
    actions, elements = state["recent_actions"], state["elements"]
    or_none = lambda values: F.coalesce(values, F.array().cast("array<struct<value:string,label:string>>"))
    typed = F.concat(
        or_none(F.transform(F.filter(actions, lambda a: _text(a["text"]) != ""), lambda a: F.struct(a["text"].alias("value"), _text(a["action"]).alias("label")))),
        or_none(F.transform(F.filter(elements, is_typed_value), lambda e: F.struct(e["value"].alias("value"), _text(e["label"]).alias("label")))),
    )
    dictated = lambda text: F.contains(goal, F.lower(text))
    pair = lambda old, new: F.struct(old.alias("old"), F.lit(new).alias("new"))

    def of_value(t: Column) -> Column:
        value = strip(t["value"])
        contacts = F.concat(
            F.transform(F.filter(P.detect(t["value"], P.EMAIL), lambda s: ~dictated(s["text"])), lambda s: pair(s["text"], P.EMAIL_STAND_IN)),
            F.transform(F.filter(P.detect(t["value"], P.PHONE), lambda s: ~dictated(s["text"])), lambda s: pair(s["text"], P.PHONE_STAND_IN)),
        )
        none = F.array().cast("array<struct<old:string,new:string>>")
        return (
            F.when((value == "") | dictated(value), none)
            .when(t["label"].rlike(P.PASSWORD_LABEL), F.array(pair(t["value"], P.REDACTED)))
            .when(P.is_name(t["value"], list(first_names)), F.array(pair(t["value"], P.NAME_STAND_IN)))
            .otherwise(contacts)
        )

    pairs = F.flatten(F.transform(typed, of_value))
    ranked = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.length(p["old"])).alias("n"), p["old"].alias("old"), p["new"].alias("new"))))
    return F.transform(ranked, lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new")))


def must_drop(texts: Column, goal: Column) -> Column:
    """A card or social security number the goal does not dictate."""
    return F.exists(
        texts,
        lambda t: F.exists(P.find_numbers(t), lambda s: ~F.contains(goal, F.lower(s["text"]))),
    )


def state_texts(state: Column) -> Column:
    """Every string of a state, whatever field it is in."""
    page = F.array(state["page"]["url"], state["page"]["title"], state["page"]["text"])
    of_options = F.flatten(F.transform(state["elements"], lambda e: F.flatten(F.transform(F.coalesce(e["options"], F.array().cast(OPTIONS_TYPE)), lambda o: F.array(o["index"], o["label"], o["value"])))))
    of_elements = F.flatten(F.transform(state["elements"], lambda e: F.concat(F.array(e["role"], e["label"], e["value"], e["index"]), F.coalesce(e["operations"], F.array().cast("array<string>")))))
    of_actions = F.flatten(F.transform(state["recent_actions"], lambda a: F.array(a["action"], a["kind"], a["text"])))
    none = F.array().cast("array<string>")
    return F.array_compact(F.concat(page, *[F.coalesce(x, none) for x in (of_elements, of_options, of_actions)]))


OPTIONS_TYPE = "array<struct<index:string,label:string,value:string>>"


def redact(steps: DataFrame, first_names: Sequence[str]) -> DataFrame:
    """Steps with sensitive values replaced in every text; option keys and numbers stay, some rows go.

    Adds ``dropped``: true for rows that must not be published, wherever the number stands.
    """
    goal = F.lower(_text(F.col("goal")))
    texts = F.concat(state_texts(F.col("state")), F.array(_text(F.col("goal")), _text(F.col("reason"))))
    staged = steps.withColumn("_pairs", _exact_replacements(F.col("state"), goal, first_names)).withColumn("dropped", must_drop(texts, goal))
    fix = _fixer(F.col("_pairs"), goal)
    state = F.col("state")
    page = state["page"]
    option = lambda o: o.withField("label", fix(o["label"])).withField("value", fix(o["value"]))
    element = lambda e: e.withField("role", fix(e["role"])).withField("label", fix(e["label"])).withField("value", fix(e["value"])).withField("options", F.transform(e["options"], option))
    action = lambda a: a.withField("action", fix(a["action"])).withField("kind", fix(a["kind"])).withField("text", fix(a["text"]))
    new_state = F.struct(
        F.struct(fix(page["url"]).alias("url"), fix(page["title"]).alias("title"), fix(page["text"]).alias("text")).alias("page"),
        F.transform(state["elements"], element).alias("elements"),
        F.transform(state["recent_actions"], action).alias("recent_actions"),
    )
    return staged.withColumns({"state": new_state, "goal": fix(F.col("goal")), "reason": fix(F.col("reason"))}).drop("_pairs")


def _fixer(pairs: Column, goal: Column):
    return lambda c: F.when(c.isNotNull(), P.redact_free(P.replace_all(c, pairs), goal))


def redact_rows(rows: DataFrame, first_names: Sequence[str], state_type: str) -> DataFrame:
    """Step rows (request and meta as JSON) with sensitive values replaced in every string of both.

    Adds ``dropped``: a card or social security number that the goal does not dictate stands in
    either of them. Keys stay as they are; the goal and what was typed are read from the request.
    Most texts show no sign of anything to replace and are left alone as a whole, and in the
    others only the strings that show one are written anew.
    """
    goal = F.lower(_text(F.get_json_object("request", "$.questions.operation.instructions.goal")))
    staged = rows.withColumn("_goal", goal).withColumn("_state", F.from_json("request", f"struct<state:{state_type}>")["state"])
    staged = staged.withColumn("_pairs", _exact_replacements(F.col("_state"), F.col("_goal"), first_names))
    held = lambda c: F.when(P.json_may_hold_numbers(F.col(c)), must_drop(P.json_texts(F.col(c)), F.col("_goal"))).otherwise(False)
    staged = staged.withColumn("dropped", F.coalesce(held("request"), F.lit(False)) | F.coalesce(held("meta"), F.lit(False)))
    fix, typed = _fixer(F.col("_pairs"), F.col("_goal")), F.size("_pairs") > 0

    def cleaned(c: Column) -> Column:
        # what was typed may stand in any string; else a string needs a sign of its own
        some = P.rewrite_json(c, fix, P.json_may_change)
        return F.when(typed, P.rewrite_json(c, fix)).when(P.json_may_change(c), some).otherwise(c)

    return staged.withColumns({c: cleaned(F.col(c)) for c in ("request", "meta")}).drop("_goal", "_state", "_pairs")
