"""CSS selectors over element relations, resolved through a posting index.

Every element is filed under its tag, its id, each of its classes and its place among its siblings.
A compound (``a#x.y:nth-child(2)``) is the elements that stand under all of its words; a descendant or child
step asks whether one of the elements found so far holds the next one, which its interval or its
parent tells. Nothing is compared element by element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.session import materialize

NAME = r"(?:[A-Za-z_]|[^\x00-\x7F])(?:[\w-]|[^\x00-\x7F])*"
PLACE = r":nth-(?:child|of-type)\([0-9]+\)"
COMPOUND = rf"(?:\*|{NAME})?(?:[#.]{NAME}|{PLACE})*"
# compounds with spaces or > between them; an empty one matches the pattern, but is none
SELECTOR = rf"^{COMPOUND}(?:(?: ?> ?| ){COMPOUND})*$"
WORD = rf"[#.]?{NAME}|\*|{PLACE}"


def postings(nodes: DataFrame) -> DataFrame:
    """(page_id, word, pre): ``tag``, ``*``, ``#id``, ``.class``, ``:nth-child(n)`` and ``:nth-of-type(n)`` of every element."""
    siblings, alike = (Window.partitionBy("page_id", "parent", *more).orderBy("pre") for more in ([], ["tag"]))
    places = [F.format_string(f":nth-{kind}(%d)", F.row_number().over(w)) for kind, w in (("child", siblings), ("of-type", alike))]
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    classes = F.transform(F.filter(F.split(attr("class"), "[ \t\n\f\r]+"), lambda c: c != ""), lambda c: F.concat(F.lit("."), c))
    words = F.concat(F.array("tag", F.lit("*"), "_child", "_alike"), F.when(attr("id") != "", F.array(F.concat(F.lit("#"), attr("id")))).otherwise(F.array().cast("array<string>")), F.array_distinct(classes))
    placed = nodes.withColumns({"_child": places[0], "_alike": places[1]})
    return placed.select("page_id", F.explode(words).alias("word"), "pre")


def steps_of(selector: Column) -> Column:
    """array<struct<child, words>> of a selector, first step first; null where it is none this module reads."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(selector, r"\s+", " "), " ?> ?", ">"))
    parts = F.regexp_extract_all(plain, F.lit(r"([ >]?)([^ >]+)"), F.lit(0))
    told = F.transform(parts, lambda p: F.struct(F.startswith(p, F.lit(">")).alias("child"), F.array_distinct(F.regexp_extract_all(p, F.lit(WORD), F.lit(0))).alias("words")))
    # a step that starts the selector or follows another > has nothing before it
    sound = plain.rlike(SELECTOR) & (F.length(plain) > 0) & ~plain.rlike("^>|>>|>$") & F.forall(parts, lambda p: F.length(F.regexp_replace(p, "[ >]", "")) > 0)
    return F.when(F.coalesce(sound, F.lit(False)), told)


def matches(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, selector, pre) of all elements that a selector of ``wanted`` (page_id, selector) means.

    ``nodes``: page_id, pre, last, parent, tag, attrs. Tags are compared as they are written in
    the nodes. Selectors of other forms (attributes, other pseudo-classes, lists) mean
    nothing.
    """
    asked = wanted.select("page_id", "selector").distinct().withColumn("steps", steps_of(F.col("selector"))).where("steps is not null")
    asked = materialize(asked, "selectors")
    deepest = asked.agg(F.max(F.size("steps"))).first()[0] or 0
    each = asked.select("page_id", "selector", F.size("steps").alias("n_steps"), F.posexplode("steps").alias("at", "step"))
    words = each.select("page_id", "selector", "n_steps", "at", F.col("step.child").alias("child"), F.size("step.words").alias("n_words"), F.explode("step.words").alias("word"))
    hits = words.join(postings(nodes), ["page_id", "word"])
    full = hits.groupBy("page_id", "selector", "n_steps", "at", "child", "n_words", "pre").agg(F.count("*").alias("n")).where("n = n_words")
    # one row per element and selector, with the steps that the element satisfies by itself
    per = full.groupBy("page_id", "selector", "n_steps", "pre").agg(F.collect_set("at").alias("fits"), F.collect_set(F.when(F.col("child"), F.col("at"))).alias("children"))
    placed = per.join(nodes.select("page_id", "pre", "last", "parent"), ["page_id", "pre"])
    before = Window.partitionBy("page_id", "selector").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    # a parent stands before its children, so the parents found so far are looked up among the rows ahead
    found = placed.withColumn("ok", F.array_contains("fits", 0))
    for k in range(1, deepest):
        around = F.coalesce(F.max(F.when(F.col("ok"), F.col("last"))).over(before) >= F.col("pre"), F.lit(False))
        own = found.where("ok").select("page_id", "selector", F.col("pre").alias("parent"), F.lit(True).alias("up"))
        found = found.withColumn("around", around).join(own, ["page_id", "selector", "parent"], "left")
        held = F.when(F.array_contains("children", k), F.coalesce("up", F.lit(False))).otherwise(F.col("around"))
        step = F.when(F.col("n_steps") > k, F.array_contains("fits", k) & held).otherwise(F.col("ok"))
        found = found.withColumn("ok", step).drop("around", "up")
    return found.where("ok").select("page_id", "selector", "pre")


def resolve_unique(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, selector, pre) of the selectors that mean exactly one element of their page."""
    return matches(nodes, wanted).groupBy("page_id", "selector").agg(F.count("*").alias("n"), F.max("pre").alias("pre")).where("n = 1").drop("n")
