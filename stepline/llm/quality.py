"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a text on a cheap or a dear figure. On a sample, every rule is timed and its
share of rejections counted; rules then run in the order of rejections per second, and a text
that one rule rejects is not looked at by the next. The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.llm.scratch import Scratch, free_names

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
MAX_SYMBOLS_PCT = 10  # symbols for 100 words
MAX_DUP_LINES_PCT = 30
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 20  # mean
MAX_CAPITALS_PCT = 50  # of A-Z among A-Z and a-z
SAMPLE_ROWS = 600
REPEATS = 8  # times that a rule is run over the sample to be timed
LEAST_SECONDS = 1e-3  # what timing can tell apart


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The maximal runs of anything but the six ASCII spaces; no words for null or blank."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def n_lines(text: Column) -> Column:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more: sort, compare neighbours, join intervals."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(s, lambda p, k: ((k > 0) & (F.get(s, k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == p["h"])))
        starts = F.sort_array(F.transform(same, lambda p: p["i"]))
        zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["covered"] + i + WINDOW - F.greatest(a["end"], i)).alias("covered"), (i + WINDOW).alias("end")))["covered"]

    return bind(placed, repeated)


def n_repeat_words(word_list: Column) -> Column:
    """Words inside a window of five words that occurs at least twice in the text."""

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        found = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
        return F.when(F.size(w) <= WINDOW, 0).otherwise(found)

    return bind(word_list, count).cast("long")


def base_figures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, each behind the prefix.

    Null and empty texts have zeros; repeated rows get the same figures, no rows give no rows, and
    columns named like a figure are replaced.
    """
    t, (w,) = F.col(text_col), free_names(docs.columns, "words")
    wide = docs.withColumn(w, words(t))
    figures = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": n_symbols(t),
        "n_dup_lines": n_lines(t)["dup"],
        "n_repeat_words": n_repeat_words(F.col(w)),
    }
    return wide.withColumns({prefix + k: v for k, v in figures.items()}).drop(w)


@dataclass(frozen=True)
class Rule:
    """A name and the condition on a text column under which the text is rejected."""

    name: str
    rejects: Callable[[Column], Column]


def _letters(t: Column) -> Column:
    capitals = F.length(F.regexp_replace(F.coalesce(t, F.lit("")), "[^A-Z]+", ""))
    return bind(F.struct(capitals.alias("up"), F.length(F.regexp_replace(F.coalesce(t, F.lit("")), "[^A-Za-z]+", "")).alias("all")), lambda x: 100 * x["up"] > MAX_CAPITALS_PCT * x["all"])


RULES = (
    Rule("few_words", lambda t: F.size(words(t)) < MIN_WORDS),
    Rule("repeats", lambda t: bind(words(t), lambda w: 100 * n_repeat_words(w) > MAX_REPEAT_PCT * F.size(w))),
    Rule("symbols", lambda t: 100 * n_symbols(t) > MAX_SYMBOLS_PCT * F.size(words(t))),
    Rule("dup_lines", lambda t: bind(n_lines(t), lambda x: 100 * x["dup"] > MAX_DUP_LINES_PCT * x["n"])),
    Rule("word_length", lambda t: bind(words(t), lambda w: ~F.length(F.array_join(w, "")).between(MIN_WORD_CHARS * F.size(w), MAX_WORD_CHARS * F.size(w)))),
    Rule("capitals", _letters),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second on a random sample of about sample_rows rows; as given if it is empty.

    A rule's cost is its time over the sample, REPEATS times over, less that of a rule that never
    rejects: the quicker of two runs, after one that compiles it.
    """
    total = docs.count()
    part = docs.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=11)
    sample = Scratch(docs.sparkSession, "quality").keep(part, "sample")
    rows = sample.withColumn("turn", F.explode(F.array_repeat(F.lit(0), REPEATS)))

    def measured(rejects: Column) -> tuple[float, float]:
        """Seconds, and the share of rows that is rejected."""
        run, took = rows.agg(F.count("*").alias("n"), F.count_if(rejects).alias("out")), []
        for _ in range(3):
            start = time.perf_counter()
            row = run.first()
            took.append(time.perf_counter() - start)
        return min(took[1:]), row["out"] / max(row["n"], 1)

    nothing, _ = measured(F.col("text") == F.lit("\0"))
    gain = {}
    for rule in rules:
        seconds, share = measured(rule.rejects(F.col("text")))
        gain[rule.name] = share / max(seconds - nothing, LEAST_SECONDS)
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def cascade(rules: tuple[Rule, ...], text: Column) -> Column:
    """The name of the first rule that rejects the text, null if none does; later rules are not evaluated."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(F.coalesce(rule.rejects(text), F.lit(False)), F.lit(rule.name))
    return out


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "rejected_by") -> DataFrame:
    """docs with one more column, the rule that rejects the text (null: kept), rules in measured order.

    Null and empty texts have no words and fail few_words; a text without letters passes the
    capitals rule. Repeated rows are judged alike, no rows give no rows, and a column named like
    out is replaced.
    """
    return docs.withColumn(out, cascade(order_rules(docs, rules, text_col), F.col(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, columns as they are.

    Null and empty texts are rejected (few_words); repeated rows stay or go together, no rows
    give no rows.
    """
    return docs.where(cascade(order_rules(docs, rules, text_col), F.col(text_col)).isNull())
