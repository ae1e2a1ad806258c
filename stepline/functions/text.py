"""Column functions over text. All run inside the JVM unless the name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space as a run, and the characters a goal may be wrapped in
SPACE = r"(?U)[\s\x1c-\x1f]+"
QUOTES = "\"'“”"
LABEL_CHARS = 100
ELLIPSIS = "…"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_ws(s: Column | str) -> Column:
    """Runs of Unicode white space become one space, ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(s), F.lit("")), SPACE, " "))


def strip(s: Column | str) -> Column:
    """White space, line breaks included, off both ends; null becomes ''."""
    return F.regexp_replace(F.coalesce(col(s), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clip(s: Column | str, n: int = LABEL_CHARS) -> Column:
    """Normalised text of at most n characters; a cut is marked by an ellipsis."""
    t = norm_ws(s)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit(ELLIPSIS)))


def norm_goal(s: Column | str) -> Column:
    """Comparison form of a goal: normalised, lower case, without closing full stops."""
    return F.regexp_replace(F.lower(norm_ws(s)), r"\.+$", "")


def norm_state(s: Column | str) -> Column:
    """Comparison form of a state: normalised and lower case."""
    return F.lower(norm_ws(s))


def clean_goal(s: Column | str) -> Column:
    """Drops a leading ``- Task 4:`` and wrapping quotes."""
    t = F.regexp_replace(norm_ws(s), r"(?iU)^\s*-?\s*(task\s*\d+\s*:)?\s*", "")
    return F.trim(F.btrim(t, F.lit(QUOTES)))


def escape_delimiters(s: Column | str) -> Column:
    """Text can not forge a ``<|name|>`` delimiter."""
    return F.regexp_replace(col(s), r"<\|([A-Za-z0-9_]+)\|>", "<¦$1¦>")


def option_text(name: Column | str, description: Column | str) -> Column:
    """``name`` alone, or ``name: description`` when there is one."""
    return F.concat_ws(": ", col(name), F.nullif(col(description), F.lit("")))


def option_matches(label: Column | str, value: Column | str, wanted: Column | str) -> Column:
    """A non-empty wanted text equals the label or the value, ignoring case and white space."""
    w = F.lower(norm_ws(wanted))
    return (w != "") & ((w == F.lower(norm_ws(label))) | (w == F.lower(norm_ws(value))))


def fallback_label(value: Column | str, attributes_json: Column | str) -> Column:
    """Label of an action without a resolved element: value, else a recorded aria-label, else 'element'."""
    aria = F.get_json_object(col(attributes_json), "$.data.aria-label")
    return clip(F.coalesce(F.nullif(col(value), F.lit("")), F.nullif(aria, F.lit("")), F.lit("element")))


def hostname(site: Column | str, url: Column | str) -> Column:
    """The given site, else the lower-case host of the URL."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    return F.coalesce(F.nullif(col(site), F.lit("")), host)


def kind_of(qid: Column | str) -> Column:
    """Every ``*_target`` question counts as 'target'."""
    return F.when(col(qid).endswith("_target"), F.lit("target")).otherwise(col(qid))


def cjk_share(s: Column | str) -> Column:
    """Share of kana, Han and Hangul characters."""
    c = col(s)
    return F.regexp_count(c, F.lit(CJK)) / F.greatest(F.lit(1), F.length(c))


# fixed values: character ranges counted as CJK
CJK = "[぀-ヿ㐀-鿿가-힯]"
