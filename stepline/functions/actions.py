"""Column functions over recorded actions, prompts and model replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepline.functions.text import clip, col, norm_ws, strip

# fixed values: raw action names of the human traces and of the page traces
HUMAN_OPERATIONS = {"CLICK": "CLICK", "HOVER": "CLICK", "ENTER": "CLICK", "TYPE": "TYPE_TEXT", "SELECT": "SELECT"}
TRACE_OPERATIONS = {
    "click": "CLICK",
    "hover": "CLICK",
    "double_click": "CLICK",
    "type": "TYPE_TEXT",
    "paste": "TYPE_TEXT",
    "select": "SELECT",
}
ENTRY_KIND = {"CLICK": "click", "TYPE_TEXT": "fill", "SELECT": "select"}
# fixed values: how an action line and a reply are written
ACTION_LINE = r"(?s)^\[([^\]]*)\]\s*(.*?)\s*->\s*([A-Z]+)(?::\s*(.*))?$"
REPLY_BLOCK = r"(?s)```(.*?)```"
REPLY_ACTIONS = [
    ("CLICK", r"^(?:click|hover) \[(\d+)\]"),
    ("TYPE_TEXT", r"(?s)^type \[(\d+)\] \[(.*?)\](?: \[[01]\])?\s*$"),
    ("SCROLL", r"^scroll \[(down|up)\]"),
    ("STOP", r"(?s)^stop \[(.*)\]\s*$"),
]
HISTORY_LINE = r"^\d+:\s*(.*?)(?: where \[\d+\] is (.*))?$"
PROMPT_MARKS = ["OBSERVATION:", "\nURL:", "\nOBJECTIVE:", "\nPREVIOUS ACTIONS:", "<|eot_id|>"]
NO_ANSWER = ["N/A", "NA", ""]
HISTORY_STEPS = 10

ENTRY_TYPE = "struct<action:string,kind:string,text:string,page_changed:boolean>"


def mapped(mapping: dict[str, str], c: Column) -> Column:
    """Value of a small fixed mapping, null when absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def entry(action: Column, kind: Column, text: Column) -> Column:
    """One history entry."""
    return F.struct(
        action.alias("action"), kind.alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("boolean").alias("page_changed")
    )


def select_label(op: Column, label: Column, value: Column) -> Column:
    """A chosen option is named behind its field."""
    return F.when((op == "SELECT") & (F.coalesce(value, F.lit("")) != ""), F.concat(label, F.lit(" → "), clip(value))).otherwise(label)


def parse_action_line(line: Column | str) -> Column:
    """``[tag] label -> OP: value`` as a history entry; null when it has another shape."""
    t = norm_ws(line)
    part = lambda i: F.regexp_extract(t, ACTION_LINE, i)
    op = F.coalesce(mapped(HUMAN_OPERATIONS, part(3)), F.lit("CLICK"))
    label = clip(F.coalesce(F.nullif(part(2), F.lit("")), part(1)))
    value = F.when(F.regexp_like(t, F.lit(r"(?s)->\s*[A-Z]+:.*$")), part(4))
    text = F.when(op == "TYPE_TEXT", value)
    return F.when(t.rlike(ACTION_LINE), entry(select_label(op, label, value), mapped(ENTRY_KIND, op), text))


def parse_history_line(line: Column | str) -> Column:
    """``2: type [89] [text] where [89] is Label`` as a history entry; null when it does not count."""
    t = col(line)
    act, label = F.regexp_extract(t, HISTORY_LINE, 1), clip(F.regexp_extract(t, HISTORY_LINE, 2))
    none = F.lit(None).cast("string")
    typed = F.regexp_extract(act, r"^type \[\d+\] \[(.*?)\]", 1)
    has_text = act.rlike(r"^type \[\d+\] \[(.*?)\]")
    or_else = lambda other: F.coalesce(F.nullif(label, F.lit("")), F.lit(other))
    return F.when(
        t.rlike(HISTORY_LINE) & ~act.isin("None", ""),
        F.when(act.rlike("^(click|hover)"), entry(or_else("element"), F.lit("click"), none))
        .when(act.startswith("type"), entry(or_else("field"), F.lit("fill"), F.when(has_text, norm_ws(typed))))
        .when(
            act.startswith("scroll"),
            entry(F.when(F.contains(act, F.lit("up")), "Scroll up").otherwise("Scroll down"), F.lit("scroll"), none),
        ),
    )


def last_items(items: Column, n: int = HISTORY_STEPS) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), n)


def parse_prompt(prompt: Column | str) -> Column:
    """tree, url, objective and history lines of a recorded prompt, cut at fixed marks.

    The last observation counts; each later mark is looked for behind the one before.
    """
    start, url, goal, actions, end = PROMPT_MARKS
    cut = lambda c, mark: F.split(c, r"\Q" + mark + r"\E", 2)
    rest = lambda pair: F.coalesce(F.try_element_at(pair, F.lit(2)), F.lit(""))
    a = cut(F.substring_index(col(prompt), start, -1), url)
    b = cut(rest(a), goal)
    c = cut(rest(b), actions)
    d = cut(rest(c), end)
    lines = F.filter(F.transform(F.split(d[0], "\n"), strip), lambda x: x != "")
    return F.struct(a[0].alias("tree"), strip(b[0]).alias("url"), strip(c[0]).alias("objective"), lines.alias("history"))


def parse_reply(reply: Column | str) -> Column:
    """kind and arguments of the last fenced block; null when it is none of the known actions."""
    act = strip(F.try_element_at(F.regexp_extract_all(col(reply), F.lit(REPLY_BLOCK), F.lit(1)), F.lit(-1)))

    def one(kind: str, pattern: str) -> Column:
        groups = 2 if kind == "TYPE_TEXT" else 1
        args = F.array(*[F.regexp_extract(act, pattern, i + 1) for i in range(groups)])
        return F.when(act.rlike(pattern), F.struct(F.lit(kind).alias("kind"), args.alias("args")))

    return F.coalesce(*[one(k, p) for k, p in REPLY_ACTIONS])


def reply_operation(action: Column) -> Column:
    """Operation of a parsed reply: a stop without an answer is BLOCKED, scrolls split by direction."""
    first = F.element_at(action["args"], 1)
    return (
        F.when(action["kind"] == "STOP", F.when(stop_is_blocked(first), "BLOCKED").otherwise("DONE"))
        .when(action["kind"] == "SCROLL", F.when(first == "up", "SCROLL_UP").otherwise("SCROLL_DOWN"))
        .otherwise(action["kind"])
    )


def stop_is_blocked(text: Column | str) -> Column:
    return F.upper(norm_ws(text)).isin(*NO_ANSWER)


def parse_verdict(reply: Column | str) -> Column:
    """done and reason of a judge reply: first ``{`` to last ``}``; null unless done is a boolean."""
    body = F.regexp_extract(F.coalesce(col(reply), F.lit("")), r"(?s)\{.*\}", 0)
    done = F.get_json_object(body, "$.done")
    # a quoted "true" is text, not a boolean
    quoted = F.regexp_like(body, F.lit(r'(?s)"done"\s*:\s*"'))
    return F.when(
        done.isin("true", "false") & ~quoted,
        F.struct((done == "true").alias("done"), F.get_json_object(body, "$.reason").alias("reason")),
    )


def first_failure(rules: list[tuple[Column, str | Column]]) -> Column:
    """Name of the first rule that holds, in order; null when none does."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    empty = F.lit(None).cast("string")
    return reduce(lambda rest, r: F.when(r[0], lit(r[1])).otherwise(rest), reversed(rules), empty)
