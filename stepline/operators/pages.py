"""Page trees as relations.

A snapshot becomes rows: one per element with its preorder interval (pre..last), and the
text runs it owns. Ancestor and descendant tests are interval tests; inherited properties
are running maxima over the preorder, so no node meets every other node of its page.
All steps share the partitioning by page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions.prob import let
from stepline.functions.text import clip, norm_ws

# fixed values: which tags and roles can be acted on, and how a tag reads as a role
INTERACTIVE_TAGS = ["a", "button", "input", "select", "textarea", "option", "label", "summary"]
INTERACTIVE_ROLES = [
    "button", "link", "textbox", "searchbox", "combobox", "checkbox", "radio", "option", "tab", "menuitem", "switch",
]
TREE_INTERACTIVE = [
    "button", "link", "textbox", "searchbox", "combobox", "checkbox", "radio", "menuitem", "option", "tab", "switch",
    "listbox", "menuitemcheckbox", "menuitemradio", "slider", "spinbutton", "treeitem",
]
TREE_EDITABLE = ["textbox", "searchbox", "combobox", "spinbutton"]
TEXT_INPUT_TYPES = [
    "", "text", "search", "email", "tel", "url", "number", "password", "date", "datetime-local", "month", "week", "time",
]
ROLE_BY_TAG = {
    "a": "link", "button": "button", "select": "combobox", "textarea": "textbox", "option": "option", "img": "img",
    "svg": "img", "summary": "button", "label": "label",
}
SKIPPED_TAGS = ["script", "style", "noscript", "template", "head", "svg", "path", "iframe"]
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
PAGE_TEXT_CHARS = 6000
MAX_BOX_HEIGHT = 1500

NODE_SCHEMA = (
    "page_id long, pre int, last int, parent int, depth int, tag string, attrs map<string,string>, text string, "
    "runs array<struct<seq:int,pos:int,text:string>>"
)


def _page_parser(void: Sequence[str], text_limit: int | None, rows_per_batch: int = 1_000, chars_per_batch: int = 1_000_000):
    """Snapshot parser for ``mapInArrow``, self-contained so that workers need no package.

    A worker holds the tree of one page and one batch of its rows: a batch ends at so many rows or
    characters, and the text of an element is put together when its row is made.
    """
    # an open element of the second kind ends when one of the first kind starts
    ends = {
        "p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}, "h1": {"p"},
        "h2": {"p"}, "h3": {"p"}, "form": {"p"}, "nav": {"p"}, "article": {"p"}, "section": {"p"},
    }
    raw_text = {"script", "style"}

    def parse(html: str) -> Iterator[dict]:
        from html import unescape

        nodes: list[dict] = []
        stack: list[int] = []
        texts: list[str] = []  # every text run, in page order
        behind_comment = False

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                nodes[stack.pop()].update(last=len(nodes) - 1, to=len(texts))

        def add_text(data: str) -> None:
            run = " ".join(data.split())
            if run and stack:
                owner = nodes[stack[-1]]
                # text behind a comment belongs to its element but is not page text
                if not behind_comment:
                    owner["runs"].append({"seq": len(texts), "pos": owner["at"], "text": run})
                texts.append(run)

        at, size = 0, len(html)
        while at < size:
            m = token.match(html, at)
            if m is None:  # a stray angle bracket
                at += 1
                continue
            at = m.end()
            if m["text"]:
                add_text(unescape(m["text"]))
            elif m["tag"] is None:
                behind_comment = behind_comment or m["comment"] is not None
            elif m["close"]:
                behind_comment, tag = False, m["tag"].lower()
                for depth in range(len(stack) - 1, -1, -1):
                    if nodes[stack[depth]]["tag"] == tag:
                        close_to(depth)
                        break
            else:
                behind_comment, tag, inner = False, m["tag"].lower(), m["attrs"]
                if stack and nodes[stack[-1]]["tag"] in ends.get(tag, ()):
                    close_to(len(stack) - 1)
                pre = len(nodes)
                if stack:
                    nodes[stack[-1]]["at"] = pre
                attrs = {}
                for name, value in attribute.findall(inner) if inner.strip(" /") else ():
                    attrs.setdefault(name.lower(), unescape(value.strip("\"'")))
                nodes.append(
                    {
                        "pre": pre, "last": pre, "parent": stack[-1] if stack else None, "depth": len(stack), "tag": tag,
                        "attrs": list(attrs.items()), "runs": [], "at": pre, "from": len(texts), "to": len(texts),
                    }
                )
                if tag not in void and not inner.endswith("/"):
                    stack.append(pre)
                    if tag in raw_text:
                        end = end_of(html, tag, at)
                        add_text(html[at:end])
                        at = end
        close_to(0)
        for n in nodes:
            parts, length = [], 0
            for text in texts[n.pop("from") : n.pop("to")]:
                if text_limit is not None and length > text_limit:
                    break
                parts.append(text)
                length += len(text) + 1
            n.pop("at")
            yield {**n, "text": " ".join(parts)[:text_limit]}

    def end_of(html: str, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}", re.I).search(html, at)
        return m.start() if m else len(html)

    import re

    token = re.compile(
        r"""<!--(?P<comment>.*?)-->|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>"""
        r"""|<[!?][^>]*>|(?P<text>[^<]+)""",
        re.S,
    )
    attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("seq", pa.int32()), ("pos", pa.int32()), ("text", pa.string())]))
        schema = pa.schema(
            [("page_id", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
             ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("runs", run_type)]
        )
        rows: list[dict] = []
        chars = 0
        for batch in batches:
            for page_id, html in zip(batch.column(0), batch.column(1), strict=True):  # one page at a time leaves Arrow
                number = page_id.as_py()
                for n in parse(html.as_py() or ""):
                    rows.append({**n, "page_id": number})
                    chars += len(n["text"]) + sum(len(r["text"]) for r in n["runs"]) + sum(len(v) for _, v in n["attrs"])
                    if len(rows) >= rows_per_batch or chars >= chars_per_batch:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def page_nodes(pages: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Elements of HTML snapshots (page_id, html), one row each, with the whole text inside.

    A page is one input row, so it is parsed where it is read, without a shuffle. A caller
    that only clips labels and values out of the texts may bound them by text_chars, so that
    an outer element does not carry the page again.
    """
    parser = _page_parser(VOID_TAGS, text_chars)
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(parser, NODE_SCHEMA)


def own_hidden() -> Column:
    """An element hidden by its own tag, attributes or style."""
    attr = lambda n: F.try_element_at("attrs", F.lit(n))
    style = F.lower(F.replace(F.coalesce(attr("style"), F.lit("")), F.lit(" "), F.lit("")))
    return (
        F.col("tag").isin(*SKIPPED_TAGS)
        | attr("hidden").isNotNull()
        | (F.coalesce(attr("aria-hidden"), F.lit("")) == "true")
        | F.contains(style, F.lit("display:none"))
        | F.contains(style, F.lit("visibility:hidden"))
        | ((F.col("tag") == "input") & (F.lower(F.coalesce(attr("type"), F.lit(""))) == "hidden"))
    )


def inside(marked: Column, proper: bool = False) -> Column:
    """Whether a node lies inside (or is) a marked node of its page.

    Intervals nest, so it does exactly when some marked node at or before it ends at or
    after it: one running maximum per page.
    """
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1 if proper else 0)
    return F.coalesce(F.max(F.when(marked, F.col("last"))).over(w) >= F.col("pre"), F.lit(False))


def owner(marked: Column) -> Column:
    """pre of the marked node a node lies in, for marked nodes that do not nest; null outside."""
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(marked, F.struct("pre", "last")), ignorenulls=True).over(w)
    return F.when(last["last"] >= F.col("pre"), last["pre"])


def role_of(tag: Column, kind: Column, given: Column) -> Column:
    """Given role, else by input type, else by tag."""
    t = F.lower(F.coalesce(kind, F.lit("")))
    by_input = (
        F.when(t.isin("checkbox", "radio"), t)
        .when(t.isin("submit", "button", "reset", "image"), "button")
        .when(t == "search", "searchbox")
        .otherwise("textbox")
    )
    by_tag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_BY_TAG.items() for x in kv]), tag), tag)
    return F.coalesce(F.nullif(given, F.lit("")), F.when(tag == "input", by_input).otherwise(by_tag))


def first_filled(*texts: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def operations_of(tag: Column, kind: Column, role: Column, editable_attr: Column) -> Column:
    """What can be done with an element."""
    editable = (
        (tag == "textarea")
        | ((tag == "input") & F.lower(F.coalesce(kind, F.lit(""))).isin(*TEXT_INPUT_TYPES))
        | role.isin("textbox", "searchbox", "combobox")
        | F.coalesce(editable_attr, F.lit("no")).isin("true", "")
    )
    return (
        F.when(tag == "select", F.array(F.lit("SELECT")))
        .when(editable, F.array(F.lit("TYPE_TEXT"), F.lit("CLICK")))
        .otherwise(F.array(F.lit("CLICK")))
    )


def with_gold_operation(ops: Column, gold_op: Column) -> Column:
    """The recorded operation is always offered: typing goes first, others last."""
    return (
        F.when(gold_op.isNull() | F.array_contains(ops, gold_op), ops)
        .when(gold_op == "TYPE_TEXT", F.concat(F.array(gold_op), ops))
        .otherwise(F.concat(ops, F.array(gold_op)))
    )


def preceding_text(nodes: DataFrame, texts: DataFrame, out: str = "preceding") -> DataFrame:
    """Last text run strictly before each node: a backward as-of join by position.

    A frame over position values, not rows: a node and its own text share a position.
    """
    w = Window.partitionBy("page_id").orderBy("_pos").rangeBetween(Window.unboundedPreceding, -1)
    marked = nodes.withColumns({"_pos": F.col("pre").cast("long"), "_node": F.lit(True)})
    # text behind a nested element keeps the position of that element, so the last run in
    # page order is asked for, not the one at the highest position
    runs = texts.select(
        "page_id", F.col("pos").cast("long").alias("_pos"), F.struct(F.col("seq"), F.col("text")).alias("_run")
    )
    both = marked.unionByName(runs, allowMissingColumns=True)
    return both.withColumn(out, F.max("_run").over(w)["text"]).filter("_node").drop("_pos", "_run", "_node")


def page_texts(nodes: DataFrame) -> DataFrame:
    """Visible text runs with their place in page order: text of hidden elements does not count."""
    shown = nodes.withColumn("_hidden", inside(own_hidden())).filter(~F.col("_hidden"))
    return shown.select("page_id", F.explode("runs").alias("r")).select("page_id", "r.pos", "r.text", "r.seq")


def drop_repeats(texts: Column) -> Column:
    """Array without consecutive repeats."""
    return F.filter(texts, lambda x, i: (i == 0) | (x != F.element_at(texts, i)))


def page_text(texts: DataFrame, limit: int = PAGE_TEXT_CHARS) -> DataFrame:
    """Text of a page: runs in order, consecutive repeats dropped, one per line, cut at the limit."""
    runs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    per = texts.groupBy("page_id").agg(runs.alias("_runs"))
    return per.select("page_id", F.substring(F.array_join(let(F.col("_runs"), drop_repeats), "\n"), 1, limit).alias("page_text"))


def label_texts(nodes: DataFrame) -> DataFrame:
    """Text of ``<label for=id>`` by id; the last label of an id wins."""
    target = F.try_element_at("attrs", F.lit("for"))
    labels = nodes.filter((F.col("tag") == "label") & (F.coalesce(target, F.lit("")) != ""))
    return labels.groupBy("page_id", target.alias("_id")).agg(F.max_by("text", "pre").alias("_label_for"))


def select_options(nodes: DataFrame) -> DataFrame:
    """Options of each select in page order, and its current value (the selected option, else the first)."""
    attr = lambda n: F.try_element_at("attrs", F.lit(n))
    some = nodes.filter(F.col("tag").isin("select", "option"))  # no others are asked for, or looked at
    o = some.withColumn("_select", owner(F.col("tag") == "select")).filter((F.col("tag") == "option") & F.col("_select").isNotNull())
    shown = clip(first_filled(F.col("text"), attr("value"), F.lit("")))
    o = o.select(
        "page_id",
        "_select",
        "pre",
        F.coalesce(shown, F.lit("")).alias("_label"),
        first_filled(attr("value"), shown).alias("_value"),
        attr("selected").isNotNull().cast("int").alias("_on"),
    )
    listed = F.when(F.col("_label") != "", F.struct("pre", F.col("_label").alias("label"), F.col("_value").alias("value")))
    return o.groupBy("page_id", F.col("_select").alias("pre")).agg(
        F.transform(F.array_sort(F.collect_list(listed)), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("options"),
        F.max_by("_label", F.struct(F.col("_on"), -F.col("pre"))).alias("_chosen"),
    )


def per_page(rows: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """One map per page from the rows of each key, so that nodes laid out by page find them where they are."""
    return rows.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(out))


def describe(nodes: DataFrame) -> DataFrame:
    """Every element with role, label, current value, options, operations and visibility.

    The elements are dealt by page once, for the texts before them; labels and options come as
    one row per page.
    """
    attr = lambda n: F.try_element_at("attrs", F.lit(n))
    tag = F.col("tag")
    n = preceding_text(nodes, page_texts(nodes))
    field = tag.isin("input", "select", "textarea")
    n = n.join(per_page(label_texts(nodes), "_id", F.col("_label_for"), "_labels"), "page_id", "left")
    n = n.withColumn("_label_for", F.when(field, F.try_element_at("_labels", attr("id")))).drop("_labels")
    n = n.join(per_page(select_options(nodes), "pre", F.struct("options", "_chosen"), "_selects"), "page_id", "left")
    n = n.withColumn("_list", F.when(tag == "select", F.try_element_at("_selects", F.col("pre")))).drop("_selects")
    n = n.withColumns({"options": F.col("_list.options"), "_chosen": F.col("_list._chosen"), "role": role_of(tag, attr("type"), attr("role"))})
    role = F.col("role")
    label = first_filled(
        attr("aria-label"), attr("placeholder"), attr("title"), attr("alt"),
        F.when((tag == "input") & (role == "button"), attr("value")),
        F.when(field, first_filled(F.col("_label_for"), F.col("preceding"))),
        F.col("text"), attr("value"), attr("name"), attr("id"), role,
    )
    value = (
        F.when(tag == "select", F.coalesce("_chosen", F.lit("")))
        .when(tag == "textarea", clip("text"))
        .when((tag == "input") & role.isin("textbox", "searchbox", "combobox"), clip(attr("value")))
    )
    return n.withColumns(
        {
            "label": clip(label),
            "value": value,
            "operations": operations_of(tag, attr("type"), role, attr("contenteditable")),
            "hidden": inside(own_hidden()),
            "in_select": inside(tag == "select", proper=True),
            "acts": tag.isin(*INTERACTIVE_TAGS)
            | F.coalesce(attr("role"), F.lit("")).isin(*INTERACTIVE_ROLES)
            | attr("onclick").isNotNull()
            | F.coalesce(attr("contenteditable"), F.lit("no")).isin("true", ""),
        }
    ).drop("_list", "_label_for", "_chosen", "preceding")


def related(g_pre: str, g_last: str) -> Column:
    """The node is the gold one, an ancestor or a descendant of it."""
    pre, last = F.col("pre"), F.col("last")
    return pre.between(F.col(g_pre), F.col(g_last)) | F.col(g_pre).between(pre, last)


def climb(nodes: DataFrame, steps: DataFrame, hops: int = 3) -> DataFrame:
    """Nearest interactive node of a step's node and its first ancestors, else the node itself.

    ``steps``: step_id, page_id, hit (pre). ``nodes``: page_id, pre, parent, interactive.
    """
    links = nodes.select("page_id", F.col("pre").alias("_cur"), F.col("parent").alias("_up"), "interactive")
    out = steps.withColumn("_cur", F.col("hit")).withColumn("gold", F.lit(None).cast(nodes.schema["pre"].dataType))
    for _ in range(hops + 1):
        out = out.join(links, ["page_id", "_cur"], "left")
        out = out.withColumn("gold", F.coalesce("gold", F.when(F.col("interactive"), F.col("_cur")))).withColumn("_cur", F.col("_up"))
        out = out.drop("_up", "interactive")
    return out.withColumn("gold", F.coalesce("gold", "hit")).drop("_cur")


def visible_box(attributes_json: Column) -> Column:
    """Zero-size and page-sized boxes are out; a missing or malformed box is kept."""
    parts = F.split(F.get_json_object(attributes_json, "$.bounding_box_rect"), ",")
    num = lambda i: F.trim(parts[i]).try_cast("double")
    whole = (F.size(parts) == 4) & num(0).isNotNull() & num(1).isNotNull() & num(2).isNotNull() & num(3).isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)), (num(2) > 0) & (num(3) > 0) & (num(3) < MAX_BOX_HEIGHT)).otherwise(True)


# ---- accessibility trees

# fixed value: one line of a tree
TREE_LINE = r"^(\t*)(?:\[(\d+)\] )?([\w-]+) '(.*)$"


def tree_lines(tree: Column | str) -> Column:
    """Node lines of an accessibility tree: array<struct<depth,id,role,name,props>>."""
    pattern = r"(?U)" + TREE_LINE
    raw = F.filter(F.split(tree, "\n"), lambda x: x.rlike(pattern))

    def fields(line: Column) -> Column:
        rest = F.regexp_extract(line, pattern, 4)
        cut = F.instr(rest, "', ")
        name = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(F.regexp_replace(rest, "'+$", ""))
        return F.struct(
            F.length(F.regexp_extract(line, pattern, 1)).alias("depth"),
            F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).alias("id"),
            F.regexp_extract(line, pattern, 3).alias("role"),
            norm_ws(name).alias("name"),
            F.when(cut > 0, F.substring(rest, cut + 3, F.length(rest))).otherwise("").alias("props"),
        )

    return F.transform(raw, fields)


FOLD = 256  # results that a fold collects before it files them: appending to one array would cost the square of its length
LABEL_NAMES = 200  # names below a node that its label can come from: more than a label has characters


def _folded(items: Column, state: Column, result_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The results of a left fold over an array, one per item; ``step`` gives the next state and a result."""
    none = F.array().cast(f"array<{result_type}>")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / FOLD)).cast("int")), lambda c: F.slice(items, c * FOLD + 1, F.lit(FOLD)))

    def one(acc: Column, x: Column) -> Column:
        after, result = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(result.cast(result_type))).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["filed"], F.array(r["out"])).alias("filed")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{result_type}>>").alias("filed"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(pieces, start, piece)["filed"])).otherwise(none)


def tree_places(lines: Column) -> Column:
    """array<struct<parent,last,named>> of node lines: the nearest line above that is less deep, the end of the interval, names up to here.

    The open lines stand on a stack in the state of the fold, as deep as the tree at most; the
    ends come from the same fold from the last line on. A page root closes all and is no node.
    """
    stack = F.array().cast("array<struct<depth:int,i:int>>")
    items = F.transform(lines, lambda x, i: F.struct(x["depth"].alias("depth"), i.alias("i"), (x["role"] == "RootWebArea").alias("root"), (x["name"] != "").cast("int").alias("named")))

    def down(state: Column, x: Column) -> tuple[Column, Column]:
        held = F.when(x["root"], stack).otherwise(F.filter(state["open"], lambda e: e["depth"] < x["depth"]))
        now = F.when(x["root"], stack).otherwise(F.concat(held, F.array(F.struct(x["depth"].alias("depth"), x["i"].alias("i")))))
        names = state["names"] + x["named"]
        parent = F.try_element_at(held, F.lit(-1))["i"]
        return F.struct(now.alias("open"), names.alias("names")), F.struct(parent.alias("parent"), names.alias("named"))

    def up(state: Column, x: Column) -> tuple[Column, Column]:
        depth = F.when(x["root"], F.lit(-1)).otherwise(x["depth"])
        behind = F.try_element_at(F.filter(state, lambda e: e["depth"] <= depth), F.lit(-1))["i"]
        now = F.concat(F.filter(state, lambda e: e["depth"] < depth), F.array(F.struct(depth.alias("depth"), x["i"].alias("i"))))
        return now, F.when(x["root"], x["i"]).otherwise(behind - 1)

    def both(it: Column) -> Column:
        above = _folded(it, F.struct(stack.alias("open"), F.lit(0).alias("names")), "struct<parent:int,named:int>", down)
        ends = F.reverse(_folded(F.reverse(it), stack, "int", up))
        return F.zip_with(above, ends, lambda a, e: F.struct(a["parent"].alias("parent"), F.coalesce(e, F.size(it) - 1).alias("last"), a["named"].alias("named")))

    return let(items, both)


def ax_tree_nodes(trees: DataFrame) -> DataFrame:
    """Nodes of accessibility trees (tree_id, tree) with interval, parent and label.

    A tree is one input row, so it is walked where it is read, without a shuffle, in the JVM. The
    label is the name, else the names below, else the role.
    """
    read = trees.select(F.col("tree_id").cast("long"), tree_lines("tree").alias("lines"))
    placed = read.withColumns({"places": tree_places(F.col("lines")), "names": F.filter(F.transform("lines", lambda x: x["name"]), lambda x: x != "")})

    def node(x: Column, i: Column) -> Column:
        place = F.get("places", i)
        many = F.get("places", place["last"])["named"] - place["named"]
        below = F.array_join(F.slice("names", place["named"] + 1, F.least(many, F.lit(LABEL_NAMES))), " ")
        own = [x[c].alias(c) for c in ("depth", "id", "role", "name", "props")]
        return F.struct(place["last"].alias("last"), place["parent"].alias("parent"), *own, F.when(x["name"] == "", below).otherwise("").alias("below"))

    nodes = placed.select("tree_id", F.posexplode(F.transform("lines", node)).alias("pre", "node")).select("tree_id", "pre", "node.*")
    return nodes.withColumn("label", first_filled(clip("name"), clip("below"), F.col("role"))).drop("below")


def tree_page(nodes: DataFrame) -> DataFrame:
    """Title, URL and text lines of each tree."""
    root = F.col("role") == "RootWebArea"
    line = F.when(F.col("role").isin("StaticText", "heading") & (F.col("name") != ""), F.struct("pre", "name"))
    return nodes.groupBy("tree_id").agg(
        F.max_by(F.when(root, F.col("name")), F.when(root, F.col("pre"))).alias("title"),
        F.max_by(F.when(root, F.regexp_extract("props", r"url='([^']*)'", 1)), F.when(root, F.col("pre"))).alias("root_url"),
        F.transform(F.array_sort(F.collect_list(line)), lambda x: x["name"]).alias("lines"),
    )
