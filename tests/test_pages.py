import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepline.functions import actions as A
from stepline.operators import convert as C
from stepline.operators import pages as P

ROOMS = "".join(f'<button name="r{i}">Room {i}</button>' for i in range(14))
MUSEUM = f"""<!DOCTYPE html><html lang="en"><head><title>Museum hours</title><style>i{{}}</style></head><body>
<form id="booking"><fieldset><label for="mail">Your address</label><input type="email" id="mail" value="a@b.example"></fieldset>
<p>Guests</p><select id="guests"><option value="1">One</option><option value="2" selected>Two</option><option value="9">A group</option></select>
<summary id="more"><i id="word">Show <u>all</u> rooms</i></summary> beside it
<section style="visibility: hidden"><button>Staff only</button>unseen words</section><!-- remark -->words behind it
<ol><li>East wing<li>West wing</ol>{ROOMS}</form></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return P.page_nodes(spark.createDataFrame([(1, MUSEUM)], "page_id long, html string")).persist()


@pytest.fixture(scope="module")
def described(nodes):
    return P.describe(nodes).persist()


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_tree_shape(nodes):
    rows = by(nodes, "pre")
    for r in rows.values():
        if r["parent"] is not None:
            up = rows[r["parent"]]
            assert up["pre"] < r["pre"] <= r["last"] <= up["last"] and r["depth"] == up["depth"] + 1
    tags = [rows[i]["tag"] for i in sorted(rows)]
    assert tags[:4] == ["html", "head", "title", "style"] and tags.count("li") == 2
    items = [r for r in rows.values() if r["tag"] == "li"]
    assert [r["text"] for r in items] == ["East wing", "West wing"] and items[0]["depth"] == items[1]["depth"]


def test_labels_values_and_operations(described):
    rows = {r["attrs"].get("id"): r for r in described.collect()}
    assert (rows["mail"]["label"], rows["mail"]["value"], rows["mail"]["role"]) == ("Your address", "a@b.example", "textbox")
    assert rows["mail"]["operations"] == ["TYPE_TEXT", "CLICK"]
    assert (rows["guests"]["label"], rows["guests"]["value"], rows["guests"]["operations"]) == ("Guests", "Two", ["SELECT"])
    assert [(o["label"], o["value"]) for o in rows["guests"]["options"]] == [("One", "1"), ("Two", "2"), ("A group", "9")]
    assert rows["word"]["label"] == "Show all rooms"


def test_hidden_is_inherited_and_not_page_text(nodes, described):
    hidden = {r["label"] for r in described.filter("hidden and tag = 'button'").collect()}
    assert hidden == {"Staff only"}
    text = P.page_text(P.page_texts(nodes)).first()["page_text"].split("\n")
    assert "unseen words" not in text and "words behind it" not in text and "i{}" not in text
    at = text.index("Show")
    assert text[:2] == ["Your address", "Guests"] and text[at : at + 4] == ["Show", "all", "rooms", "beside it"]


def test_preceding_text_looks_strictly_back(nodes):
    rows = {r["tag"]: r["preceding"] for r in P.preceding_text(nodes, P.page_texts(nodes)).filter("tag in ('input', 'select', 'html')").collect()}
    assert rows == {"input": "Your address", "select": "Guests", "html": None}


def convert(spark, described, op, selector, wanted=None, **kw):
    attr = F.try_element_at("attrs", F.lit("id"))
    weight = F.when(F.col("tag").isin(*P.INTERACTIVE_TAGS), 3.0).otherwise(1.0)
    d = described.withColumns(
        {
            "candidate": F.col("acts") & ~F.col("hidden") & (F.col("tag") != "option") & ~F.col("in_select"),
            "weight": weight,
            "options": F.coalesce("options", F.array().cast("array<struct<label:string,value:string>>")),
        }
    )
    hit = described.filter(attr == selector).first()["pre"]
    links = described.select("page_id", "pre", "parent", (F.col("acts") & ~F.col("hidden")).alias("interactive"))
    start = spark.createDataFrame([("x", 1, hit)], "step_id string, page_id long, hit int")
    s = P.climb(links, start).select("step_id", "page_id", "gold", "hit", F.lit(op).alias("op"), F.lit(wanted).cast("string").alias("wanted"),
        F.lit("Book a visit").alias("goal"), F.lit("http://museum/").alias("url"), F.lit("Museum").alias("title"), F.lit("text").alias("page_text"),
        F.array().cast(f"array<{A.ENTRY_TYPE}>").alias("history"), F.lit(None).cast("string").alias("skip_reason"))
    r = C.convert_steps(d, s, **kw).first()
    return r, r["request"] and json.loads(r["request"]), r["labels"] and json.loads(r["labels"])


def target_of(request, labels):
    q = labels["operation"].lower() + "_target"
    return request["questions"][q]["criteria"][labels[q]]["element"]


def test_click_climbs_from_span_to_button(spark, described):
    r, request, labels = convert(spark, described, "CLICK", "word", k_min=8, k_max=12)
    assert r["skip_reason"] is None and target_of(request, labels).endswith("] Show all rooms")
    shown = [e["label"] for e in request["state"]["elements"]]
    assert shown.count("Show all rooms") == 1 and "Staff only" not in shown and len(shown) == r["k"] <= 12
    assert [e["index"] for e in request["state"]["elements"]] == [str(i + 1) for i in range(len(shown))]
    menu = list(request["questions"]["operation"]["criteria"])
    assert menu[-3:] == ["WAIT", "DONE", "BLOCKED"] and "CLICK" in menu
    texts = [c["element"] for c in request["questions"]["click_target"]["criteria"].values()]
    assert len(texts) == len(set(texts))


def test_type_and_select_targets(spark, described):
    _, request, labels = convert(spark, described, "TYPE_TEXT", "mail", k_min=8, k_max=12)
    assert target_of(request, labels).endswith("] Your address")
    _, request, labels = convert(spark, described, "SELECT", "guests", " a GROUP ", k_min=8, k_max=12)
    assert target_of(request, labels).endswith("Guests → A group") and labels["select_target"].endswith(":3")


def test_skip_reasons(spark, described):
    assert convert(spark, described, "SELECT", "mail")[0]["skip_reason"] == "select_not_a_select"
    assert convert(spark, described, "SELECT", "guests", "Nobody")[0]["skip_reason"] == "select_option_not_found"
    assert convert(spark, described, "CLICK", "word", k_min=38, k_max=40)[0]["skip_reason"] == "too_few_candidates"


TREE = """RootWebArea 'Sums', focused, url='https://sums.example/'
\t[51] banner '', visible
\t\t[55] button 'UPGRADE', clickable
\t\t\tStaticText 'UPGRADE'
\t[74] main '', visible
\t\tStaticText 'Enter a sum'
\t\t[89] textbox 'Sum field', clickable
\t\t[91] button 'Go', clickable
\t\t\t[92] image '', visible
\t\t[108] link '', clickable
\t\t\tStaticText 'See'
\t\t\tStaticText 'more'
not a node"""


def test_accessibility_tree(spark):
    n = P.ax_tree_nodes(spark.createDataFrame([(7, TREE)], "tree_id long, tree string"))
    rows = {r["id"]: r for r in n.collect() if r["id"]}
    at = {r["pre"]: r for r in n.collect()}
    assert at[rows["92"]["parent"]]["id"] == "91" and at[rows["89"]["parent"]]["id"] == "74"
    assert rows["74"]["last"] == max(at) and rows["51"]["last"] == rows["55"]["pre"] + 1
    assert rows["108"]["label"] == "See more" and rows["92"]["label"] == "image"
    page = P.tree_page(n).first()
    assert (page["title"], page["root_url"]) == ("Sums", "https://sums.example/")
    assert page["lines"] == ["UPGRADE", "Enter a sum", "See", "more"]


def test_long_and_odd_trees_match_a_plain_walk(spark):
    import random

    rng = random.Random(8)

    def tree(n, deepest):
        out = []
        for k in range(n):
            root = rng.random() < 0.03
            name = rng.choice(["", f"name {k}", "x" * 90])
            out.append(f"RootWebArea '{name}', url='u'" if root else "\t" * rng.randint(0, deepest) + f"[{k}] {rng.choice(['button', 'link', 'group'])} '{name}', visible")
        return "\n".join(out)

    trees = [(1, tree(700, 6)), (2, tree(40, 1)), (3, ""), (4, "\t[1] button ''"), (5, None), (6, "\n".join("\t" * k + f"[{k}] group ''" for k in range(300)))]
    nodes = P.ax_tree_nodes(spark.createDataFrame(trees, "tree_id long, tree string"))
    for t in (1, 2, 4, 6):
        rows = sorted((r for r in nodes.filter(F.col("tree_id") == t).collect()), key=lambda r: r["pre"])
        for i, r in enumerate(rows):
            root = r["role"] == "RootWebArea"
            before = []
            for k in range(i - 1, -1, -1):
                if rows[k]["role"] == "RootWebArea":
                    break
                before.append(k)
            parent = None if root else next((k for k in before if rows[k]["depth"] < r["depth"]), None)
            end = next((k for k in range(i + 1, len(rows)) if rows[k]["role"] == "RootWebArea" or rows[k]["depth"] <= r["depth"]), len(rows))
            last = i if root else end - 1
            assert (r["pre"], r["parent"], r["last"]) == (i, parent, last)
            if r["name"] == "":
                inner = " ".join(x["name"] for x in rows[i + 1 : last + 1] if x["name"])
                assert r["label"].rstrip("…") == (inner or r["role"])[: len(r["label"].rstrip("…"))] and len(r["label"]) >= min(len(inner), 90)
    assert nodes.filter("tree_id in (3, 5)").count() == 0


def test_the_text_of_an_element_is_whole(spark):
    runs = [f"word{i} " * 3 for i in range(300)]
    html = "<body>" + "".join(f"<p>{r}</p>" for r in runs) + "<div>" + "x" * 5000 + "</div></body>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = {r["pre"]: r["text"] for r in P.page_nodes(pages).collect()}
    assert rows[0] == " ".join([*(" ".join(r.split()) for r in runs), "x" * 5000])
    assert all(len(r["text"]) <= 202 for r in P.page_nodes(pages, text_chars=202).collect())


def test_other_positives_are_no_negatives(spark):
    from stepline.operators import convert as C

    nodes = spark.range(10).selectExpr("1 as page_id", "cast(id as int) as pre", "cast(id as int) as last", "true as candidate")
    steps = spark.createDataFrame([(1, 2, 2, 2, [2, 4, 6]), (1, 3, 3, 3, None)], "page_id int, gold int, gold_last int, hit int, positives array<long>")
    near = C.near_gold(nodes, steps).filter("not is_gold").select("gold", "pre").collect()
    assert {r["pre"] for r in near if r["gold"] == 2} == {0, 1, 3, 5, 7, 8, 9}
    assert {r["pre"] for r in near if r["gold"] == 3} == {0, 1, 2, 4, 5, 6, 7, 8, 9}


def test_parser_holds_few_rows_and_characters_at_once():
    deep = "<div>" * 40 + "word " * 10_000 + "</div>" * 40
    flat = "<p>x</p>" * 2_500
    pages = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3, None], "html": [flat, deep, None, flat]})
    out = list(P._page_parser(P.VOID_TAGS, None)(iter([pages])))
    assert max(b.num_rows for b in out) <= 1_000 and max(b.nbytes for b in out) < 1_500_000
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["pre"] for r in rows] == [*range(2_500), *range(40), *range(2_500)]
    assert {r["page_id"] for r in rows[:2_500]} == {1} and {r["page_id"] for r in rows[2_540:]} == {None}
    assert all(r["text"] == ("word " * 10_000).strip() for r in rows[2_500:2_540])


def test_described_elements_are_dealt_by_page_only(spark, nodes):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        some = spark.createDataFrame(nodes.collect(), nodes.schema)
        plan = P.describe(some)._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(page_id" in line]
        joins = [line for line in plan.splitlines() if "Join [page_id" in line]
        assert joins and all(", pre#" not in j and ", _id#" not in j for j in joins)
        # texts before a node, the nodes, and for labels and selects one exchange by their key and one by page
        assert len(wide) <= 6
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_clipped_texts_come_in_small_batches_too():
    pages = pa.RecordBatch.from_pydict({"page_id": [7], "html": ["<p>x</p>" * 3_000 + f'<img alt="{"y" * 2_000_000}"><p>z</p>']})
    out = list(P._page_parser(P.VOID_TAGS, 1000)(iter([pages])))
    assert [b.num_rows for b in out] == [1_000, 1_000, 1_000, 1, 1]
