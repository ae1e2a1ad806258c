import pytest
from pyspark.sql import functions as F

from stepline.functions import actions as A
from stepline.functions import text as T
from stepline.operators import prompts


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["  a b\t\nc ", "", "x", " wide　space\x1cand\x85more ", None])
def test_norm_ws_is_split_and_join(spark, text):
    assert one(spark, T.norm_ws("t"), t=text) == " ".join((text or "").split())


def test_clip_marks_the_cut(spark):
    assert one(spark, T.clip("t", 5), t="abcde") == "abcde"
    assert one(spark, T.clip("t", 5), t="abc  def") == "abc…"


@pytest.mark.parametrize(
    ("raw", "goal"),
    [('- Task 4: ""Look for seafood."""', "Look for seafood."), ('Task 2: "Find a red shirt"', "Find a red shirt"), ("“plain”", "plain"), ("tasks 3: x", "tasks 3: x")],
)
def test_clean_goal(spark, raw, goal):
    assert one(spark, T.clean_goal("t"), t=raw) == goal


def test_render_json_nested(spark):
    text = one(spark, prompts.render_json("t"), t='{"a": 1, "b": [1, {"c": true, "d": null}], "e": {"f": 2.5}}')
    assert text == "a: 1\nb:\n  - 1\n  - c: True\n    d: \ne:\n  f: 2.5"


@pytest.mark.parametrize(
    ("reply", "kind", "args"),
    [
        ("x ```click [12]``` y", "CLICK", ["12"]),
        ("```hover [3]```", "CLICK", ["3"]),
        ("```type [7] [two words] [1]```", "TYPE_TEXT", ["7", "two words"]),
        ("```type [7] [a [b] c]```", "TYPE_TEXT", ["7", "a [b] c"]),
        ("first ```stop [x]``` then ```scroll [down]```", "SCROLL", ["down"]),
        ("```stop [a\nb]```", "STOP", ["a\nb"]),
        ("```goto [http://x]```", None, None),
        ("no block", None, None),
    ],
)
def test_replies(spark, reply, kind, args):
    got = one(spark, A.parse_reply("t"), t=reply)
    assert (got and got["kind"], got and got["args"]) == (kind, args)


@pytest.mark.parametrize(
    ("line", "entry"),
    [
        ("[combobox]  Kind -> SELECT: Pickup", ("Kind → Pickup", "select", None)),
        ("[searchbox]  Place -> TYPE: Boston", ("Place", "fill", "Boston")),
        ("[span]  -> CLICK", ("span", "click", None)),
        ("[a] b -> HOVER", ("b", "click", None)),
        ("nothing", None),
    ],
)
def test_action_lines(spark, line, entry):
    got = one(spark, A.parse_action_line("t"), t=line)
    assert (got and (got["action"], got["kind"], got["text"])) == entry


@pytest.mark.parametrize(
    ("line", "entry"),
    [
        ("1: None", None),
        ("2: type [89] [water chemistry ] where [89] is Input field", ("Input field", "fill", "water chemistry")),
        ("3: scroll [up]", ("Scroll up", "scroll", None)),
        ("4: click [1]", ("element", "click", None)),
        ("5: goto [x]", None),
    ],
)
def test_history_lines(spark, line, entry):
    got = one(spark, A.parse_history_line("t"), t=line)
    assert (got and (got["action"], got["kind"], got["text"])) == entry


def test_verdicts(spark):
    assert one(spark, A.parse_verdict("t"), t='ok {"done": true, "reason": "r"} .')["done"] is True
    assert one(spark, A.parse_verdict("t"), t='{"done": "true"}') is None
    assert one(spark, A.parse_verdict("t"), t="{broken") is None


def test_option_matches_and_fallback_label(spark):
    assert one(spark, T.option_matches("a", "b", "w"), a="Large  Size", b="l", w=" large size") is True
    assert one(spark, T.option_matches("a", "b", "w"), a="x", b="", w="") is False
    assert one(spark, T.fallback_label("v", "j"), v="", j='{"data": {"aria-label": "Go"}}') == "Go"
    assert one(spark, T.fallback_label("v", "j"), v="", j="not json") == "element"


def test_shrink_stages(spark):
    from stepline.operators.dataset import STATE_TYPE

    act = [(f"step {i}", "click", None, None) for i in range(120)]
    els = [("link", f"item {i}", None, str(i), ["CLICK"], None) for i in range(60)]
    rows = [
        ("fits", (("u", "t", "short"), [], [])),
        ("text", (("u", "t", "word " * 900), [], [])),
        ("url", (("u" * 3000, "t", "x"), [], [])),
        ("actions", (("u", "t", "x"), [], act)),
        ("strings", (("u", "t", "x"), [("a", "label " * 900, None, "1", ["CLICK"], None)], [])),
        ("elements", (("u", "t", "x"), els, [])),
        ("options", (("u", "t", "x"), [("a", "b", None, "1", ["SELECT"], [(f"1:{j}", f"Country {j}", "c") for j in range(60)])], [])),
        ("stuck", (("u", "t" * 5000, "x"), [], [])),
    ]
    df = spark.createDataFrame(rows, f"name string, state {STATE_TYPE}")
    got = {r["name"]: r["x"] for r in df.select("name", prompts.shrink(F.col("state"), 2200).alias("x")).collect()}
    for name in ("text", "url", "actions", "strings", "elements", "options"):
        assert (got[name]["stage"], got[name]["fits"]) == (name, True), name
    assert got["fits"]["stage"] == "none" and not got["stuck"]["fits"]
    assert len(got["actions"]["state"]["recent_actions"]) == 3
    assert 20 <= len(got["elements"]["state"]["elements"]) < 60
