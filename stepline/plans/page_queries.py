"""Registered queries: page trees, candidates, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.functions import text as T
from stepline.functions.actions import first_failure
from stepline.functions.hashing import uniform, uniform_int
from stepline.operators import convert as C
from stepline.operators import pages as P
from stepline.operators.sampling import weighted_sample
from stepline.operators.selectors import resolve_unique as resolve
from stepline.plans import oracle as O
from stepline.plans import views as V
from stepline.plans.registry import query
from stepline.sources.tables import table

# the gold node of a page: the first of three candidates that exists
_GOLD = """SELECT page_id, (array_agg(pre ORDER BY i))[1] AS gold, (array_agg(last ORDER BY i))[1] AS gold_last, (array_agg(label ORDER BY i))[1] AS gold_label FROM (
  SELECT c.page_id, c.i, n.pre, n.last, n.label FROM cands c JOIN nodes n ON n.page_id=c.page_id AND n.pre=c.cand) GROUP BY page_id"""
_CANDS = """SELECT page_id, i, ((page_id*(i+3)+i*5)%40)::BIGINT AS cand FROM pages, range(0,3) r(i) WHERE page_id%10<>0"""
_G = dict(cands=_CANDS, gold=_GOLD)


def _positives(spark, folder):
    p = table(spark, folder, "pages").select("page_id")
    arr = F.array(*[(F.col("page_id") * (i + 3) + i * 5) % 40 for i in range(3)])
    return p.select("page_id", F.when(F.col("page_id") % 10 != 0, arr).otherwise(F.array().cast("array<bigint>")).alias("cands"))


def gold_of(positives, nodes):
    """First positive candidate of each page that exists among its nodes."""
    listed = positives.select("page_id", F.posexplode("cands").alias("i", "pre"))
    hit = listed.join(nodes.select("page_id", "pre", "last", "label"), ["page_id", "pre"])
    return hit.groupBy("page_id").agg(F.min(F.struct("i", "pre", "last", "label")).alias("g")).select(
        "page_id", F.col("g.pre").alias("gold"), F.col("g.last").alias("gold_last"), F.col("g.label").alias("gold_label")
    )


def _gold(spark, folder):
    return gold_of(_positives(spark, folder), V.flat_nodes(spark, folder))


@query(
    "gold_node",
    O.sql(
        "nodes",
        """SELECT p.page_id, gold, CASE WHEN p.page_id%10=0 THEN 'no_positive' WHEN gold IS NULL THEN 'positive_not_in_html' END AS skip_reason
        FROM pages p LEFT JOIN gold USING (page_id)""",
        **_G,
    ),
)
def gold_node(spark, folder):
    p = _positives(spark, folder)
    j = p.join(_gold(spark, folder), "page_id", "left")
    reason = first_failure([(F.size("cands") == 0, "no_positive"), (F.col("gold").isNull(), "positive_not_in_html")])
    return j.select("page_id", "gold", reason.alias("skip_reason"))


_NEG = """SELECT n.*, g.gold, g.gold_last, g.gold_label FROM nodes n JOIN gold g USING (page_id) WHERE NOT (n.pre BETWEEN g.gold AND g.gold_last OR g.gold BETWEEN n.pre AND n.last)
  AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.page_id=n.page_id AND c.cand=n.pre)"""


def near_nodes(spark, folder):
    """Gold and unrelated nodes per page; other positives are no negatives."""
    n = V.flat_nodes(spark, folder).withColumn("candidate", F.lit(True)).withColumn("weight", F.when(F.col("tag") == "a", 3.0).otherwise(1.0))
    steps = _gold(spark, folder).withColumn("hit", F.col("gold")).join(_positives(spark, folder).withColumnRenamed("cands", "positives"), "page_id")
    return C.near_gold(n, steps).drop("positives")


def _negatives(spark, folder):
    return near_nodes(spark, folder).filter(~F.col("is_gold"))


@query("exclude_related", O.sql("nodes", "SELECT page_id, pre FROM neg", **_G, neg=_NEG))
def exclude_related(spark, folder):
    return _negatives(spark, folder).select("page_id", "pre")


_UNIQ = "SELECT * FROM neg WHERE lower(label)<>lower(gold_label) QUALIFY row_number() OVER (PARTITION BY page_id, lower(label) ORDER BY pre)=1"


@query("keep_first_label", O.sql("nodes", "SELECT page_id, pre, label FROM uniq", **_G, neg=_NEG, uniq=_UNIQ))
def keep_first_label(spark, folder):
    return C.unique_labels(near_nodes(spark, folder), ["page_id"]).filter("not is_gold").select("page_id", "pre", "label")


_W = "CASE WHEN tag='a' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END"
_DRAWN = f"""SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pow({O.unit(O.key('0-draw', 'page_id', 'pre'))},1/{_W}) DESC, pre)
  <= (8+floor({O.unit(O.key('0-k', 'page_id'))}*33))::BIGINT-1"""


@query("weighted_sample", O.sql("nodes", "SELECT page_id, pre FROM drawn", **_G, neg=_NEG, uniq=_UNIQ, drawn=_DRAWN))
def weighted_sample_nodes(spark, folder):
    n = C.unique_labels(near_nodes(spark, folder), ["page_id"]).filter("not is_gold")
    weight = F.when(F.col("tag") == "a", 3.0).otherwise(1.0)
    k = uniform_int("0-k", C.K_MIN, C.K_MAX, "page_id") - 1
    return weighted_sample(n, ["page_id"], weight, uniform("0-draw", "page_id", "pre"), "pre", k).select("page_id", "pre")


_OFFERED = f"""SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {O.key('0-order', 'page_id', 'pre')}, pre) AS index FROM (
  SELECT page_id, pre, tag, label, false AS is_gold FROM drawn UNION ALL
  SELECT n.page_id, n.pre, n.tag, n.label, true FROM nodes n JOIN gold g ON g.page_id=n.page_id AND g.gold=n.pre)"""
_STEPS = dict(**_G, neg=_NEG, uniq=_UNIQ, drawn=_DRAWN, off=_OFFERED)


def _offered(spark, folder):
    return C.offered(C.unique_labels(near_nodes(spark, folder), ["page_id"]), ["page_id"], "0")


@query("element_index", O.sql("nodes", "SELECT page_id, pre, index, is_gold FROM off", **_STEPS))
def element_index(spark, folder):
    return _offered(spark, folder).select("page_id", "pre", F.col("index").cast("long").alias("index"), "is_gold")


# links are clicked, paragraphs typed into, the gold is always clickable
_OPS = "CASE WHEN tag='span' THEN ['TYPE_TEXT','CLICK'] ELSE ['CLICK'] END"


@query("element_operations", O.sql("nodes", f"SELECT page_id, pre, array_to_string(CASE WHEN is_gold AND page_id%4=0 AND tag<>'span' THEN list_concat(['TYPE_TEXT'],{_OPS}) ELSE {_OPS} END,'|') AS operations FROM off", **_STEPS))
def element_operations(spark, folder):
    o = _operable(_offered(spark, folder))
    return o.select("page_id", "pre", F.array_join("operations", "|").alias("operations"))


def _operable(off):
    kind = F.when(F.col("tag") == "span", "textarea").otherwise(F.col("tag"))
    ops = P.operations_of(kind, F.lit(None).cast("string"), F.lit("generic"), F.lit(None).cast("string"))
    op = F.when(F.col("page_id") % 4 == 0, "TYPE_TEXT").otherwise("CLICK")
    return off.withColumn("operations", P.with_gold_operation(ops, F.when(F.col("is_gold"), op))).withColumn("op", op)


_TARGETS = """SELECT page_id, 'CLICK' AS op, index::VARCHAR AS key, '['||index||'] '||CASE WHEN tag='span' OR (is_gold AND page_id%4=0) THEN 'Open ' ELSE '' END||label AS element, is_gold AS gold FROM off
  UNION ALL SELECT page_id, 'TYPE_TEXT', index::VARCHAR, '['||index||'] '||label, is_gold FROM off WHERE tag='span' OR (is_gold AND page_id%4=0)"""


@query("target_criteria", O.sql("nodes", "SELECT page_id, op, key, element, gold FROM t", **_STEPS, t=_TARGETS))
def target_criteria(spark, folder):
    o = _operable(_offered(spark, folder)).withColumns({"value": F.lit(""), "role": F.col("tag")})
    e = F.struct("index", "label", "value", "role", "operations", "is_gold")
    t = F.explode_outer(C.element_targets(e, F.lit(""), with_options=False)).alias("t")
    return o.select("page_id", t).select("page_id", "t.op", "t.key", "t.element", "t.gold")


@query(
    "operation_menu",
    f"""SELECT event_id, array_to_string(list_concat(list_concat(
      [x[2] for x in list_sort([[{O.key('0', 'event_id', "'CLICK'")},'CLICK'],[{O.key('0', 'event_id', "'TYPE_TEXT'")},'TYPE_TEXT']])],
      CASE WHEN {O.unit(O.key('0-down', 'event_id'))}<0.8::DOUBLE THEN ['SCROLL_DOWN'] ELSE [] END),
      list_concat(CASE WHEN {O.unit(O.key('0-up', 'event_id'))}<0.3::DOUBLE THEN ['SCROLL_UP'] ELSE [] END, ['WAIT','DONE','BLOCKED'])),'|') AS menu FROM events""",
)
def operation_menu(spark, folder):
    e = table(spark, folder, "events").select("event_id")
    present = F.array(F.lit("CLICK"), F.lit("TYPE_TEXT"))
    return e.select("event_id", F.array_join(C.operation_menu(present, "0", ["event_id"]), "|").alias("menu"))


@query(
    "hidden_node",
    O.sql("nodes", """SELECT n.page_id, n.pre, EXISTS (SELECT 1 FROM nodes h WHERE h.page_id=n.page_id AND h.tag='span' AND h.pre%3=0 AND n.pre BETWEEN h.pre AND h.last) AS hidden FROM nodes n"""),
)
def hidden_node(spark, folder):
    n = V.flat_nodes(spark, folder)
    return n.select("page_id", "pre", P.inside((F.col("tag") == "span") & (F.col("pre") % 3 == 0)).alias("hidden"))


@query(
    "interactive_node",
    O.sql(
        "nodes",
        """SELECT page_id, pre FROM nodes n WHERE (tag='a' OR pre%6=0) AND NOT EXISTS (SELECT 1 FROM nodes s WHERE s.page_id=n.page_id AND s.tag='h1' AND s.pre<n.pre AND n.pre<=s.last)""",
    ),
)
def interactive_node(spark, folder):
    n = V.flat_nodes(spark, folder).withColumn("in_select", P.inside(F.col("tag") == "h1", proper=True))
    acts = F.col("tag").isin(*P.INTERACTIVE_TAGS) | (F.col("pre") % 6 == 0)
    return n.filter(acts & ~F.col("in_select")).select("page_id", "pre")


@query(
    "preceding_text",
    O.sql("nodes", """SELECT n.page_id, n.pre, (SELECT arg_max(t.label, t.pre) FROM nodes t WHERE t.page_id=n.page_id AND t.tag='span' AND t.label<>'' AND t.pre<n.pre) AS preceding FROM nodes n"""),
)
def preceding_text(spark, folder):
    n = V.flat_nodes(spark, folder)
    runs = n.filter((F.col("tag") == "span") & (F.col("label") != "")).select("page_id", F.col("pre").alias("pos"), F.col("label").alias("text"), F.col("pre").alias("seq"))
    return P.preceding_text(n, runs).select("page_id", "pre", "preceding")


@query(
    "label_for",
    O.sql(
        "nodes",
        """SELECT n.page_id, n.pre, l.label AS label_for FROM nodes n LEFT JOIN (
        SELECT page_id, 'f'||(pre//10*10+3) AS id, arg_max(label, pre) AS label FROM nodes WHERE pre%5=0 GROUP BY ALL) l ON l.page_id=n.page_id AND l.id='f'||n.pre""",
    ),
)
def label_for(spark, folder):
    pre = F.col("pre")
    is_label = pre % 5 == 0
    attrs = F.when(is_label, F.create_map(F.lit("for"), F.concat(F.lit("f"), F.floor(pre / 10) * 10 + 3))).otherwise(F.create_map(F.lit("x"), F.lit("")))
    n = V.flat_nodes(spark, folder)
    labels = P.label_texts(n.select("page_id", "pre", F.when(is_label, "label").otherwise("p").alias("tag"), attrs.alias("attrs"), F.col("label").alias("text")))
    fields = n.select("page_id", "pre", F.concat(F.lit("f"), pre).alias("_id"))
    return fields.join(labels, ["page_id", "_id"], "left").select("page_id", "pre", F.col("_label_for").alias("label_for"))


@query(
    "climb_interactive",
    O.sql(
        "nodes",
        """SELECT page_id, hit, coalesce(CASE WHEN i0 THEN hit END, CASE WHEN i1 THEN p1 END, CASE WHEN i2 THEN p2 END, CASE WHEN i3 THEN p3 END, hit) AS gold FROM (
        SELECT a.page_id, a.pre AS hit, a.i AS i0, a.parent AS p1, b.i AS i1, b.parent AS p2, c.i AS i2, c.parent AS p3, d.i AS i3 FROM k a
        LEFT JOIN k b ON b.page_id=a.page_id AND b.pre=a.parent LEFT JOIN k c ON c.page_id=b.page_id AND c.pre=b.parent
        LEFT JOIN k d ON d.page_id=c.page_id AND d.pre=c.parent)""",
        k="SELECT page_id, pre, parent, tag='a' AND pre%4=0 AS i FROM nodes",
    ),
)
def climb_interactive(spark, folder):
    n = V.flat_nodes(spark, folder).select("page_id", "pre", "parent", ((F.col("tag") == "a") & (F.col("pre") % 4 == 0)).alias("interactive"))
    steps = n.select("page_id", F.col("pre").alias("hit"))
    return P.climb(n, steps).select("page_id", "hit", "gold")


# fixed values: a selector for each remainder of the page number, and the elements it means
_SELECTORS = {
    "h1": "n.tag='h1'",
    "a": "n.tag='a'",
    "#f3": "n.pre=3",
    "span.c1.k2": "n.tag='span' AND n.pre%3=1 AND n.pre%4=2",
    "a .c2": "n.pre%3=2 AND EXISTS (SELECT 1 FROM nodes u WHERE u.page_id=n.page_id AND u.tag='a' AND u.pre<n.pre AND n.pre<=u.last)",
    "#f8 > .k2 > *": "EXISTS (SELECT 1 FROM nodes u WHERE u.page_id=n.page_id AND u.pre=n.parent AND u.parent=8 AND u.pre%4=2)",
    "em#f5.c2": "n.tag='em' AND n.pre=5 AND n.pre%3=2",
    "#f0 span a.k3": "n.tag='a' AND n.pre%4=3 AND EXISTS (SELECT 1 FROM nodes u JOIN nodes o ON o.page_id=u.page_id AND o.pre=0 AND u.pre>0 AND u.pre<=o.last WHERE u.page_id=n.page_id AND u.tag='span' AND u.pre<n.pre AND n.pre<=u.last)",
    "a[href]": "false",
}
_CASES = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_SELECTORS.values()))
_NAMES = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_SELECTORS))


@query(
    "resolve_unique",
    O.sql(
        "nodes",
        f"""SELECT page_id, selector, max(pre) AS pre FROM (SELECT n.page_id, n.pre, CASE n.page_id%{len(_SELECTORS)} {_NAMES} END AS selector FROM nodes n
        WHERE CASE n.page_id%{len(_SELECTORS)} {_CASES} END) GROUP BY ALL HAVING count(*)=1""",
    ),
)
def resolve_unique(spark, folder):
    """Tags, ids, classes, compounds, descendants and children; only what means one element counts."""
    place = (F.col("page_id") % len(_SELECTORS) + 1).cast("int")
    wanted = table(spark, folder, "pages").select("page_id", F.element_at(F.array(*[F.lit(x) for x in _SELECTORS]), place).alias("selector"))
    return resolve(V.flat_nodes(spark, folder), wanted)


@query(
    "dedupe_consecutive",
    O.sql(
        "nodes",
        """SELECT page_id, substring(string_agg(label, chr(10) ORDER BY pre),1,6000) AS page_text FROM (
        SELECT page_id, pre, label, lag(label) OVER (PARTITION BY page_id ORDER BY pre) AS before FROM nodes WHERE label<>'')
        WHERE before IS DISTINCT FROM label GROUP BY page_id""",
    ),
)
def dedupe_consecutive(spark, folder):
    n = V.flat_nodes(spark, folder).filter("label <> ''")
    return P.page_text(n.select("page_id", F.col("label").alias("text"), F.col("pre").alias("seq")))


@query(
    "role_of",
    O.sql("nodes", """SELECT page_id, pre, CASE WHEN pre%7=0 THEN 'tab' WHEN pre%2=0 THEN CASE pre%10 WHEN 0 THEN 'checkbox' WHEN 2 THEN 'button' WHEN 4 THEN 'searchbox' ELSE 'textbox' END
      WHEN tag='a' THEN 'link' ELSE tag END AS role FROM nodes"""),
)
def role_of(spark, folder):
    pre = F.col("pre")
    kind = F.when(pre % 10 == 0, "Checkbox").when(pre % 10 == 2, "submit").when(pre % 10 == 4, "SEARCH").when(pre % 10 == 6, "email")
    n = V.flat_nodes(spark, folder)
    return n.select("page_id", "pre", P.role_of(F.when(pre % 2 == 0, "input").otherwise(F.col("tag")), kind, F.when(pre % 7 == 0, "tab")).alias("role"))


@query(
    "element_label",
    O.sql("nodes", "SELECT page_id, pre, CASE WHEN pre%7=0 THEN 'aria '||pre WHEN pre%7=1 THEN 'hint' WHEN label<>'' THEN label ELSE 'n'||pre END AS label FROM nodes"),
)
def element_label(spark, folder):
    pre = F.col("pre")
    aria, hint = F.when(pre % 7 == 0, F.concat(F.lit("aria "), pre)), F.when(pre % 7 == 1, "hint").otherwise("")
    label = P.first_filled(aria, hint, F.col("label"), F.concat(F.lit("n"), pre))
    return V.flat_nodes(spark, folder).select("page_id", "pre", T.clip(label).alias("label"))


@query(
    "visible_box",
    """SELECT event_id, CASE WHEN user_id%9=0 OR user_id%9=1 THEN true ELSE value>0 AND user_id%50>0 AND user_id%50*40<1500 END AS visible FROM events""",
)
def visible_box(spark, folder):
    e = table(spark, folder, "events")
    rect = F.format_string("0,0,%s,%s", F.col("value").cast("string"), (F.col("user_id") % 50 * 40).cast("string"))
    attrs = (
        F.when(F.col("user_id") % 9 == 0, '{"x": 1}')
        .when(F.col("user_id") % 9 == 1, '{"bounding_box_rect": "0,0,wide"}')
        .otherwise(F.concat(F.lit('{"bounding_box_rect": "'), rect, F.lit('"}')))
    )
    return e.select("event_id", P.visible_box(attrs).alias("visible"))


_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
_DOCTEXT = "CASE WHEN doc_id%7=0 THEN '日本語'||text WHEN doc_id%7=1 THEN repeat('日本', (length(text)//20)::INT+1)||text ELSE text END"


@query(
    "language_gate",
    f"""SELECT 'd'||doc_id AS id, (lang='en' OR doc_id%5=0) AND len(regexp_extract_all(t,'{_CJK}'))::DOUBLE/greatest(1,length(t))<=0.05::DOUBLE AS page_ok,
    NOT regexp_matches(t,'{_CJK}') AS goal_ok FROM (SELECT *, {_DOCTEXT} AS t FROM documents)
    UNION ALL SELECT 'p'||page_id, starts_with(lower(regexp_extract(html,'<html[^>]* lang="([^"]*)"',1)),'en') OR regexp_extract(html,'<html[^>]* lang="([^"]*)"',1)='',
    NOT regexp_matches(html,'{_CJK}') FROM pages""",
)
def language_gate(spark, folder):
    d = table(spark, folder, "documents")
    i, t = F.col("doc_id") % 7, F.col("text")
    text = F.when(i == 0, F.concat(F.lit("日本語"), t)).when(
        i == 1, F.concat(F.repeat(F.lit("日本"), F.floor(F.length(t) / 20).cast("int") + 1), t)
    ).otherwise(t)
    lang = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang"))
    english = lambda c: (c == "") | F.lower(c).startswith("en")
    docs = d.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        (english(lang) & (T.cjk_share(text) <= 0.05)).alias("page_ok"),
        (~text.rlike(T.CJK)).alias("goal_ok"),
    )
    page_lang = F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1)
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("id"), english(page_lang).alias("page_ok"), (~F.col("html").rlike(T.CJK)).alias("goal_ok")
    )
    return docs.unionByName(pages)


_SKIP = """CASE WHEN html='' THEN 'unparseable_html' WHEN NOT starts_with(lower(regexp_extract(html,'<html[^>]* lang="([^"]*)"',1)),'en') THEN 'not_english'
  WHEN gold IS NULL THEN CASE WHEN page_id%10=0 THEN 'no_positive' ELSE 'positive_not_in_html' END WHEN n_neg<7 THEN 'too_few_candidates' END"""
_SKIPS = dict(
    **_G, neg=_NEG, uniq=_UNIQ,
    sk=f"SELECT page_id, {_SKIP} AS skip_reason FROM pages LEFT JOIN gold USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n_neg FROM uniq GROUP BY page_id) USING (page_id)",
)


def _skips(spark, folder):
    nodes, pos = V.flat_nodes(spark, folder), _positives(spark, folder)
    gold = gold_of(pos, nodes)
    unique = C.unique_labels(near_nodes(spark, folder), ["page_id"]).filter("not is_gold")
    n_neg = unique.groupBy("page_id").agg(F.count("*").alias("n_neg"))
    p = table(spark, folder, "pages").join(pos, "page_id").join(gold, "page_id", "left").join(n_neg, "page_id", "left")
    lang = F.lower(F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1))
    reason = first_failure(
        [
            (F.col("html") == "", "unparseable_html"),
            (~lang.startswith("en"), "not_english"),
            (F.size("cands") == 0, "no_positive"),
            (F.col("gold").isNull(), "positive_not_in_html"),
            (F.coalesce("n_neg", F.lit(0)) < C.K_MIN - 1, "too_few_candidates"),
        ]
    )
    return p.select("page_id", reason.alias("skip_reason"))


@query("skip_reason", O.sql("nodes", "SELECT page_id, CASE WHEN skip_reason IS NULL AND page_id NOT IN (SELECT page_id FROM uniq GROUP BY page_id HAVING count(*)>=7) THEN 'too_few_candidates' ELSE skip_reason END AS skip_reason FROM sk", **_SKIPS))
def skip_reason(spark, folder):
    return _skips(spark, folder)


@query(
    "skip_counts",
    O.sql("nodes", "SELECT coalesce(CASE WHEN skip_reason IS NULL AND page_id NOT IN (SELECT page_id FROM uniq GROUP BY page_id HAVING count(*)>=7) THEN 'too_few_candidates' ELSE skip_reason END,'(converted)') AS skip_reason, count(*) AS n FROM sk GROUP BY 1", **_SKIPS),
)
def skip_counts(spark, folder):
    s = _skips(spark, folder).groupBy(F.coalesce("skip_reason", F.lit("(converted)")).alias("skip_reason")).agg(F.count("*").alias("n"))
    return s.orderBy(F.desc("n"), "skip_reason")


# ---- the whole tree


def _nodes(spark, folder):
    return P.page_nodes(table(spark, folder, "pages"))


@query(
    "page_nodes_flat",
    r"""SELECT page_id, count(*) FILTER (WHERE t='a') AS n_a, count(*) FILTER (WHERE t='p') AS n_p, count(*) FILTER (WHERE t='li') AS n_li,
    count(*) FILTER (WHERE t='h1') AS n_h1 FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html,'(?s)<script.*?</script>|<style.*?</style>','','g'),'<(a|p|li|h1)(?:\s[^>]*)?>',1)) AS t FROM pages) GROUP BY page_id""",
)
def page_nodes_flat(spark, folder):
    n = _nodes(spark, folder).filter(F.col("tag").isin("a", "p", "li", "h1"))
    return n.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("a", "p", "li", "h1")])


@query("page_nodes_known", O.sql("nodes", "SELECT page_id, pre, last, parent, tag, label, 'c'||(pre%3)||' k'||(pre%4) AS class FROM nodes"))
def page_nodes_known(spark, folder):
    """What the parser makes of pages whose tree SQL can state."""
    return V.flat_nodes(spark, folder).select("page_id", "pre", "last", "parent", "tag", "label", F.try_element_at("attrs", F.lit("class")).alias("class"))


@query(
    "field_value_known",
    O.sql(
        "nodes",
        f"""SELECT page_id, pre, CASE WHEN tag='a' THEN 'link' ELSE tag END AS role, coalesce(nullif({O.clip('said')},''),'f'||pre) AS label, false AS hidden FROM (
        SELECT n.page_id, n.pre, n.tag, string_agg(i.raw,' ' ORDER BY i.pre) AS said FROM nodes n JOIN nodes i ON i.page_id=n.page_id AND i.pre BETWEEN n.pre AND n.last GROUP BY n.page_id, n.pre, n.tag)""",
    ),
)
def field_value_known(spark, folder):
    """Roles and labels of the elements of those pages: an element reads as all the text inside it."""
    nodes = P.page_nodes(V.built_pages(spark, folder).select("page_id", "html"), text_chars=1000)
    return P.describe(nodes).select("page_id", F.col("pre").cast("long").alias("pre"), "role", "label", "hidden")


@query("page_nodes")
def page_nodes(spark, folder):
    n = _nodes(spark, folder)
    return n.select("page_id", "pre", "last", "parent", "depth", "tag", F.to_json("attrs").alias("attrs"), "text")


@query("field_value")
def field_value(spark, folder):
    return P.describe(_nodes(spark, folder)).select("page_id", "pre", "tag", "role", "label", "value", F.to_json("operations").alias("operations"), "hidden")


@query(
    "select_options",
    r"""SELECT page_id, item, count(*) AS n FROM (SELECT page_id, trim(unnest(regexp_extract_all(html,'<li><a [^>]*>([^<]*)</a></li>',1))) AS item FROM pages) WHERE item<>'' GROUP BY ALL""",
)
def select_options(spark, folder):
    """List items read as the options of their list."""
    n = _nodes(spark, folder)
    as_select = F.when(F.col("tag") == "ul", "select").when(F.col("tag") == "li", "option").otherwise(F.col("tag"))
    o = P.select_options(n.withColumn("tag", as_select))
    return o.select("page_id", F.explode("options").alias("o")).groupBy("page_id", F.col("o.label").alias("item")).agg(F.count("*").alias("n"))


def trees(spark, folder):
    """Accessibility trees over conversations: one link or text line per turn, some nested."""
    c = table(spark, folder, "conversations")
    n = F.col("turn")
    text = F.replace(T.norm_ws("text"), F.lit("'"), F.lit("’"))
    line = F.concat(
        F.repeat(F.lit("\t"), (n % 3 + 1).cast("int")),
        F.when(n % 3 == 2, "").otherwise(F.concat(F.lit("["), n + 10, F.lit("] "))),
        F.when(n % 3 == 0, "button").when(n % 3 == 1, "link").otherwise("StaticText"),
        F.lit(" '"),
        F.when(n % 3 == 0, "").otherwise(text),
        F.lit("', clickable, visible"),
    )
    per = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    root = F.concat(F.lit("RootWebArea 'Chat "), F.col("conv_id"), F.lit("', focused, url='http://chat/"), F.col("conv_id"), F.lit("'\n"))
    return per.select(F.col("conv_id").alias("tree_id"), F.concat(root, F.col("body")).alias("tree"))


_TREE = f"""SELECT conv_id AS tree_id, (turn+1)::BIGINT AS pre, CASE WHEN turn%3=2 THEN NULL ELSE (turn+10)::VARCHAR END AS id,
  CASE turn%3 WHEN 0 THEN 'button' WHEN 1 THEN 'link' ELSE 'StaticText' END AS role, CASE WHEN turn%3=0 THEN '' ELSE replace({O.norm('text')},'''','’') END AS name,
  CASE turn%3 WHEN 0 THEN NULL ELSE turn END::BIGINT AS parent FROM conversations"""


@query(
    "ax_tree_nodes",
    O.sql(
        "",
        """SELECT t.tree_id, t.pre, t.id, t.role, t.name, CASE WHEN EXISTS (SELECT 1 FROM t u WHERE u.tree_id=t.tree_id AND u.pre=t.parent) THEN t.parent END AS parent
        FROM t WHERE pre<=(SELECT coalesce(min(x.pre), 1000000) FROM t x WHERE x.tree_id=t.tree_id AND NOT EXISTS (SELECT 1 FROM t y WHERE y.tree_id=x.tree_id AND (y.pre=x.pre-1)) AND x.pre>1)""",
        t=_TREE,
    ),
)
def ax_tree_nodes(spark, folder):
    n = P.ax_tree_nodes(trees(spark, folder)).filter("role <> 'RootWebArea'")
    return n.select("tree_id", F.col("pre").cast("long").alias("pre"), "id", "role", "name", F.col("parent").cast("long").alias("parent"))


@query("ax_tree_labels")
def ax_tree_labels(spark, folder):
    return P.ax_tree_nodes(trees(spark, folder)).select("tree_id", "pre", "last", "role", "label")
