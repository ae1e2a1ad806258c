"""Selectors against a plain search over a tree."""

import re

import pytest

from stepline.operators import pages as P
from stepline.operators import selectors as S

PAGE = """<main id="m"><section class="card wide"><h2 class="name">A</h2><ul class="x"><li class="x y" id="one">1</li><li class="y">2</li></ul></section>
<section class="card"><ul><li><em class="y">3</em></li></ul><aside class="x"><b class="name é">n</b></aside></section></main><section class="card">end</section>"""

ASKED = [
    "main", "#m", ".card", "section.card.wide", "li", "li.y", "#one", "li#one.x", ".wide li", "main > section > ul", "main em.y", "ul .y", "section section", ".x > .y", ".x .y",
    "main  >  section.card   li", "*", "main *", "main > *", "> li", "li >", "", "a[href]", "li:first-child", "li, em", ".é", "#1x", "ul > em", "main section ul li em", ".x.x",
    "section:nth-child(2) > aside >b:nth-child(1)", "li:nth-child(2)", "section:nth-of-type(1)", "aside:nth-of-type(1)", "aside:nth-child(1)", ":nth-child(1)", "li:nth-child(0)", "li:nth-child(2n)",
]


def plain(nodes, selector):
    text = re.sub(r"\s*>\s*", " > ", selector).strip()
    words = text.split()
    if not words or words[0] == ">" or words[-1] == ">" or not all(w == ">" or re.fullmatch(r"(\*|[^\W\d][\w-]*)?([#.][^\W\d][\w-]*|:nth-(child|of-type)\(\d+\))*", w) for w in words):
        return set()
    found, child = None, False
    for w in words:
        if w == ">":
            child = True
            continue
        parts = re.findall(r":[\w-]+\(\d+\)|[#.]?[\w-]+|\*", w)

        def fits(n, parts=parts):
            mine = {n.tag, "*", "#" + n.attrs.get("id", "")} | {"." + c for c in n.attrs.get("class", "").split()}
            ahead = [m for m in nodes if m.parent == n.parent and m.pre <= n.pre]
            mine |= {f":nth-child({len(ahead)})", f":nth-of-type({sum(m.tag == n.tag for m in ahead)})"}
            return all(x in mine for x in parts)

        hits = {n.pre for n in nodes if fits(n)}
        if found is not None:
            up = {n.pre: n for n in nodes}
            hits = {h for h in hits if (up[h].parent in found if child else any(up[f].pre < h <= up[f].last for f in found))}
        found, child = hits, False
    return found


@pytest.fixture(scope="module")
def nodes(spark):
    return P.page_nodes(spark.createDataFrame([(1, PAGE), (2, PAGE.replace("card", "tile")), (3, "")], "page_id long, html string")).persist()


def test_selectors_mean_what_a_plain_search_finds(spark, nodes):
    wanted = spark.createDataFrame([(p, s) for p in (1, 2, 3) for s in ASKED] + [(1, None), (9, "li"), (1, "li")], "page_id long, selector string")
    rows = nodes.collect()
    want = {(p, s, x) for p in (1, 2, 3) for s in ASKED for x in plain([r for r in rows if r.page_id == p], s)}
    assert {tuple(r) for r in S.matches(nodes, wanted).collect()} == want
    assert len({s for _, s, _ in want}) > 18
    one = {(p, s) for p, s, _ in want if sum(w[:2] == (p, s) for w in want) == 1}
    assert {(r.page_id, r.selector) for r in S.resolve_unique(nodes, wanted).collect()} == one
    assert S.resolve_unique(nodes, wanted.limit(0)).count() == 0
