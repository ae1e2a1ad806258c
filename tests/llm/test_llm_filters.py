"""Quality rules, decontamination, mixing: brute force, odd rows, empty tables."""

import random
import re
from collections import Counter

import pytest
from llm_data import docs, sentence
from pyspark.sql import functions as F

from stepline.llm import decontam, mixing, quality

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = SPACE.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (4, "a a a a a a a a a a a a"),
    (5, "one two three four five\none two three four five\none two three four five"),
    (6, "x y   z é\n\n\né\né"),
    (7, "### ** $$ %% && || << >> ok"),
    (8, "the quick brown fox jumps over the lazy dog and then it sleeps " * 3),
    (8, "the quick brown fox jumps over the lazy dog and then it sleeps " * 3),
    (None, "a text without an id but with enough words to be kept by every rule there is here"),
    (9, "SHOUTING ALL THE TIME IS NOT WHAT PEOPLE DO IN ORDINARY PROSE SO IT GOES"),
    (10, " ".join(f"w{i % 977}" for i in range(30_000))),
]


def test_base_figures_match_brute_force(spark):
    rng = random.Random(3)
    rows = TEXTS + [(100 + i, "\n".join(" ".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(6))) for i in range(60)]
    got = quality.base_figures(docs(spark, rows).withColumn("n_words", F.lit("clash"))).collect()
    want = Counter((i, *figures(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_cascade_verdict_does_not_depend_on_order(spark):
    d = docs(spark, TEXTS)
    kept = [sorted((r.doc_id or 0) for r in d.where(quality.cascade(rules, F.col("text")).isNull()).collect()) for rules in (quality.RULES, quality.RULES[::-1])]
    assert kept[0] == kept[1] == sorted((r.doc_id or 0) for r in quality.keep_good(d).collect()) == [0]
    assert {r.doc_id: r.rejected_by for r in quality.judge(d).collect()}[1] == "few_words"
    assert quality.keep_good(d.limit(0)).count() == 0
    assert {r.name for r in quality.order_rules(d, quality.RULES)} == {r.name for r in quality.RULES}


def test_rules_run_by_rejections_per_cost(spark):
    d = docs(spark, [(i, "word " * 20) for i in range(50)])
    never = quality.Rule("never", lambda t: F.length(t) < 0)
    always = quality.Rule("always", lambda t: F.length(t) > 0)
    assert [r.name for r in quality.order_rules(d, (never, always))] == ["always", "never"]


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, rng.randint(12, 60))) for k in range(30)] + [(90, None), (91, "too short"), (None, sentence(rng, 20))]
    rows = [(1, None), (2, ""), (3, sentence(rng, 200))]
    for k in range(60):
        words = rng.choice(items[:30])[1].split()
        part = words[rng.randint(0, max(0, len(words) - 16)) :] if k % 3 == 0 else words
        part = [w if rng.random() > (0, 0.05, 0.15, 0.4)[k % 4] else "zzz" for w in part]
        rows.append((10 + k, sentence(rng, rng.randint(0, 50)) + ". " + ", ".join(part).upper() + " " + sentence(rng, rng.randint(0, 50))))
    rows.append(rows[5])
    found = decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.id: (r.n_items, r.equal_tokens) for r in found.collect()}
    hasher, want = decontam.Hasher(), {}
    for i, text in rows:
        tokens, best, n = hasher(text), 0, 0
        for _, item in items:
            t = hasher(item)
            top = max((decontam.overlap(tokens, t, s)[2] for s in range(-len(t), len(tokens))), default=0) if len(t) >= decontam.SPAN else 0
            best, n = max(best, top), n + (top > 0)
        if n:
            want[i] = (n, best)
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.05 * len(want), set(want) - set(got)
    assert all(got[i] == want[i] for i in got)
    assert 3 not in got and len(got) > 40


def counts(doc, item):
    """Whether a stretch of doc holds enough of item, by the words of the contract alone."""
    need = min(13, -(-4 * len(item) // 5))
    for shift in range(-len(item) + 1, len(doc)):
        same = [doc[k] == item[k - shift] for k in range(max(0, shift), min(len(doc), shift + len(item)))]
        for a in range(len(same)):
            if any(5 * sum(same[a:b]) >= 4 * (b - a) for b in range(a + need, len(same) + 1)):
                return True
    return False


def test_any_stretch_that_counts_is_found(spark):
    rng = random.Random(11)
    items, rows = [], []
    for k, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12] * 4 + [13, 16, 20, 25, 30] * 12):
        words = [f"i{k}w{x}" for x in range(n)]
        items.append((k, " ".join(words)))
        wrong = set(rng.sample(range(n), n // 5 + (n < 13 and k % 4 == 3)))
        cut = [f"x{x}" if x in wrong else w for x, w in enumerate(words)]
        rows.append((k, " ".join(["left"] * 5 + cut + ["right"] * 5)))
    want = {k for (k, item), (_, text) in zip(items, rows, strict=True) if counts(text.split(), item.split())}
    assert all(bool(decontam.overlap(h(text), h(item), 5)[2]) == (k in want) for h in [decontam.Hasher()] for (k, item), (_, text) in zip(items, rows, strict=True))
    got = {r.id for r in decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    short = set(range(44))
    assert got & short == want & short and len(want & short) > 25
    assert got <= want and len(got - short) >= 0.8 * len(want - short), sorted(want - got)


def test_decontamination_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, [(1, "a b c"), (None, None)])
    assert decontam.contaminated(d, none).count() == 0
    assert decontam.keep_clean(d, none).count() == 2
    some = spark.createDataFrame([(1, sentence(random.Random(1), 30))], "item_id long, text string")
    twice = docs(spark, [(7, some.first().text), (7, some.first().text), (7, "another text"), (None, some.first().text)])
    assert [(r.doc_id, r.text) for r in decontam.keep_clean(twice, some).collect()] == [(7, "another text")]
    assert decontam.keep_clean(twice, some).columns == twice.columns
    assert decontam.contaminated(d.limit(0), some).count() == 0


def test_mixture_reaches_weights_and_is_the_same_everywhere(spark):
    rows = [(i, "abcdefghij" * (1 + i % 3), "en", "big" if i % 3 else None) for i in range(3000)]
    d = docs(spark, rows)
    once, again = mixing.mix(d), mixing.mix(d.repartition(7))
    key = ["doc_id", "copy"]
    assert sorted(map(tuple, once.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    chars = {r.source: r.n for r in once.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert abs(chars["big"] / chars[None] - 1) < 0.1
    assert once.columns == [*d.columns, "copy"]
    heavy = mixing.mix(d.limit(40), {"big": 1.0}, epochs=400.0)
    n = heavy.groupBy("doc_id").count().collect()
    assert {r.source for r in heavy.select("source").distinct().collect()} == {"big"} and min(r["count"] for r in n) > 400


@pytest.mark.parametrize("weights", [None, {"s": 2.0}, {"other": 1.0}])
def test_mixture_of_odd_tables(spark, weights):
    d = docs(spark, [(1, None), (2, ""), (None, "text"), (4, "some text"), (4, "some text")])
    out = mixing.mix(d.withColumn("copy", F.lit("clash")), weights)
    assert out.count() == out.where("copy >= 1").count()
    assert mixing.mix(d.limit(0), weights).count() == 0


def test_poisson_inverts_the_distribution(spark):
    from math import exp

    u = [0.0, 0.1, exp(-1.5) - 1e-9, exp(-1.5) + 1e-9, 0.5, 0.999, 1 - 2**-52]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    got = [r.n for r in df.select(mixing.poisson(F.lit(1.5), F.lit(1), lambda j: F.col("u")).alias("n")).collect()]
    want = []
    for x in u:
        k, p = 0, exp(-1.5)
        c = p
        while x >= c and k < 2 + mixing.SLACK:
            k, p = k + 1, p * 1.5 / (k + 1)
            c += p
        want.append(k)
    assert got == want
