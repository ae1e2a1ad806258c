"""Very long texts: nothing is read in part."""

import random

import numpy as np
from llm_data import docs, sentence
from test_llm_duplicates import plain_fingerprint

from stepline.llm import decontam, langid, lines, simhash, toxicity


def long_text(seed: int, words: int = 150_000) -> str:
    rng = random.Random(seed)
    known = [sentence(rng, 1) for _ in range(4000)]
    return " ".join(rng.choices(known, k=words))


def test_a_passage_at_the_end_of_a_long_text_is_found(spark):
    item = sentence(random.Random(3), 40)
    tests = spark.createDataFrame([(7, item)], "item_id long, text string")
    text = long_text(1)
    got = decontam.contaminated(docs(spark, [(1, f"{text} {item}"), (2, text)]), tests).collect()
    assert [(r.id, r.item, r.equal_tokens) for r in got] == [(1, 7, 40)]


def test_fingerprint_of_a_long_text_is_whole(spark):
    text = long_text(2)
    got = {r.id: r.fp & (2**64 - 1) for r in simhash.near_duplicates(docs(spark, [(1, text), (2, text + " end")])).collect()}
    assert got == {1: plain_fingerprint(text), 2: plain_fingerprint(text + " end")}


def test_classifiers_read_long_texts_to_the_end(spark):
    rows = [(i, f"nice calm quiet words {i} " * 6) for i in range(60)] + [(100 + i, f"vile hateful scum filth {i} " * 6) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    calm, end = "nice calm quiet words " * 40_000, "vile hateful scum filth " * 60_000
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, [(1, calm), (2, calm + end)]).select("doc_id", "text"), model).collect()}
    assert got[1] < 0.3 <= got[2] and all(np.isfinite(list(got.values())))
    told = langid.fit(docs(spark, [(i, "the one and the other of it " * 5, "en") for i in range(8)] + [(20 + i, "der eine und das andere ist " * 5, "de") for i in range(8)]))
    mixed = "the one and the other of it " * 3_000 + "der eine und das andere ist " * 60_000
    assert [r.language.lang for r in langid.identify(docs(spark, [(1, mixed)]).select("doc_id", "text"), told).collect()] == ["de"]


def test_long_lines_are_compared_whole(spark):
    a, b = long_text(4), long_text(5)
    near = a.replace(" ", "  ", 50)
    rows = [(1, a), (2, "short line of some words\n" + near), (3, b), (4, a[: len(a) // 2] + b[len(b) // 2 :]), (5, b)]
    left = {r.doc_id: (r.text, r.n_lines_removed) for r in lines.dedup_lines(docs(spark, rows).select("doc_id", "text")).collect()}
    assert left[1] == (a, 0) and left[2] == ("short line of some words", 1) and left[3] == (b, 0)
    assert left[4][1] == 0 and left[5] == ("", 1)
