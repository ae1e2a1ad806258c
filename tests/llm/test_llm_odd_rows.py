"""Column names that clash, ids that repeat, texts without letters."""

import hashlib

import pytest
from llm_data import docs
from pyspark.sql import functions as F

from stepline.llm import decontam, langid, lines, mixing, quality, simhash, substrings

TAKEN = ["n", "h", "at", "id", "of", "words", "own_hash", "OWN_HASH2", "gone_id", "gone_hash", "places", "cut", "ring", "mean", "parts", "kept_id", "kept_hash", "bad_id", "bad_hash", "line", "bands", "text_hash", "band", "__gone", "__n", "__h", "__words"]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(40)) + "\nthe same long line stands in every one of them\n") for i in range(12)] + [(20, None), (21, ""), (None, "no id here " * 9)]
    return docs(spark, rows).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in TAKEN})


def same_extras(before, after):
    a = {tuple(r) for r in before.select("doc_id", *TAKEN).collect()}
    b = {tuple(r) for r in after.select("doc_id", *TAKEN).collect()}
    return b <= a and len(b) > 0


def test_columns_of_the_user_stay(spark, crowded):
    tests = spark.createDataFrame([(1, " ".join(f"word3x{k}" for k in range(20)))], "item_id long, text string")
    for out in (quality.keep_good(crowded), simhash.keep_one_of_each(crowded), decontam.keep_clean(crowded, tests)):
        assert out.columns == crowded.columns and same_extras(crowded, out)
    assert decontam.keep_clean(crowded, tests).count() == crowded.count() - 1
    mixed = mixing.mix(crowded)
    assert mixed.columns == [*crowded.columns, "copy"] and same_extras(crowded, mixed)
    figures = quality.base_figures(crowded)
    assert set(crowded.columns) <= set(figures.columns) and same_extras(crowded, figures)
    left = lines.dedup_lines(crowded)
    assert left.columns == [*crowded.columns, "n_lines_removed"] and same_extras(crowded, left)
    assert left.agg(F.sum("n_lines_removed")).first()[0] == 11


def test_marks_find_the_text_of_their_id(spark):
    """Three hundred texts of one id: some would share any short tag."""
    common = "c" * 150
    rows = [(7, f"{hashlib.sha256(str(i).encode()).hexdigest() * 4}") for i in range(300)] + [(7, common), (9, common), (7, "short")]
    out = substrings.remove_copies(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert [(r.id, len(r.kept)) for r in out if r.id == 9] == [(9, 0)]
    assert all(len(r.kept) == r.n_bytes - sum(s["to"] - s["from"] for s in r.spans) for r in out)
    # a digest of 64 bytes four times over repeats itself from byte 64 on, and nothing else goes
    assert {(r.n_bytes, len(r.kept)) for r in out if r.n_bytes == 256} == {(256, 64)}
    with pytest.raises(TypeError):
        substrings.remove_copies(docs(spark, rows).withColumn("doc_id", F.lit("x")))


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, "the one and the other of it " * 5, "en") for i in range(8)] + [(20 + i, "der eine und das andere ist " * 5, "de") for i in range(8)]
    model = langid.fit(docs(spark, rows))
    odd = docs(spark, [(1, "½ ²"), (2, "Ⅷ 12 ③"), (3, None), (4, ""), (5, "_ 7"), (6, "the one"), (7, "2 der")])
    got = {r.doc_id: r.language.lang for r in langid.identify(odd.select("doc_id", "text"), model).collect()}
    assert {k: v for k, v in got.items() if k < 6} == dict.fromkeys(range(1, 6), "und") and got[6] == "en" and got[7] == "de"
