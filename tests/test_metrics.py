import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepline.functions import prob
from stepline.operators import metrics as M


def test_calibration_of_a_calibrated_set_is_zero(spark):
    rows = [(0.25, i < 1) for i in range(4)] + [(0.75, i < 3) for i in range(4)]
    df = spark.createDataFrame(rows, "c double, h boolean")
    for bins in (prob.bin_floor("c"), prob.bin_edges("c")):
        assert M.calibration(df, "c", "h", bins).first()["ece"] == 0


def test_the_two_bin_rules_differ_where_a_tenth_is_not_exact(spark):
    cs = [0.3, 0.6, 0.7, 0.1, 0.2, 0.5, 1.0, 0.0]
    df = spark.createDataFrame([(c,) for c in cs], "c double").select("c", prob.bin_floor("c").alias("f"), prob.bin_edges("c").alias("e"))
    got = {r["c"]: (r["f"], r["e"]) for r in df.collect()}
    edges = np.linspace(0, 1, 11)
    for c in cs:
        inside = [j for j in range(10) if c >= edges[j] and (c < edges[j + 1] or (j == 9 and c <= 1))]
        assert got[c] == (min(int(c * 10), 9), inside[0])
    assert {c for c in cs if got[c][0] != got[c][1]} == {0.3, 0.6, 0.7}


@pytest.mark.parametrize(("gained", "lost"), [(0, 0), (5, 5), (8, 2), (1, 12), (40, 31)])
def test_mcnemar(spark, gained, lost):
    n, k = gained + lost, min(gained, lost)
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    df = spark.createDataFrame([(gained, lost)], "g long, l long")
    assert df.select(M.mcnemar_exact(F.col("g"), F.col("l"))).first()[0] == pytest.approx(want)


def test_fitted_temperature_is_the_minimum(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        z = rng.normal(size=4) * 3
        p = np.exp(z / 1.7) / np.exp(z / 1.7).sum()
        rows.append((z.tolist(), int(rng.choice(4, p=p))))
    df = spark.createDataFrame(rows, "z array<double>, gold int").persist()
    got = M.fit_temperature(df, "z", "gold")
    ts = np.arange(0.3, 5.0, 0.0005)
    z, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def nll(t):
        s = z / t
        return np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y])

    assert got == pytest.approx(ts[np.argmin([nll(t) for t in ts])], abs=1e-3)


def test_threshold_counts_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(float(p), bool(g)) for p, g in zip(rng.random(500).round(2), rng.random(500) < 0.3, strict=True)]
    df = spark.createDataFrame(rows, "p double, d boolean")
    ts = [i / 100 for i in range(1, 100)]
    got = {r["threshold"]: r for r in M.threshold_counts(df, "p", "d", ts).collect()}
    done, other = [p for p, d in rows if d], [p for p, d in rows if not d]
    for t in ts:
        assert got[t]["done_recall"] == pytest.approx(sum(p >= t for p in done) / len(done), abs=1e-6)
        assert got[t]["premature_rate"] == pytest.approx(sum(p >= t for p in other) / len(other), abs=1e-6)


def test_answers_that_can_not_be_read(spark):
    rows = [
        (["A", "B"], "A", "A", {"A": 0.9, "B": 0.1}),
        (["A", "B"], "A", "C", {"A": 0.9}),
        (["A", "B"], "A", "A", {"A": 0.5}),
        (["A", "B"], "A", "B", {"B": 0.99, "C": 0.01}),
        (["A", "B"], "A", None, None),
        (["A", "B"], "A", "A", None),
        (["A", "B"], "A", "B", {"B": 0.99}),
    ]
    df = spark.createDataFrame(rows, "options array<string>, gold string, choice string, probabilities map<string,double>")
    a = F.array(F.struct(F.lit("q").alias("qid"), "options", "gold", "choice", "probabilities"))
    got = [tuple(r[0][0][f] for f in ("choice", "confidence", "valid", "distribution", "correct")) for r in df.select(M.read_answers(a)).collect()]
    assert got == [
        ("A", 0.9, True, True, True),
        (None, 0.0, False, False, False),
        ("A", 1.0, True, False, True),
        ("B", 1.0, True, False, False),
        (None, 0.0, False, False, False),
        ("A", 1.0, True, False, True),
        ("B", 0.99, True, True, False),
    ]


@pytest.mark.parametrize("k", [2, 8, 60, 200, 255])
def test_choice_answers_sum_to_one_after_rounding(spark, k):
    from stepline.operators.prompts import answer

    rng = np.random.default_rng(k)
    w = rng.random(k) ** 3
    df = spark.createDataFrame([([str(i + 1) for i in range(k)], (w / w.sum()).tolist())], "keys array<string>, p array<double>")
    a = df.select(answer(F.lit("choice"), F.col("keys"), F.col("p")).alias("a")).first()["a"]
    assert set(a["probabilities"]) == {str(i + 1) for i in range(k)}
    assert abs(sum(a["probabilities"].values()) - 1) < 0.02
    assert a["probabilities"][a["choice"]] >= max(a["probabilities"].values()) - 1e-6
    assert 0 <= a["confidence"] <= 1


def test_running_share_counts_rows_whatever_their_numbers(spark):
    rows = [(i, int(i % 3 == 0)) for i in range(1000) if i % 7 != 3]
    df = spark.createDataFrame(rows, "step_id long, ok long")
    got = {r["seen"]: r["share"] for r in M.running_share(df, "step_id", "ok", 200).collect()}
    assert got == {n: sum(ok for _, ok in rows[:n]) / n for n in range(200, len(rows) + 1, 200)}
