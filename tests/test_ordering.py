import numpy as np
import pytest
from pyspark.sql import functions as F

from stepline.functions.hashing import fraction_split, hex_mod, keyed, uniform
from stepline.operators import ordering as Ord
from stepline.operators.history import _parse_first, history_before


@pytest.fixture()
def skewed(spark):
    """A third of all rows in one group, values with many repeats."""
    n = 30_000
    g = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50))
    return spark.range(n).select("id", g.alias("g"), ((F.col("id") * 7919) % 1013).cast("double").alias("v"))


def test_hash_position_is_a_permutation_in_hash_order(spark, skewed):
    got = Ord.hash_position(skewed.select("id"), keyed(1, "id"), "id").withColumn("h", keyed(1, "id")).toPandas()
    assert sorted(got["position"]) == list(range(1, len(got) + 1))
    by_hash = got.sort_values(["h", "id"])["position"].tolist()
    assert by_hash == list(range(1, len(got) + 1))


def test_line_position_with_clustered_values(spark):
    ids = spark.range(2000).select(F.when(F.col("id") < 1990, F.col("id")).otherwise(F.col("id") * 10**9).alias("id"))
    got = Ord.line_position(ids, "id").orderBy("id").toPandas()
    assert got["position"].tolist() == list(range(1, 2001))


def test_running_sums(spark, skewed):
    got = Ord.running_sums(skewed.select("id", "v"), "id", {"total": F.col("v")}).orderBy("id").toPandas()
    assert np.allclose(got["total"], np.cumsum(got["v"]))


def test_first_per_group_keeps_exactly_the_first_rows_of_a_hot_group(spark, skewed):
    got = Ord.first_per_group(skewed, ["g"], [F.col("v"), F.col("id")], 7).toPandas()
    want = skewed.toPandas().sort_values(["v", "id"]).groupby("g").head(7)
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("accuracy", [100, 100_000])
def test_order_statistics_are_exact(skewed, monkeypatch, accuracy):
    # a small accuracy forces the bracket path
    monkeypatch.setattr(Ord, "ACCURACY", accuracy)
    picks = {"p50": (0.5, "linear"), "p95": (0.95, "linear"), "low": (0.9, "lower"), "up": (0.5, "upper"), "max": (1.0, "lower")}
    got = {r["g"]: r for r in Ord.order_statistics(skewed, ["g"], "v", picks).collect()}
    for g, rows in skewed.toPandas().groupby("g"):
        v = np.sort(rows["v"].to_numpy())
        n = len(v)
        assert got[g]["n"] == n
        assert got[g]["p50"] == pytest.approx(np.percentile(v, 50))
        assert got[g]["p95"] == pytest.approx(np.percentile(v, 95))
        assert got[g]["low"] == v[int(0.9 * (n - 1))]
        assert got[g]["up"] == v[n // 2]
        assert got[g]["max"] == v[-1]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_preceding_rows_across_chunks(spark, chunk):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(0, 60, 1 + k)], "k long, i long")
    got = Ord.preceding_rows(df, ["k"], "i", F.col("i"), 4, "prev", chunk).collect()
    for r in got:
        before = [x for x in range(0, r["i"], 1 + r["k"])]
        assert r["prev"] == before[-4:]


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_history_counts_parsable_entries_only(spark, chunk):
    rows = [(k, i, None if (i * 7 + k) % 3 == 0 or 10 <= i <= 22 else f"e{i}") for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, i long, e string")
    got = _parse_first(df, ["k"], "i", "e", 5, chunk).collect()
    for r in got:
        want = [e for k, i, e in rows if k == r["k"] and i < r["i"] and e is not None][-5:]
        assert r["parse_first"] == want
    both = {(r["k"], r["i"]): r for r in history_before(df, ["k"], "i", "e", 5).collect()}
    for k, i, _ in rows:
        raw = [x[2] for x in rows if x[0] == k and x[1] < i][-5:]
        assert both[k, i]["raw_first"] == [x for x in raw if x is not None]


def test_hashes_match_plain_python(spark):
    import hashlib

    df = spark.range(200).select("id", keyed(5, "id").alias("h"))
    df = df.select("id", "h", hex_mod(F.col("h"), 1000).alias("m"), uniform(5, "id").alias("u"), fraction_split(F.col("h"), 0.1, 0.2).alias("s"))
    for r in df.collect():
        digest = int(hashlib.sha256(f"5:{r['id']}".encode()).hexdigest(), 16)
        share = digest / 16**64
        assert r["m"] == digest % 1000
        assert r["u"] == pytest.approx(share, abs=1e-15)
        assert r["s"] == ("test" if share < 0.1 else "dev" if share < 0.1 + 0.2 else "train")


def test_order_statistics_of_every_size_and_beyond_the_sketch(spark, monkeypatch):
    """Groups of one to sixty rows, with ties, and one of many more rows than the sketch resolves."""
    import random

    from pyspark.sql import functions as F

    from stepline.operators import ordering

    rng = random.Random(6)
    groups = {f"g{n}": [rng.choice([1.0, 2.0, 2.5, float(rng.randint(0, 50))]) for _ in range(n)] for n in [*range(1, 61), 997]}
    groups["flat"] = [7.0] * 40
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("g5", None)], "g string, x double")
    picks = {"a": (0.0, "linear"), "b": (0.5, "linear"), "c": (0.95, "linear"), "d": (1.0, "linear"), "e": (0.9, "lower"), "f": (0.3, "upper"), "h": (0.25, "linear")}

    def plain(xs, q, rule):
        xs = sorted(xs)
        if rule == "upper":
            return xs[int(len(xs) * q)]
        at = q * (len(xs) - 1)
        lo = int(at)
        return xs[lo] if rule == "lower" or at == lo else xs[lo] * (1 - (at - lo)) + xs[lo + 1] * (at - lo)

    for accuracy in (ordering.ACCURACY, 50):  # the second leaves the sketch of the larger groups inexact
        monkeypatch.setattr(ordering, "ACCURACY", accuracy)
        for r in ordering.order_statistics(df, ["g"], "x", picks).collect():
            for name, (q, rule) in picks.items():
                assert abs(r[name] - plain(groups[r["g"]], q, rule)) < 1e-9, (r["g"], name, accuracy)
            assert r["n"] == len(groups[r["g"]])
    wide = spark.range(30_000).select(((F.col("id") * 7919) % 30_011).cast("double").alias("x"))
    assert ordering.order_statistics(wide, [], "x", {"p": (0.5, "lower")}).first()["p"] == sorted((i * 7919) % 30_011 for i in range(30_000))[14_999]
