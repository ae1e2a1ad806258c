import math

import pytest
from pyspark.sql import functions as F

from stepline.functions.hashing import keyed
from stepline.operators import dataset as D
from stepline.operators import sampling as S


def test_round_robin_counts(spark):
    rows = [(i, "a" if i < 100 else "b" if i < 105 else "c") for i in range(155)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = S.stratified(df, "g", keyed(0, "id"), "id", 30).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 13, "b": 5, "c": 12}
    assert S.stratified(df, "g", keyed(0, "id"), "id", 500).count() == 155


def test_length_batches_keep_the_budget_and_every_row(spark, monkeypatch):
    monkeypatch.setattr(S, "WINDOW_ROWS", 64)
    df = spark.range(500).select("id", ((F.col("id") * 37) % 91 + 1).alias("n"))
    rows = S.length_batches(df, "id", "n", keyed("b", "id"), 300).toPandas()
    assert sorted(rows["id"]) == list(range(500))
    for _, b in rows.groupby(["window", "batch"]):
        assert b["length"].max() * len(b) <= 300 or len(b) == 1
    for _, w in rows.groupby("window"):  # greedy: the next batch's first row did not fit
        batches = [b["length"] for _, b in w.groupby("batch")]
        for cur, nxt in zip(batches, batches[1:], strict=False):
            assert nxt.min() >= cur.max() and nxt.min() * (len(cur) + 1) > 300


def test_shards_are_disjoint_and_equal(spark):
    df = spark.range(103).select("id", S.shard_of(F.col("id"), F.lit(103), 10, 4).alias("r"))
    counts = {r["r"]: r["count"] for r in df.groupBy("r").count().collect()}
    assert counts == {None: 10 + 93 % 4, 0: 23, 1: 23, 2: 23, 3: 23}


def test_shuffled_pairs_are_all_pairs_once(spark):
    names = list("abcde")
    df = spark.createDataFrame([(n,) for n in names + names], "n string")
    got = {r["position"]: (r["a"], r["b"]) for r in S.shuffled_pairs(df, "n").collect()}
    assert sorted(got) == list(range(1, 21)) and sorted(got.values()) == sorted((a, b) for a in names for b in names if a != b)
    assert {r["position"]: (r["a"], r["b"]) for r in S.shuffled_pairs(df, "n", 7).collect()} == {p: got[p] for p in range(1, 8)}
    assert S.shuffled_pairs(df.limit(0), "n").count() == 0 and S.shuffled_pairs(df.limit(1), "n").count() == 0


def test_permutation_walks_back_below_n(spark):
    for n in (1, 2, 3, 10, 99, 100, 101, 5000):
        got = sorted(r["number"] for r in S.shuffled_numbers(spark, n, n, "t").collect())
        assert got == list(range(n)), n


def test_pairs_of_many_names_are_made_only_as_asked(spark):
    df = spark.range(200_000).select(F.col("id").cast("string").alias("n"))
    pairs = S.shuffled_pairs(df, "n", 1000)  # of 4 * 10**10
    assert pairs.filter("a = b").count() == 0 and pairs.distinct().count() == 1000
    assert pairs.select("a").distinct().count() > 950


def test_round_robin_with_a_hot_group_is_exact(spark):
    rows = [(i, None if i % 50 == 7 else f"g{i % 20}" if i % 10 == 0 else "hot") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string")
    order = {r["id"]: r["h"] for r in df.select("id", keyed(0, "id").alias("h")).collect()}
    for n in (0, 1, 3, 57, 400, 3999, 4000, 9000):
        groups = {}
        for i, g in sorted(rows, key=lambda r: (order[r[0]], r[0])):
            groups.setdefault(g, []).append(i)
        turns = sorted((k, g or "", i) for g, ids in groups.items() for k, i in enumerate(ids))
        want = {i for *_, i in turns[:n]}
        assert {r["id"] for r in S.stratified(df, "g", keyed(0, "id"), "id", n).collect()} == want, n


def test_variants_stop_at_the_first_that_cannot_be_made(spark):
    df = spark.createDataFrame([(1, 3, 2), (2, 3, 9), (3, 1, 1), (4, 0, 1), (5, 2, None)], "id int, times int, bad int")
    rows = S.repeat_until(df, F.col("times"), lambda v: v == F.col("bad"), "v").select("id", "v", "skipped").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False), (2, 3, False), (3, 1, True), (5, 1, False), (5, 2, False)]


def test_recast_rows(spark):
    rows = [
        ("choice", ["b", "a", "c"], [0.2, 0.7, 0.1], "s", "q?"),
        ("noul", ["true", "false"], [0.3, 0.7], "s", "q?"),
        ("score", ["0", "1", "2"], [0.1, 0.2, 0.7], "s", "q?"),
        ("choice", ["a", "a"], [0.5, 0.5], "s", "q"),
        ("noul", ["maybe", "sure"], [0.5, 0.5], "s", "q"),
        ("noul", ["Yes", "NO"], [0.5, 0.5], "s", "q"),
        ("choice", ["a", "b"], [1.0], "s", "q"),
        ("score", ["1"], [1.0], "s", "q"),
        ("choice", ["a", "b"], [0.5, 0.5], "", "q"),
    ]
    df = spark.createDataFrame(rows, "kind string, options array<string>, target array<double>, state string, question string")
    got = [(r["kind"], r["label"], r["soft"]) for r in D.recast_single(df).collect()]
    assert got == [("choice", "a", [0.2, 0.7, 0.1]), ("noul", "false", [0.7, 0.3]), ("score", "2", [0.1, 0.2, 0.7]), ("noul", "true", [0.5, 0.5])]


def test_null_tasks_and_empty_goals_count_as_seen(spark):
    rows = [
        ("1", "t", "train", None, "Buy milk."), ("2", "t", "dev", None, "new"), ("3", "t", "dev", "x", " BUY  milk"),
        ("4", "t", "dev", "x", "other"), ("5", "u", "dev", "x", "other"),
    ]
    df = spark.createDataFrame(rows, "id string, config string, split string, task_id string, goal string")
    got = {r["id"]: r["split"] for r in D.leak_checked_splits(df, ["t"]).collect()}
    assert got == {"1": "train", "2": "validation", "3": "validation", "4": "test", "5": "validation"}


def test_unsafe_goals(spark):
    goals = {"buy it": True, "books about cats": False, "book a room": True, "postal code": False, "post it": True, "sign in now": True, "read news": False, "rebuy": False}
    df = spark.createDataFrame([(g,) for g in goals], "g string")
    assert {r[0]: r[1] for r in df.select("g", D.unsafe_goal(F.col("g"))).collect()} == goals


def test_content_digest_ignores_order_and_files(spark):
    from stepline.sources.steps import content_digest

    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id")
    a = {r["g"]: r["digest"] for r in content_digest(df, ["g"], ["id"]).collect()}
    b = {r["g"]: r["digest"] for r in content_digest(df.orderBy(F.desc("id")).repartition(7), ["g"], ["id"]).collect()}
    c = {r["g"]: r["digest"] for r in content_digest(df.filter("id <> 4"), ["g"], ["id"]).collect()}
    assert a == b and a[0] != c[0] and a[1] == c[1]


def test_episode_fates_and_prefixes(spark):
    from stepline.operators import episodes as E

    log = [
        (1, 1, "CLICK", "r"), (1, 2, "DONE", "r"), (1, 3, "CLICK", "r"), (2, 4, "BLOCKED", "loop"), (2, 5, "BLOCKED", "CAPTCHA wall"), (2, 6, "CLICK", "r"),
        (3, 7, "CLICK", "r"), (3, 8, "CLICK", "r"), (3, 9, "SELECT", "r"), (4, 10, "DONE", "r"), (5, 11, "CLICK", "r"), (6, 12, "CLICK", "r"),
    ]
    d = spark.createDataFrame([(s, i, i, o, f"{o}", w) for s, i, o, w in log], "session long, step_id long, ts long, operation string, request string, reason string")
    eps = [(1, "done", ""), (2, "blocked", ""), (3, "error", "StalePage: x"), (4, "done", ""), (5, "budget", "")]
    e = spark.createDataFrame([(s, f"t{s}", "src", o, x) for s, o, x in eps], "session long, task string, source string, outcome string, error string")
    v = spark.createDataFrame([(1, True), (4, False)], "session long, judged_done boolean")
    fate = E.fates(E.session_marks(d), e, v)
    assert {r["session"]: r["fate"] for r in fate.collect()} == {
        1: "done_kept", 2: "site_blocked_kept", 3: "infra_error_prefix_kept", 4: "done_rejected_by_judge", 5: "budget_dropped", 6: "no_outcome",
    }
    kept = E.training_rows(d, fate)
    # 5 repeats the state of 4, 8 that of 7
    assert sorted(r["step_id"] for r in kept.collect()) == [1, 2, 4, 7]


def test_uneven_hash_cut(spark):
    df = spark.range(1003)
    got = S.cut_fraction(df, keyed(0, "id"), "id", 0.8).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": math.floor(0.8 * 1003), "dev": 1003 - math.floor(0.8 * 1003)}


def test_intermediate_tables_are_gone_when_the_job_is_over(spark):
    from pathlib import Path

    from stepline.session import clear_scratch, materialize, scratch_root

    materialize(spark.range(10), "left-over")
    clear_scratch(spark)
    assert not [p for p in Path(scratch_root(spark)).iterdir() if p.name.startswith("left-over")]
