"""Top-k search, source audit and prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_data import sentence
from pyspark.sql import functions as F

from stepline.llm import divergence, maxscore, prefix_trie, rollup
from stepline.llm.scratch import Scratch

VECTORS = "vec_id long, embedding array<double>, shard string, mark int, rank string, copies int"


def vector_rows(n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(12)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one common vector
    rows += [(i, [0.5 if k == i % 12 else 0.0 for k in range(12)]) for i in range(2000, 2030)]
    rows += [(3000, None), (3001, [0.1, None]), (3002, [0.1, float("nan")]), (3003, [float("inf")]), (None, [0.3] * 12)]
    rows += [(3100, []), (3101, [0.7]), (3200, [0.2] * 20), (-500, [-0.4] * 12), rows[7], rows[7], rows[20], rows[0]]
    return rows + [(20, [0.9] * 12)]  # a second vector under one id


def plain_top(rows, queries, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for name, q in {(i, tuple(v)) for i, v in whole if queries(i)}:
        scored = sorted((max(-(2**63) + 1, min(2**63, -sum(a * b for a, b in zip(q, v, strict=False)))), i) for i, v in whole if i != name)
        out += [(name, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return Counter(out)


def test_top_k_matches_all_products(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "s", 1, "r", 2) for r in rows], VECTORS)
    asked = df.where("vec_id % 20 = 0")
    want = plain_top(rows, lambda i: i % 20 == 0)
    for shard, block in ((maxscore.SHARD, maxscore.BLOCK), (100, 7)):
        got = maxscore.top_k(df, asked, 10, shard=shard, block=block)
        assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert maxscore.top_k(df.limit(0), asked, 10).count() == 0
    assert maxscore.top_k(df, asked.limit(0), 10).count() == 0
    two = spark.createDataFrame([(0, [1.0], "", 0, "", 0), (1, [-2.0], "", 0, "", 0)], VECTORS)
    assert [tuple(r) for r in maxscore.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, -2097152)]


def test_top_k_of_huge_components_is_exact(spark):
    rng = random.Random(1)
    for power in (6, 8):  # beyond exact doubles, and beyond longs
        rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, power) for _ in range(5)]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = maxscore.top_k(df, df.where("vec_id % 20 = 0"), 10, shard=20)
        whole = plain_top(rows, lambda i: i % 20 == 0)
        assert max(abs(s) for *_, s in whole) > 2**53
        assert Counter(tuple(r) for r in got.collect()) == whole
    far = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, -5e307]), (2, [-1e300, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in maxscore.top_k(far, far.where("vec_id = 0")).collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_non_essential_lists_are_probed_only_for_rows_that_compete():
    rng = np.random.default_rng(3)
    parts = np.floor(rng.normal(0, 100, (3000, 16)) * np.geomspace(8, 0.05, 16))
    shard = maxscore.Shard(np.arange(3000), np.ones(3000, dtype=np.int64), parts)
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple):
                read.append(len(key[0]) if hasattr(key[0], "__len__") else 0)
            return np.asarray(self)[key]

    q = np.floor(rng.normal(0, 100, 16))
    plain = parts @ q
    shard.lists = shard.lists.view(Seen)
    ids, scores, _ = shard.best(-1, q, 10, None)
    assert scores.tolist() == sorted(plain.tolist(), reverse=True)[:10]
    assert set(ids.tolist()) == set(np.argsort(-plain, kind="stable")[:10].tolist())
    assert sum(read) < 0.8 * 16 * (3000 - maxscore.OPENING)


def plain_audit(rows, min_docs, top):
    found = defaultdict(Counter)
    total, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        lang, source = lang or "", source or ""
        found[lang, source].update(terms)
        total[lang].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    kept = {lang: [t for t, n in in_docs[lang].items() if n >= min_docs] for lang in {g[0] for g in found}}

    def shares(counts, lang):
        n, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 1000000000 * (counts[t] + 2) // (n + 2 * v) for t in kept[lang]}

    p = {g: shares(c, g[0]) for g, c in found.items()}
    for g in found:
        pairs = [(-sum((a - p[o][t]) ** 2 // (a + p[o][t]) for t, a in p[g].items()), o[1].encode()) for o in found if o[0] == g[0] and o != g]
        out += [(*g, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(sorted(pairs))]
        q = shares(total[g[0]], g[0])
        terms = [(-((a - q[t]) ** 2 // (a + q[t])), t.encode()) for t, a in p[g].items() if found[g][t] and a > q[t]]
        out += [(*g, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(sorted(terms)[:top])]
    return Counter(out)


def test_audit_matches_plain_counts(spark, monkeypatch):
    rng = random.Random(9)
    words = [sentence(rng, 1) for _ in range(60)] + ["Été", "ÉTÉ", "été", "I", "ß", "don't", "x1y", "\U0001f600", "日本"]
    rows = [(" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))), rng.choice(["a", "b", None]), f"s{int(rng.random() ** 3 * 40)}") for _ in range(300)]
    rows += [(None, "a", "s0"), ("", "a", "void"), ("12 34 --", "c", "x"), (None, "c", "y"), ("alone", "d", "z"), ("q " * 5000, "a", None), ("w" * 30_000, "a", "s1")] + [rows[0]] * 30
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "text string, lang string, source string, rank int, item string, term string")
    cols = ["lang", "source", "part", "item", "value", "rank"]
    for min_docs, top in ((3, 10), (1, 4)):
        got = divergence.audit(df, min_docs=min_docs, top=top).select(cols).collect()
        assert Counter(tuple(r) for r in got) == plain_audit(rows, min_docs, top)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 40)
    monkeypatch.setattr(divergence, "HELD", 50)
    assert Counter(tuple(r) for r in divergence.audit(df, min_docs=2).select(cols).collect()) == plain_audit(rows, 2, 10)
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_of_a_long_text_are_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Ab cdefghijklmnop  é1é\nQ" * 9
    assert [t for piece in divergence.terms_of(text.encode()) for t in piece] == [t.lower().encode() for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]


def test_counts_beyond_a_long_product_are_exact(spark):
    n, total = 10**13, 3 * 10**13
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(7)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert got.p == 1 + 10**9 * (n + 2) // (total + 14) and got.z is None


def plain_trie(rows, base, take):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in held.items()}
    seqs = {c: tuple(own.get(base(c), [])[: take(c)]) + tuple(v[take(c) :]) for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(n))
        out.append((m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talk(n=300, seed=11):
    rng = random.Random(seed)
    lines = [sentence(rng, 4) for _ in range(5)] + ["", None]
    rows = []
    for c in range(n):
        turns = [(k if rng.random() < 0.9 else rng.choice([None, 0, 1]), rng.choice(["user", "assistant", None]), rng.choice(lines)) for k in range(rng.randint(1, 7))]
        rows += [(c + 60, *t) for t in turns]
    rows += [(None, 1, "user", "nobody"), (-7, 0, "user", "a"), (-7, 0, "user", "a"), (-207, 0, "user", "b"), (10_000, None, None, None)]
    rows += [(5000 + k, 0, "user", "same") for k in range(40)] + [(5000 + k, 1, "assistant", "too") for k in range(0, 40, 2)]
    return rows + [(5100 + k, t, "u", f"deep {t // (k + 1)}") for k in range(6) for t in range(300)]


def sign_rest(c):
    return int(math.fmod(c, 100))


def test_trie_matches_plain_prefixes(spark, monkeypatch):
    rows = talk()
    schema = "conv_id long, turn long, role string, text string, depth int, place int, k1 int, size int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)
    conv = F.col("conv")
    lent = dict(base=conv - conv % 100, take=F.crc32(conv.cast("string").cast("binary")) % 6, most=5)
    want = plain_trie(rows, lambda c: c - sign_rest(c), lambda c: zlib.crc32(str(c).encode()) % 6)
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(df, **lent).collect()) == want
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(rollup, "CHUNK", 3)
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(df, **lent).collect()) == want
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(df).collect()) == plain_trie(rows, lambda c: c, lambda c: 0)
    assert prefix_trie.prefix_trie(df.limit(0), **lent).count() == 0


def test_components_halve(spark):
    """Levels stay below the logarithm of the weight for a deep chain and a caterpillar."""
    chain = [(0, d, 600 - d, 0) for d in range(600)]
    legs = [(c, d, 600 - d, 0) for c in range(1, 40) for d in range(c * 3)] + [(c, c * 3, 1, c) for c in range(1, 40)]
    paths = spark.createDataFrame(chain + legs, "chain long, depth long, weight long, owner long")
    placed, levels = rollup.split(paths, Scratch(spark, "t"))
    assert placed.count() == 600 + 39 and levels <= math.log2(600) + 1
    worst = placed.groupBy("top_chain", "top_depth").agg(F.countDistinct("chain").alias("n")).agg(F.max("n")).first()[0]
    assert worst == 1


def test_ends_are_digested_across_batches():
    rows = [(1, 0, c) for c in range(50)] + [(1, 1, 99), (2, 0, 5), (2, 0, 7)]
    table = pa.table({"chain": [r[0] for r in rows], "depth": [r[1] for r in rows], "conv": [r[2] for r in rows]})
    got = pa.Table.from_batches(prefix_trie.digest_ends(iter(table.to_batches(max_chunksize=7)))).to_pylist()
    want = {(1, 0): ",".join(map(str, range(50))), (1, 1): "99", (2, 0): "5,7"}
    assert {(r["chain"], r["depth"]): r["ends_sha256"] for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
