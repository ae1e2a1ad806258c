"""Components, SimHash, line and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from llm_data import classes, docs, sentence
from pyspark.sql import functions as F

from stepline.llm import lines, simhash, substrings
from stepline.llm.components import connected_components
from stepline.llm.scratch import Scratch


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = classes({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(df.limit(0), "a", "b", Scratch(spark, "t")).count() == 0


def plain_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows(n=260, seed=4):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(60, 150)) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, base[0]), (5, "one"), (6, "ONE"), (7, "É é Ü x y")]
    for k in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = "new"
        rows.append((10 + k, " ".join(words)))
    return rows + rows[-3:]


def test_simhash_classes_match_all_pairs(spark):
    rows = near_rows()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert Counter((r.id, r.fp & (2**64 - 1)) for r in got) == Counter(prints)
    fps = sorted({p for _, p in prints})
    root = classes(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k:] if bin(a ^ b).count("1") <= 4])
    ids = {}
    for i, p in prints:
        if i is not None:
            ids[root[p]] = min(i, ids.get(root[p], i))
    assert Counter((r.id, r.component) for r in got) == Counter((i, ids.get(root[p])) for i, p in prints)
    assert len(set(root.values())) < len(fps)
    kept = simhash.keep_one_of_each(docs(spark, rows))
    assert kept.count() == len(set(root.values())) and kept.columns == docs(spark, rows).columns
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_vantage_point_tree_finds_every_near_quarter():
    rng = np.random.default_rng(1)
    tree = simhash.Tree(rng.integers(0, 65_536, 3000).astype(np.uint16), 20)
    assert tree.leaves > 50
    reach = [{int(tree.homes[v]), *tree.visits[tree.ends[v] : tree.ends[v + 1]].tolist()} for v in range(65_536)]
    for v in rng.integers(0, 65_536, 3000).tolist():
        for b in range(16):
            w = v ^ (1 << b)
            assert int(tree.homes[v]) in reach[w] or int(tree.homes[w]) in reach[v]


def test_shard_links_span_all_pairs_also_in_chunks():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(rng.integers(0, 60))) ^ np.uint64(1 << int(rng.integers(0, 60))) for _ in range(20)]]))
    home = rng.random(len(fp)) < 0.7
    chunk = np.zeros(len(fp), np.int64)
    a, b = simhash.shard_links(fp, home, chunk)
    assert len(a) < len(fp)
    near = [(int(x), int(y)) for i, x in enumerate(fp) for j, y in enumerate(fp[:i]) if (home[i] or home[j]) and bin(int(x) ^ int(y)).count("1") <= 4]
    assert classes(fp.tolist(), zip(a.tolist(), b.tolist(), strict=True)) == classes(fp.tolist(), near)


def line_shingles(x):
    return {x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))}


def fuzzy_rows(seed=6):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(8, 40)) for _ in range(40)]
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "short\nshort\nshorter\nä"), (5, "ä")]
    for k in range(80):
        chosen = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(base) if rng.random() < 0.5 else sentence(rng, 15)
            chosen.append(x + rng.choice(["", "", ".", " end", "!!!"]))
        rows.append((10 + k, "\n".join(chosen)))
    return rows + [rows[-1], (10, "another text of id ten"), (None, base[3])]


def test_line_dedup_matches_exact_jaccard(spark):
    rows = fuzzy_rows()
    d = docs(spark, rows)
    out = lines.dedup_lines(d.withColumn("n_lines_removed", F.lit("clash"))).collect()
    place = sorted({(i is not None, i or 0, xxhash.xxh64((t or "").encode(), seed=42).intdigest() - 0, t, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()}, key=lambda p: (p[0], p[1], (p[2] ^ (1 << 63)), p[4]))
    texts = sorted({p[5] for p in place})
    sets = {x: line_shingles(x) for x in texts}
    links = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    part, seen, gone = classes(texts, links), set(), set()
    for has, i, _, t, k, x in place:
        if part[x] in seen:
            gone.add((i if has else None, t, k))
        seen.add(part[x])
    want = Counter()
    for i, t in rows:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)
        want[(i, left, 0 if t is None else sum((i, t, k) in gone for k in range(len(t.split("\n")))))] += 1
    assert len(links) > 20
    assert Counter((r.doc_id, r.text, r.n_lines_removed) for r in out) == want
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_bands_find_nearly_all_similar_lines(spark):
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 400:
        x = sentence(rng, 40)
        words = x.split()
        words[rng.randrange(40)] = "other"
        words[rng.randrange(40)] = "thing"
        a, b = line_shingles(x), line_shingles(" ".join(words))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((x, " ".join(words)))
    df = spark.createDataFrame(pairs, "x string, y string")
    both = lines.with_bands(lines.with_bands(df, "x", "p"), "y", "q")
    share = both.select(F.avg(F.exists(F.zip_with("p", "q", lambda a, b: a == b), lambda t: t).cast("int"))).first()[0]
    assert share >= 0.97


def family_lines(n, seed=12):
    """Lines of one template whose tails are drawn so that some pairs, but few hubs, are similar."""
    rng = random.Random(seed)
    head = sentence(rng, 18)
    tails = [sentence(rng, 5) for _ in range(n // 3)]
    made = set()
    while len(made) < n:
        words = rng.choice(tails).split()
        words[rng.randrange(5)] = sentence(rng, 1)
        made.add(head + " " + " ".join(words))
    return sorted(made)


def test_lines_of_one_template_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 7)  # shingles of many lines are joined in pieces
    texts = family_lines(600)
    ids = {np.uint64(xxhash.xxh64(x.encode(), seed=42).intdigest()).astype(np.int64).item(): x for x in texts}
    sets = {h: line_shingles(x) for h, x in ids.items()}
    order = sorted(sets)
    links = [(a, b) for k, a in enumerate(order) for b in order[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    _, found = lines.line_classes(docs(spark, list(enumerate(texts))), Scratch(spark, "t"))
    got = {r.node: r.component for r in found.collect()}
    want = classes({x for e in links for x in e}, links)
    assert len(links) > 100 and len(set(want.values())) > 50
    unlinked = [e for e in links if e[0] not in got or e[1] not in got or got[e[0]] != got[e[1]]]
    assert len(unlinked) <= 0.005 * len(links), (len(unlinked), len(links))
    assert all(want.get(n) == want.get(c) for n, c in got.items())


def test_hubs_of_large_bands_are_compared_only_where_masks_allow_it(spark, monkeypatch):
    rng = random.Random(15)
    head = sentence(rng, 24)
    texts = sorted({head + " " + sentence(rng, 12) for _ in range(150)})
    ids = {np.uint64(xxhash.xxh64(x.encode(), seed=42).intdigest()).astype(np.int64).item(): line_shingles(x) for x in texts}
    kept = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.setdefault(name, keep(self, df, name)))
    lines.line_classes(docs(spark, list(enumerate(texts))), Scratch(spark, "t"))
    opened = kept["open"].where(F.col("many") > lines.SMALL).select("line").distinct().count()
    large = {r.line for r in kept["open"].where(F.col("many") > lines.SMALL).collect()}
    small = {tuple(r) for r in lines.small_pairs(kept["open"]).collect()}
    met = {(r.a, r.b) for r in kept["compared_open"].collect()} - small
    assert opened > 100 and met <= {(a, b) for a in large for b in large}
    # a mask of 1,024 bits leaves no pair far below SIMILARITY
    assert all(len(ids[a] & ids[b]) > 0.65 * len(ids[a] | ids[b]) for a, b in met), len(met)


def removed_by_hand(rows):
    """Per row: the spans of bytes that a LENGTH-byte string starting earlier covers."""
    first = {}
    data = [((-1 if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(b), [tuple(e) for e in edge.reshape(-1, 2).tolist()], hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def copied_rows(seed=9):
    rng = random.Random(seed)
    parts = [sentence(rng, rng.randint(10, 60)) + " é" for _ in range(20)]
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "y" * 350), (5, "y" * 120 + "z" * 200)]
    for k in range(70):
        rows.append((10 + k, rng.choice(["", "Ä"]) + sentence(rng, rng.randint(0, 20)).join(rng.choice(parts)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 5)))))
    return rows + [rows[-1], (10, sentence(rng, 60) + parts[2] * 2), (None, parts[1] * 3)]


def check_copies(spark, rows):
    got = substrings.remove_copies(docs(spark, rows)).collect()
    have = Counter((r.id, r.n_bytes, tuple((s["from"], s["to"]) for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert have == Counter((i, n, tuple(s), h) for (i, _), (n, s, h) in zip(rows, removed_by_hand(rows), strict=True))


def test_copied_bytes_match_brute_force(spark):
    check_copies(spark, copied_rows())
    assert substrings.remove_copies(docs(spark, []).limit(0)).count() == 0


def test_copied_bytes_of_hot_minimizers_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    check_copies(spark, copied_rows(11))
    rows = copied_rows(12)
    monkeypatch.setattr(substrings, "BUCKET", 5)
    check_copies(spark, rows)


def test_contexts_file_equal_windows_together():
    pieces = [(t or "").encode() for _, t in copied_rows(13)]
    piece, start, count, left, gram, _ = (c.tolist() for c in substrings.contexts(pieces))
    assert sum(count) == sum(max(0, len(p) - 99) for p in pieces)
    filed = {}
    for p, s, c, d, g in zip(piece, start, count, left, gram, strict=True):
        for k in range(c):
            filed.setdefault(pieces[p][s + k : s + k + 100], set()).add((g, d - k))
    assert all(len(v) == 1 for v in filed.values())


def test_difference_cover_is_one():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_pairs_to_be_met_are_all_similar_ones_and_few_others(spark):
    rng = random.Random(12)
    sets = [{rng.getrandbits(63) for _ in range(n)} for n in (0, 1, 40)]
    base = [rng.getrandbits(63) for _ in range(200)]
    for _ in range(150):
        share = rng.choice([0.7, 0.95])
        sets.append({x if rng.random() < share else rng.choice([rng.getrandbits(63), ~x]) for x in base})
    rows = [(k, k % 140, list(x)) for k, x in enumerate(sets)]
    ranks = lines.ranked(spark.createDataFrame(rows, "line long, part long, x array<long>"))
    got = {(r.a, r.b) for r in lines.candidates(ranks).collect()}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(3, 153) for b in range(a + 1, 153)}
    assert {p for p, j in alike.items() if j >= 0.8 and p[0] % 140 != p[1] % 140} <= got
    assert all(p[0] % 140 != p[1] % 140 for p in got)
    # masks leave out what shares rare shingles only
    assert all(alike[p] > 0.6 for p in got)


def test_stars_need_no_round(spark, monkeypatch):
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 9), (9, 2)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t"), "c").collect()}
    assert got == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2} and kept == ["c0"]
