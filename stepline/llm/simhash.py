"""SimHash near duplicates: vantage-point trees over fingerprints.

A pair of 64-bit fingerprints that differ in at most four bits differs in at most one bit of one
of its four 16-bit quarters. Each quarter has its own vantage-point tree: a node splits the
quarters by their Hamming distance from a vantage point, and since the search radius is one
bit, the triangle bounds leave most branches out (they could leave out hardly any with radius
four over all bits). A leaf is a shard. A fingerprint lives in one shard of each tree and
visits those shards whose region its ball overlaps; whole fingerprints are compared there, so
the pairs are exact. A shard returns a spanning forest of its links, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.components import connected_components
from stepline.llm.scratch import Scratch, free_names, some_rows

SHINGLE_WORDS = 4
RADIUS = 4
QUARTERS, QUARTER_RADIUS = 4, 1  # radius times quarters must reach RADIUS; the ball of radius one is spelled out in Tree
SAMPLE = 65_536  # fingerprints that shape the trees; every fingerprint is indexed
LEAF = 16  # fingerprints of the sample in a leaf; visits per fingerprint do not grow with the table
CHUNK = 32_768  # members of a shard that are compared at once; larger shards are split
UNIT = 50_000  # members of the shards that one call looks at, about
BLOCK = 65_536  # shingles whose bits are counted at once


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hashes = [xxhash.xxh64_intdigest(whole[s:e], 42) for s, e in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.array(hashes[i : i + BLOCK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], names=["id", "text_hash", "fp"])


class Tree:
    """A vantage-point tree over the 65,536 values of a quarter, shaped by a sample."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 7):
        radius = QUARTER_RADIUS
        rng = np.random.default_rng(seed)
        values = np.arange(65_536, dtype=np.uint16)
        self.homes = np.zeros(65_536, np.int64)
        visits: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(sample, values, values)]
        self.leaves = 0
        while todo:
            have, home, near = todo.pop()
            point, split = None, None
            if len(have) > leaf and len(home) > 1:
                point = rng.choice(have)
                split = np.median(np.bitwise_count(have ^ point))
                split = min(split, int(np.bitwise_count(home ^ point).max()) - 1)
            if point is None or split < 0:
                self.homes[home] = self.leaves
                visits.append((near, np.full(len(near), self.leaves)))
                self.leaves += 1
                continue
            d_have, d_home, d_near = (np.bitwise_count(x ^ point).astype(np.int64) for x in (have, home, near))
            todo.append((have[d_have <= split], home[d_home <= split], near[d_near - radius <= split]))
            todo.append((have[d_have > split], home[d_home > split], near[d_near + radius > split]))
        value, shard = (np.concatenate(x) for x in zip(*visits, strict=True))
        lower = shard < self.homes[value]  # of two shards that overlap, the higher one's members visit the lower
        value, shard = value[lower].astype(np.int64), shard[lower]
        ball = (values[:, None].astype(np.int64) ^ (1 << np.arange(16))[None, :]).ravel()
        lower = np.isin(value * self.leaves + shard, np.repeat(values.astype(np.int64), 16) * self.leaves + self.homes[ball])  # bounds are not sharp: the ball must reach in
        order = np.argsort(value[lower], kind="stable")
        self.visits = shard[lower][order]
        self.ends = np.searchsorted(value[lower][order], np.arange(65_537))


def _forest(left: np.ndarray, right: np.ndarray, label: np.ndarray) -> None:
    """Joins the classes of left[i] and right[i] in place; a label is the smallest index of its class."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def shard_links(fp: np.ndarray, home: np.ndarray, chunk: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between members of a shard, at least one end at home.

    Members are ordered by their distance from a vantage point; the triangle bound leaves a
    window of them for each block. Where two chunks of a large shard meet, only pairs across are compared.
    """
    both = len(np.unique(chunk)) > 1
    away = np.bitwise_count(fp ^ fp[0]).astype(np.int64)
    order = np.argsort(away, kind="stable")
    fp, home, chunk, away = fp[order], home[order], chunk[order], away[order]
    label = np.arange(len(fp))
    at = np.flatnonzero(home)
    for i in range(0, len(at), 256):
        rows = at[i : i + 256]
        lo = np.searchsorted(away, away[rows[0]] - radius, "left")
        hi = np.searchsorted(away, away[rows[-1]] + radius, "right")
        for k in range(lo, hi, 4096):
            cols = np.arange(k, min(hi, k + 4096))
            close = np.bitwise_count(fp[rows][:, None] ^ fp[cols][None, :]) <= radius
            if both:
                close &= chunk[rows][:, None] != chunk[cols][None, :]
            x, y = np.nonzero(close)
            _forest(rows[x], cols[y], label)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[linked]], fp[linked]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp, root, component) for every row: its SimHash, its class and the smallest id in it.

    Fingerprints of at most RADIUS differing bits are linked; root is the smallest fingerprint of a class. A null or blank text has
    fingerprint zero and is linked like any other; repeated rows share a fingerprint; null ids
    are returned, and a class without any id has a null component. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    prints = scratch.keep(source.mapInArrow(_fingerprints, f"id {kind}, text_hash long, fp long"), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    links = scratch.keep(_links(distinct.select("fp"), scratch), "links")
    parts = connected_components(links, "a", "b", scratch)
    of = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = of.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(of.join(roots, "root").select("fp", "root", "component"), "fp").select("id", "text_hash", "fp", "root", "component")


def _links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    sample = np.array([r.fp for r in some_rows(distinct, SAMPLE, "fp").collect()], np.int64).view(np.uint16).reshape(-1, QUARTERS)
    trees = [Tree(sample[:, q], LEAF) for q in range(QUARTERS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            parts = fp.view(np.uint16).reshape(-1, QUARTERS)
            for q, tree in enumerate(trees):
                value = parts[:, q].astype(np.int64)
                first, last = tree.ends[value], tree.ends[value + 1]
                row = np.repeat(np.arange(len(fp)), last - first)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
                shard = np.concatenate([tree.homes[value], tree.visits[first[row] + inner]]).astype(np.int32)
                home = np.concatenate([np.ones(len(fp), bool), np.zeros(len(row), bool)])
                who = np.concatenate([fp, fp[row]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), q, np.int32)), pa.array(shard), pa.array(home), pa.array(who)], names=["tree", "shard", "home", "fp"])

    placed = scratch.keep(distinct.mapInArrow(place, "tree int, shard int, home boolean, fp long"), "placed")
    sizes = placed.groupBy("tree", "shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cut = placed.join(sizes, ["tree", "shard"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    each = cut.select("tree", "shard", "home", "fp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    keyed = each.select("home", "fp", "chunk", F.xxhash64("tree", "shard", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("part"))
    units = keyed.withColumn("unit", F.pmod("part", F.lit(-(-placed.count() // UNIT) + 1)))

    def compare(table: pa.Table) -> pa.Table:
        part, fp, home, chunk = (table.column(c).to_numpy() for c in ("part", "fp", "home", "chunk"))
        order = np.argsort(part, kind="stable")
        part, fp, home, chunk = part[order], fp.view(np.uint64)[order], home[order], chunk[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        found = [shard_links(fp[i:j], home[i:j], chunk[i:j]) for i, j in zip([0, *cuts], [*cuts, len(part)], strict=True) if j - i > 1]
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]) for k in (0, 1))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return units.groupBy("unit").applyInArrow(compare, "a long, b long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest id (null last) stays."""
    rows = near_duplicates(docs, id_col, text_col)
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("k"))
    own, kept_id, kept_hash = free_names(docs.columns, "own_hash", "kept_id", "kept_hash")
    keep = least.select(F.col("k.id").alias(kept_id), F.col("k.text_hash").alias(kept_hash))
    marked = docs.withColumn(own, F.xxhash64(text_col))
    stay = marked.join(keep, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash)), "left_semi")
    return stay.dropDuplicates([id_col, own]).drop(own)
