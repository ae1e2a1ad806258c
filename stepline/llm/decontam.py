"""Benchmark decontamination by spaced seeds.

A mask looks at some of SPAN neighbouring tokens and ignores the others, so a hash under a mask
survives substitutions at the ignored places. All windows of the test items are hashed under
each mask; training texts are hashed likewise, a fixed-size Bloom filter of the test hashes
lets the few plausible windows through with their surroundings, and a join finds the items.
Around each hit, the aligned tokens are scored; a stretch that agrees in most tokens counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.scratch import Scratch, free_names

# The places a mask looks at, '1', among the tokens of a window.
MASKS = ("11101001101", "11011010011", "10111100101", "11110110100")
SPAN = len(MASKS[0])
MIN_OVERLAP = 13  # tokens of a stretch that counts; a shorter item counts when the stretch covers MIN_AGREE of it
AGREE = (4, 1)  # at least this many equal tokens of a stretch for so many differing ones
MIN_AGREE = AGREE[0] / sum(AGREE)  # of the tokens of a stretch
BLOOM_BITS, BLOOM_PROBES = 1 << 24, 3
CACHE = 500_000  # distinct tokens whose hashes a worker remembers at once

TOKEN = re.compile(r"[^\W_]+")


class Hasher:
    """64-bit hashes of the lower-cased words of a text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        words = TOKEN.findall((text or "").lower())
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def least(n: int) -> int:
    """Tokens that a stretch needs to count for an item of n tokens."""
    return min(MIN_OVERLAP, -(-n * AGREE[0] // (AGREE[0] + AGREE[1])))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n tokens.

    A stretch that counts for a short item may not hold a window of SPAN tokens. With e
    differing tokens among its own it has a run of a share of 1 / (e + 1) of the equal ones at
    least; the shortest of these runs is the mask, so that no stretch is missed.
    """
    if least(n) >= SPAN:
        return MASKS
    runs = []
    for length in range(least(n), n + 1):
        differ = length * AGREE[1] // (AGREE[0] + AGREE[1])
        runs.append(-(-(length - differ) // (differ + 1)))
    return ("1" * min(runs),) if n else ()


def seeds(tokens: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask, the hash of every window of its length; the mask is part of the hash."""
    out = []
    for mask in masks:
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.full(n, int(mask, 2), np.uint64)
        for at, bit in enumerate(mask):
            if bit == "1":
                h = h * np.uint64(0x100000001B3) + tokens[at : at + n]
        out.append(_mix(h))
    return out


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(20 * k)) & np.uint64(bits - 1) for k in range(BLOOM_PROBES)]


def _tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        for item, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            tokens = hasher(text)
            yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], b.schema.field(0).type), pa.array([tokens.view(np.int64)], pa.list_(pa.int64()))], names=["item", "tokens"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, tokens in zip(b.column(0), b.column(1), strict=True):
            tokens = np.array(tokens.as_py(), np.int64).view(np.uint64)
            found = seeds(tokens, masks_of(len(tokens)))
            for h in found:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([item.as_py()] * len(h), b.schema.field(0).type), pa.array(np.arange(len(h), dtype=np.int32))], names=["hash", "item", "item_at"])


def _bloom(windows: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter, put together bit by bit in Spark; bits / 64 rows at most reach the driver."""
    places = []
    for k in range(BLOOM_PROBES):
        places.append(F.shiftrightunsigned("hash", 20 * k).bitwiseAND(F.lit(bits - 1)))
    each = windows.select(F.explode(F.array(*places)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("on"))
    filled = np.zeros(bits // 64, np.int64)
    for r in each.groupBy("word").agg(F.bit_or("on").alias("on")).collect():
        filled[r.word] = r.on
    return filled.view(np.uint64)


def _suspects(batches: Iterator[pa.RecordBatch], filter_of, bits: int, around: int, masks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Stretches of texts around the windows that the filter lets through."""
    hasher, table = Hasher(), filter_of.value
    for b in batches:
        rows: list[tuple] = []
        for i, text in enumerate(b.column(2).to_pylist()):
            tokens = hasher(text)
            ats, hashes = [], []
            for h in seeds(tokens, masks):
                on = np.arange(len(h))
                for p in _probes(h, bits):
                    p = p[on]
                    on = on[(table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
                ats.append(on)
                hashes.append(h[on])
            at = np.concatenate(ats)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, hashed = at[order], np.concatenate(hashes)[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > around) + 1):
                first, last = max(0, at[part[0]] - around), min(len(tokens), at[part[-1]] + SPAN + around)
                rows.append((i, first, tokens[first:last].view(np.int64), at[part] - first, hashed[part].view(np.int64)))
        who = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0).take(who),
                b.column(1).take(who),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                pa.array([r[4] for r in rows], pa.list_(pa.int64())),
            ],
            names=["id", "text_hash", "start", "tokens", "ats", "hashes"],
        )


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(from, to, equal tokens) of the stretch of doc with most equal tokens that counts for item, laid at shift; zeros if none does.

    A stretch counts when it is long enough and at least MIN_AGREE of it agrees: the sum of
    AGREE[1] for an equal and -AGREE[0] for a differing token is not negative. The longest
    such stretch from each place is found by the last place where the sum is as high again.
    """
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    if lo >= hi:
        return 0, 0, 0
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    total = np.concatenate([[0], np.cumsum(np.where(same, AGREE[1], -AGREE[0]))])
    equal = np.concatenate([[0], np.cumsum(same)])
    later = np.maximum.accumulate(total[::-1])[::-1]  # falls from left to right
    ends = np.searchsorted(-later, -total, side="right") - 1
    starts = np.arange(len(total))
    long = ends - starts >= least(len(item))
    if not long.any():
        return 0, 0, 0
    best = int(np.where(long, equal[ends] - equal[starts], -1).argmax())
    start, end = best, int(ends[best])
    while end - start > least(len(item)) and not same[end - 1]:
        end -= 1
    while end - start > least(len(item)) and not same[start]:
        start += 1
    return lo + start, lo + end, int(equal[end] - equal[start])


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [overlap(np.asarray(d), np.asarray(t), int(s)) for d, t, s in zip(f["tokens"], f["item_tokens"], f["shift"], strict=True)]
        a = np.array(found, np.int64).reshape(-1, 3)
        out = f[["id", "text_hash", "item"]].assign(from_token=f["start"] + a[:, 0], to_token=f["start"] + a[:, 1], equal_tokens=a[:, 2])
        yield out[a[:, 2] > 0]


def contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", test_col: str = "text", bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(id, text_hash, n_items, item, from_token, to_token, equal_tokens): a row per text that holds a test passage.

    A passage is a stretch of at least MIN_OVERLAP tokens (or MIN_AGREE of a shorter item) of
    which MIN_AGREE agree with an item, token by token; tokens are lower-cased runs of letters
    and digits. The longest passage is given (ties: smallest item), n_items counts items. Null
    and empty texts hold none; items of up to 12 tokens are found wherever they are, longer ones
    where a mask fits between the differing tokens; items without id count as one; repeated rows (equal id and text) give one row. Empty docs or tests
    give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    item_kind = tests.schema[item_col].dataType.simpleString()
    items = scratch.keep(tests.select(F.col(item_col).alias("item"), F.col(test_col).alias("text")).mapInArrow(_tests, f"item {item_kind}, tokens array<long>"), "items")
    windows = scratch.keep(items.mapInArrow(_windows, f"hash long, item {item_kind}, item_at int"), "windows")
    around = items.agg(F.max(F.size("tokens"))).first()[0] or 0
    short = items.where((F.size("tokens") > 0) & (F.size("tokens") <= MIN_OVERLAP)).select(F.size("tokens").alias("n")).distinct().collect()
    masks = tuple(dict.fromkeys([*MASKS, *(m for r in sorted(short) for m in masks_of(r.n))]))
    shared = spark.sparkContext.broadcast(_bloom(windows, bloom_bits))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    look = partial(_suspects, filter_of=shared, bits=bloom_bits, around=int(around), masks=masks)
    suspects = scratch.keep(source.mapInArrow(look, f"id {kind}, text_hash long, start long, tokens array<long>, ats array<long>, hashes array<long>"), "suspects")
    hits = suspects.select("id", "text_hash", "start", F.explode(F.arrays_zip("ats", "hashes")).alias("h")).select("id", "text_hash", "start", F.col("h.ats").alias("at"), F.col("h.hashes").alias("hash"))
    laid = hits.join(windows, "hash").select("id", "text_hash", "start", "item", (F.col("at") - F.col("item_at")).cast("int").alias("shift")).distinct()
    here = suspects.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("start").alias("__start"), "tokens").dropDuplicates(["__id", "__hash", "__start"])
    sided = laid.join(here, laid["id"].eqNullSafe(here["__id"]) & (laid["text_hash"] == here["__hash"]) & (laid["start"] == here["__start"]))
    full = sided.join(items.select(F.col("item").alias("__item"), F.col("tokens").alias("item_tokens")), F.col("item").eqNullSafe(F.col("__item")))
    found = full.select("id", "text_hash", "start", "tokens", "item", "item_tokens", "shift").mapInPandas(_verified, f"id {kind}, text_hash long, item {item_kind}, from_token long, to_token long, equal_tokens long")
    best = F.max(F.struct("equal_tokens", (-F.col("from_token")).alias("early"), "to_token")).alias("best")
    per_item = found.groupBy("id", "text_hash", "item").agg(best)
    rank = F.struct((-F.col("best.equal_tokens")).alias("short"), "item", (-F.col("best.early")).alias("from_token"), F.col("best.to_token").alias("to_token"), F.col("best.equal_tokens").alias("equal_tokens"))
    per_doc = per_item.groupBy("id", "text_hash").agg(F.count("*").alias("n_items"), F.min(rank).alias("r"))
    return per_doc.select("id", "text_hash", "n_items", "r.item", "r.from_token", "r.to_token", "r.equal_tokens")


def keep_clean(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no test passage, columns as they are.

    Null and empty texts hold none and stay; rows equal in id and text stay or go together; no
    test items leave docs as they are, no rows give no rows.
    """
    own, bad_id, bad_hash = free_names(docs.columns, "own_hash", "bad_id", "bad_hash")
    flagged = contaminated(docs, tests, id_col, text_col, **options).select(F.col("id").alias(bad_id), F.col("text_hash").alias(bad_hash))
    marked = docs.withColumn(own, F.xxhash64(text_col))
    return marked.join(flagged, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_hash)), "left_anti").drop(own)
