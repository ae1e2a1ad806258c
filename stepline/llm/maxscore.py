"""Exact top-k search by integer inner product with MaxScore.

The terms of a query are its dimensions; a shard holds, for each dimension, the column of its
vectors' components (the posting list) with the largest and smallest of them, which bound what
the dimension can add to a score. Dimensions are ordered by that bound. The last ones, whose
bounds together stay below the k-th best score so far, are non-essential: a vector that gains
nothing from an essential dimension cannot win. So only essential lists are traversed, and the
others are probed, one group after another, for vectors that can still compete. Shards meet
blocks of queries; the shards' best are merged. What the first shard finds bounds the others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.scratch import Scratch

SCALE = 1024
SHARD, BLOCK = 4096, 1024  # vectors of a shard, queries of a block: what one task holds at once
OPENING = 512  # vectors of a shard that are scored in full to get a first threshold
PROBES = 4  # non-essential dimensions probed at once
LONG = 2**63

FOUND = "query_id long, query_mark long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows with an id and a vector of finite components."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & finite)


def whole_parts(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, a row per vector, zeros beyond a vector's end; Python integers where a double is not exact."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if not np.isfinite(scaled).all():
        scaled = np.array([SCALE * int(x) if abs(x) > 2.0**60 else math.floor(SCALE * x) for x in flat.tolist()], dtype=object)
    out = np.zeros((len(sizes), width), dtype=scaled.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    out[rows, np.arange(len(flat)) - np.repeat(starts, sizes)] = scaled
    return out


def _as_integers(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)


def _within_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores
    return np.array([min(max(s, -LONG), LONG - 1) for s in scores.tolist()], dtype=object)


class Shard:
    """The posting lists of some vectors, with their bounds."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, parts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.copies = ids[order], copies[order]
        self.lists = np.asfortranarray(parts[order])
        self.high, self.low = self.lists.max(axis=0), self.lists.min(axis=0)

    def best(self, query_id: int, q: np.ndarray, k: int, threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, scores, copies) that hold the k best rows of the shard that reach the threshold (None: no threshold)."""
        others = np.flatnonzero(self.ids != query_id)
        opening, rest = others[:OPENING], others[OPENING:]
        rows, scores = self._leading(opening, _within_long(self.lists[opening] @ q), k)
        if len(rest):
            # a score that stopped at the lower end bounds nothing
            if self.copies[rows].sum() >= k and scores[-1] > -LONG:
                threshold = scores[-1] if threshold is None else max(threshold, scores[-1])
            more = self._compete(rest, q, threshold)
            rows, scores = self._leading(np.concatenate([rows, more[0]]), np.concatenate([scores, _within_long(more[1])]), k)
        if threshold is not None:
            reach = scores >= threshold
            rows, scores = rows[reach], scores[reach]
        return self.ids[rows], scores, self.copies[rows]

    def _leading(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The fewest rows, highest score first and then smallest id, whose copies make up k."""
        # a stable sort keeps equal scores in the order of ids, which is that of rows
        by_id = np.argsort(rows, kind="stable")
        rows, scores = rows[by_id], scores[by_id]
        order = np.argsort(-scores, kind="stable")
        before = np.cumsum(self.copies[rows[order]]) - self.copies[rows[order]]
        order = order[before < k]
        return rows[order], scores[order]

    def _compete(self, rows: np.ndarray, q: np.ndarray, threshold) -> tuple[np.ndarray, np.ndarray]:
        """Rows that reach the threshold, and their scores."""
        bound = np.maximum(q * self.high, q * self.low)
        terms = np.argsort(-bound, kind="stable")
        # what the terms from each place on can add at most
        ahead = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], np.zeros(1, dtype=bound.dtype)])
        below = np.flatnonzero(ahead < threshold) if threshold is not None else np.empty(0, dtype=int)
        essential = int(below[0]) if len(below) else len(terms)
        scores = np.zeros(len(rows), dtype=self.lists.dtype)
        # a row without a gain in an essential list has a sum of zero or less and falls to the first test
        for t in terms[:essential]:
            if q[t]:
                scores += self.lists[rows, t] * q[t]
        for at in range(essential, len(terms), PROBES):
            alive = scores + ahead[at] >= threshold
            rows, scores = rows[alive], scores[alive]
            if not len(rows):
                break
            for t in terms[at : at + PROBES]:
                scores += self.lists[rows, t] * q[t]
        return rows, scores


def best_of_unit(k: int, queries: pa.Table, vectors: pa.Table) -> pa.Table:
    """The k best of one shard for every query of one block."""
    found: list[list] = [[], [], [], []]
    if queries.num_rows and vectors.num_rows:
        longest = [int(np.max(np.asarray(t["vec"].combine_chunks().value_lengths()), initial=0)) for t in (queries, vectors)]
        width = max(longest)
        asked, parts = whole_parts(queries["vec"], width), whole_parts(vectors["vec"], width)
        # sums of doubles are exact up to 2**53
        most = [float(np.abs(m).max()) if m.size and m.dtype != object else (math.inf if m.size else 0.0) for m in (asked, parts)]
        if not most[0] * most[1] * max(width, 1) < 2**53:
            asked, parts = _as_integers(asked), _as_integers(parts)
        shard = Shard(vectors["id"].to_numpy(), vectors["copies"].to_numpy(), parts)
        # a score that stopped at the lower end may have been lower still
        limits = [None if x == -LONG else x for x in queries["threshold"].to_pylist()]
        for i, (name, mark) in enumerate(zip(queries["id"].to_pylist(), queries["mark"].to_pylist(), strict=True)):
            ids, scores, copies = shard.best(name, asked[i], k, limits[i])
            times = np.minimum(copies, k)
            found[0] += [name] * int(times.sum())
            found[1] += [mark] * int(times.sum())
            found[2] += np.repeat(ids, times).tolist()
            found[3] += np.repeat(scores.astype(np.int64), times).tolist()
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "query_mark", "vec_id", "score"), found, strict=True)})


def _units(queries: DataFrame, vectors: DataFrame, shards: tuple[int, int], blocks: int, k: int) -> DataFrame:
    """The best of every (shard, block); the shards are those from the first to before the second number."""
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id", "mark"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(shards[0]), F.lit(shards[1] - 1))))
    held = vectors.where(F.col("shard").between(shards[0], shards[1] - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(lambda q, v: best_of_unit(k, q, v), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "query_mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the k rows with the highest inner products.

    Both tables hold a whole-number id and a list of numbers; components count as
    floor(1024 * x). All rows compete but those with the query's own id. Equal scores go to the
    smaller id, ranks start at 1, and a query has fewer rows where fewer compete. Rows with a
    null id, a null vector or a null or non-finite component take no part. Vectors may differ in
    length: missing components count as zero, so an empty vector scores zero. Rows equal in id
    and vector each compete; a query asked twice is answered once, and two vectors under one
    query id are both answered. Scores are exact; those beyond a long stop at its ends and
    count as equal there. Other
    columns are not read. No queries or no vectors give no rows.
    """
    scratch = Scratch(vectors.sparkSession, "maxscore")
    # equal rows meet combined, so that no shard grows with one of them
    held = scratch.keep(usable(vectors, id_col, vec_col).groupBy("id", "vec").agg(F.count("*").alias("copies")), "vectors")
    asked = scratch.keep(usable(queries, id_col, vec_col).distinct().withColumn("mark", F.xxhash64("vec")), "queries")
    n_shards = max(1, -(-held.count() // shard))
    blocks = max(1, -(-asked.count() // block))
    dealt = held.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(n_shards)).cast("int"))
    none = F.lit(None).cast("long").alias("threshold")
    first = scratch.keep(_units(asked.select("id", "mark", "vec", none), dealt, (0, 1), blocks, k), "first")
    if n_shards == 1:
        return _ranked(first, k).select("query_id", "rank", "vec_id", "score")
    known = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_mark").alias("mark"), F.col("score").alias("threshold"))
    bounded = asked.join(known, ["id", "mark"], "left").select("id", "mark", "vec", "threshold")
    found = first.union(_units(bounded, dealt, (1, n_shards), blocks, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
