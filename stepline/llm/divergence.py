"""Divergence of sources within a language: which sources differ, and by which terms.

Every group (lang, source) and every language is a smoothed distribution over the language's
terms in whole numbers; two distributions differ by a sum of f over the terms. Terms are never
ranked one by one: those with equal counts have equal values, so they are grouped into cells of
(count in the group, count in the language), f is evaluated once a cell, cells of equal value
are merged and ranked by cumulative multiplicity, and only those that reach the report are
expanded into terms. Sources are compared over cells of their two counts likewise, in tiles of
sources and buckets of terms, so no task holds a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.scratch import Scratch

MIN_DOCS = 10  # documents of its language that a term must be in
TOP_TERMS = 10
UNIT = 1_000_000_000
HELD = 400_000  # counts a task holds before it hands them on
PIECE = 1 << 20  # bytes of a text handled at once
TILE, BUCKET_ROWS = 32, 100_000  # sources of a tile, counts of a bucket of terms

COUNTS = "lang string, source string, term binary, n long, docs long"

# A-Z become lower case; what is no letter of ASCII and no part of another character becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if at + PIECE >= len(folded) else folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the documents, counted as far as HELD allows."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in held.items():
            terms = list(total)
            for at in range(0, len(terms), 10_000):
                part = terms[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([total[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for lang, source, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                total, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(total), None
                for words in terms_of(text):
                    total.update(words)
                    seen = set(words) if seen is None else seen.union(words)
                if seen:
                    docs.update(seen)
                size += len(total) - before
                if size > HELD:
                    yield from hand_on()
                    held.clear()
                    size = 0
    yield from hand_on()


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exact; null where there are no terms."""
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    above = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, (total + 2 * terms).cast("decimal(20,0)")))


def difference(p: Column | str, q: Column | str) -> Column:
    """f: the squared difference over the sum, rounded down."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, head): counts of the terms in at least min_docs documents of their language.

    head marks one row of every (lang, term).
    """
    read = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    counted = read.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")  # as many rows as the language has sources, at most
    summed = counted.withColumns({"lang_n": F.sum("n").over(same), "lang_docs": F.sum("docs").over(same), "head": F.col("source") == F.min("source").over(same)})
    return summed.where(F.col("lang_docs") >= min_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "head")


def group_sizes(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, total, lang_total, terms) of every group, also of those without terms."""
    groups = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("head").cast("long")).alias("terms"))
    joined = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return joined.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")])


def term_ranks(kept: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): terms that a group uses more than its language, the first top ranks."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("many")).join(sizes, ["lang", "source"])
    cells = cells.withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")}).where("p > q").withColumn("value", difference("p", "q"))
    by_value = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    # each value holds a term at least, so no value beyond the first top ones can matter
    leading = by_value.withColumn("place", F.row_number().over(group)).where(F.col("place") <= top)
    leading = leading.withColumn("before", F.sum("many").over(group) - F.col("many")).where(F.col("before") < top).select("lang", "source", "value", "before")
    wanted = cells.join(leading, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "before")
    expanded = kept.join(wanted, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value", "before")
    tie = Window.partitionBy("lang", "source", "value").orderBy("item")
    placed = expanded.withColumn("place", F.row_number().over(tie)).where(F.col("place") <= top)
    return placed.withColumn("rank", (F.col("before") + F.col("place")).cast("int")).where(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")


def compare_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value, many): f over the terms of one bucket that either source of a pair has.

    Sources are numbers; a row without a term names a source of the two tiles. many counts the
    terms; the others have one value, that of two zero counts.
    """
    lang, first, second = rows["lang"].iat[0], int(rows["tile_a"].iat[0]), int(rows["tile_b"].iat[0])
    numbers, at = np.unique(rows["number"].to_numpy(), return_inverse=True)
    zero = np.zeros(len(numbers), dtype=np.int64)
    zero[at] = rows["zero"].to_numpy()
    used = rows["term"].notna().to_numpy()
    term, names = pd.factorize(rows["term"][used])
    p = np.repeat(zero[:, None], len(names), axis=1)
    has = np.zeros(p.shape, dtype=bool)
    p[at[used], term], has[at[used], term] = rows["p"][used].to_numpy(), True
    cells = [np.unique(line, return_inverse=True) for line in p]
    out = []
    for i, a in enumerate(numbers):
        for j, b in enumerate(numbers):
            if a >= b or (a // TILE, b // TILE) != (first, second):
                continue
            either = has[i] | has[j]
            (pa_, ca), (pb, cb) = cells[i], cells[j]
            cell, many = np.unique((ca * len(pb) + cb)[either], return_counts=True)
            x, y = pa_[cell // len(pb)], pb[cell % len(pb)]
            out.append((lang, a, b, int(((x - y) * (x - y) // (x + y) * many).sum()), int(either.sum())))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value", "many"])


def pair_ranks(kept: DataFrame, sizes: DataFrame, buckets: int) -> DataFrame:
    """(lang, source, item, value, rank): the other sources of its language, by how much they differ from a source."""
    order = Window.partitionBy("lang").orderBy("source")
    numbered = sizes.withColumns({"number": F.row_number().over(order) - 1, "zero": share(F.lit(0), "total", "terms")})
    last_tile = F.col("last").cast("int")
    tiles = numbered.groupBy("lang").agg(F.floor(F.max("number") / TILE).alias("last"))
    placed = numbered.join(tiles, "lang").withColumn("tile", F.floor(F.col("number") / TILE).cast("int"))
    counts = kept.join(placed, ["lang", "source"]).withColumn("p", share("n", "total", "terms")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # every tile knows all its sources, also those without a term in a bucket
    named = placed.where("terms > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumns({"term": F.lit(None).cast("string"), "p": F.col("zero")})
    cols = ["lang", "tile", "last", "bucket", F.col("number").cast("long").alias("number"), "zero", "term", "p"]
    met = counts.select(cols).union(named.select(cols)).withColumn("other", F.explode(F.sequence(F.lit(0), last_tile)))
    met = met.select("lang", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "bucket", "number", "zero", "term", "p")
    sums = met.groupBy("lang", "tile_a", "tile_b", "bucket").applyInPandas(compare_tile, "lang string, a long, b long, value long, many long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("many").alias("many"))
    one = numbered.select("lang", "source", F.col("number").cast("long").alias("x"), F.col("zero").alias("zx"), "terms")
    two = numbered.select("lang", F.col("source").alias("item"), F.col("number").cast("long").alias("y"), F.col("zero").alias("zy"))
    # as many rows as the report has
    pairs = one.join(two, "lang").where("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(sums, ["lang", "a", "b"], "left")
    absent = (F.col("terms") - F.coalesce("many", F.lit(0))) * difference("zx", "zy")
    valued = pairs.select("lang", "source", "item", F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + absent).otherwise(0).cast("long").alias("value"))
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return valued.withColumn("rank", F.row_number().over(group))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source).

    Part ``pair``: every other source of the language by the summed difference of the two
    distributions over the language's terms. Part ``term``: the terms that are more frequent in
    the group than in the language, by their difference, ranks up to top. A term is a run of
    ASCII letters (A-Z count as a-z) and non-ASCII characters; a language keeps those in at
    least min_docs of its documents. Ranks start at 1 with the largest value; ties go by the
    item in UTF-8 order. Whole-number arithmetic throughout. Null lang, source or text are
    empty strings; documents without terms still make their group, which is compared; in a
    language without kept terms all pairs are 0. Repeated rows are documents of their own.
    Other columns are not read; no documents give no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = scratch.keep(kept_terms(docs, lang_col, source_col, text_col, min_docs), "kept")
    sizes = scratch.keep(group_sizes(docs, kept, lang_col, source_col), "sizes")
    buckets = max(1, -(-kept.count() // BUCKET_ROWS))
    parts = [pair_ranks(kept, sizes, buckets).withColumn("part", F.lit("pair")), term_ranks(kept, sizes, top).withColumn("part", F.lit("term"))]
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return parts[0].select(cols).union(parts[1].select(cols))
