"""Prefix trie of conversations: what they share from the first turn on, and what sharing saves.

A turn is known by a digest of its place, role and text, and a prefix by the exclusive-or of its
turns' digests (two independent 64-bit hashes), which runs along a conversation in chunks, so
that a conversation of any length is spread over many tasks. Equal prefixes are one node. A node
is owned by its smallest member; the nodes that a conversation owns follow one another, so
(owner, depth) names a node and (parent's owner, depth - 1) its parent. Subtree sums come from
the centroid decomposition of that parent-edge forest, weighted by turns (rollup.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.rollup import subtree_sums
from stepline.llm.scratch import Scratch

CHUNK = 4096  # turns of a conversation that one window holds
PARTITION_BITS = 33  # of monotonically_increasing_id: places of the rows of a partition stand below

KEY = ("k1", "k2")


def placed_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, place, role, mark, size) of every turn and (conv, n) of every conversation; places start at 1.

    Rows are cut into ranges of (conversation, turn), and a range adds what its conversations have
    in earlier ranges, so a long conversation is not ordered in one task.
    """
    said = F.coalesce(text, F.lit(""))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.md5(said.cast("binary")).alias("mark"), F.length(said).cast("long").alias("size"))
    order = ["conv", "turn", "role", "mark"]
    ranged = scratch.keep(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    cut = ranged.withColumn("range", F.shiftrightunsigned("at", PARTITION_BITS))
    per = cut.groupBy("conv", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("conv", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    placed = cut.join(starts, ["conv", "range"]).select("conv", (F.col("at") + F.col("shift")).alias("place"), "role", "mark", "size")
    return placed, per.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(placed: DataFrame, convs: DataFrame, base: Column, take: Column, most: int) -> DataFrame:
    """(conv, depth, role, mark, size, turns) of the conversations that start like another one.

    Conversation conv starts with the first ``take`` turns of ``base`` (at most ``most``) and goes
    on with its own turns after as many of its own; turns is its new length. Conversations that
    are left without turns have no rows.
    """
    wanted = convs.withColumns({"base": base, "take": take})
    lenders = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = wanted.join(lenders, "base", "left").withColumn("lent", F.least("take", F.coalesce("base_n", F.lit(0))))
    known = known.withColumn("turns", F.col("lent") + F.greatest(F.col("n") - F.col("take"), F.lit(0)))
    heads = placed.where(F.col("place") <= most).select(F.col("conv").alias("base"), "place", "role", "mark", "size")
    lent = known.join(heads, "base").where("place <= take").select("conv", F.col("place").alias("depth"), "role", "mark", "size", "turns")
    own = placed.join(known.select("conv", "take", "lent", "turns"), "conv").where("place > take")
    return lent.union(own.select("conv", (F.col("place") - F.col("take") + F.col("lent")).alias("depth"), "role", "mark", "size", "turns"))


def prefix_keys(turns: DataFrame) -> DataFrame:
    """turns with the keys of the prefix that ends here (k1, k2) and of the one before (p1, p2)."""
    cut = turns.withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK))
    cut = cut.withColumns({k: F.xxhash64(F.lit(i), "depth", "role", "mark") for i, k in enumerate(("e1", "e2"))})
    per = cut.groupBy("conv", "chunk").agg(F.bit_xor("e1").alias("c1"), F.bit_xor("e2").alias("c2"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("conv", "chunk", *[F.bit_xor(c).over(earlier).alias(f"b{c[1]}") for c in ("c1", "c2")]).where("chunk > 0")
    run = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(before, ["conv", "chunk"], "left")
    keyed = joined.withColumns({f"k{i}": F.bit_xor(f"e{i}").over(run).bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)})
    return keyed.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")) for i in (1, 2)}).drop("chunk", "e1", "e2", "b1", "b2")


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined numbers of each node; rows come ordered by node and number.

    One number at a time: what a task holds does not grow with a node's members.
    """
    node, digest, done = None, None, []

    def out() -> pa.RecordBatch:
        cols = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=["chain", "depth", "ends_sha256"])

    for batch in batches:
        for chain, depth, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (chain, depth) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (chain, depth), hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if len(done) > 10_000:
            yield out()
            done.clear()
    if node is not None:
        done.append((*node, digest.hexdigest()))
    yield out()


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per node of the trie of conversations; ``turns`` is that of ``rebuilt``, ``convs`` names all conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    below = prefix_keys(turns).select("conv", "depth", "turns", *KEY, "p1", "p2", "size")
    lengths = turns.groupBy("conv").agg(F.max("turns").alias("turns"))
    zero = [F.lit(0).cast("long").alias(c) for c in (*KEY, "p1", "p2", "size")]
    roots = convs.join(lengths, "conv", "left").select("conv", F.lit(0).cast("long").alias("depth"), F.coalesce("turns", F.lit(0)).alias("turns"), *zero)
    paths = scratch.keep(roots.union(below), "paths")
    rest = F.col("turns") - F.col("depth")
    figures = [F.min("conv").alias("chain"), F.count("*").alias("n_convs"), F.sum(rest + 1).alias("weight"), F.max("size").alias("size"), F.max("p1").alias("p1"), F.max("p2").alias("p2")]
    nodes = scratch.keep(paths.groupBy("depth", *KEY).agg(*figures), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("chain").alias("parent_chain"))
    named = nodes.join(parents, ["depth", "p1", "p2"], "left").select("chain", "depth", "parent_chain", "n_convs", (F.col("n_convs") - 1).alias("spare"), "size")
    children = named.where("depth > 0").groupBy("parent_chain", "depth").agg(F.count("*").alias("n_children"))
    children = children.select(F.col("parent_chain").alias("chain"), (F.col("depth") - 1).alias("depth"), "n_children")
    full = named.join(children, ["chain", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = scratch.keep(full.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("spare") * F.col("size")}), "full")
    walked = scratch.keep(paths.select("conv", "depth", *KEY, "turns").join(nodes.select("depth", *KEY, "chain", "weight"), ["depth", *KEY]).select("conv", "depth", "turns", "weight", F.col("chain").alias("owner")), "walked")
    # a conversation that owns no node only repeats what others walk
    owners = full.select(F.col("chain").alias("conv")).distinct()
    chains = walked.join(owners, "conv", "left_semi").select(F.col("conv").alias("chain"), "depth", "weight", "owner")
    sums = subtree_sums(full.select("chain", "depth", "parent_chain", "n_leaves", "saved_tokens"), chains, ["n_leaves", "saved_tokens"], scratch)
    ends = walked.where("depth = turns").select(F.col("owner").alias("chain"), "depth", "conv")
    digests = ends.repartition("chain", "depth").sortWithinPartitions("chain", "depth", "conv").mapInArrow(digest_ends, "chain long, depth long, ends_sha256 string")
    out = full.drop("n_leaves", "saved_tokens").join(sums, ["chain", "depth"]).join(digests, ["chain", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("chain").alias("conv_id"), "depth", F.col("parent_chain").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", base: Column | None = None, take: Column | None = None, most: int = 0) -> DataFrame:
    """The trie of the conversations in ``rows``, one row per distinct prefix.

    A node is a sequence of turns (role and text) that some conversation starts with; the root
    is the empty one, of depth 0. conv_id is the smallest conversation that starts with it,
    parent_conv_id that of its parent (null for the root), n_convs how many there are, n_children
    and n_leaves its children and the childless nodes of its subtree, saved_tokens the code
    points of the last turns in its subtree times the conversations that need not store them
    again, ends_sha256 the digest of the comma-joined numbers of conversations that end here.

    ``base`` and ``take`` (columns over ``conv``) make conversations start with the first take
    turns of another one, at most ``most``; by default they stay as they are. Turns are ordered
    by their number, null first; equal numbers by role and then by the MD5 of the text, so
    repeated rows are turns of their own. A null role or text is empty; rows without a
    conversation number take no part; empty texts count no code points. Turns and prefixes are
    told apart by 128 bits of digest. Other columns are not read. No rows give no nodes.
    """
    scratch = Scratch(rows.sparkSession, "trie")
    placed, convs = placed_turns(rows, conv, turn, role, text, scratch)
    convs = scratch.keep(convs, "convs")
    own = F.col("conv") if base is None else base
    turns = rebuilt(placed, convs, own, F.lit(0) if take is None else take, most)
    return trie(turns, convs, scratch)
