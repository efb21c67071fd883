"""Conversation prefix trie: shared first turns as nodes, subtree totals by tree contraction.

Turns of a conversation are numbered without bringing a conversation together
in one task: the turns are sorted by range (``numbered``), so a conversation
with a third of all rows lies in many tasks, and each (conversation, task)
gets its offset from the counts of the tasks before. In the same way every
prefix gets its name: the exclusive or of two 64-bit hashes of (place, turn)
over the turns so far, with the depth (``prefixes``). Equal prefixes are one
node (``trie``), counted with partial sums, so a first turn of nearly all
conversations is a row per task.

Totals of subtrees (``subtree_totals``) come from parallel tree contraction.
A round rakes all leaves (their totals go to their parents, summed before the
shuffle) and then compresses unary chains: of the nodes with a single child
those of locally least random rank are taken out, their value moves to the
edge of their child. An independent set of about a third of any chain goes per
round, so a trie of any shape is gone after a number of rounds that grows with
the logarithm of its size. Then the nodes taken out get their totals back,
last round first: their own value, the edge, and their child's total. Each
round is a few joins written to the shared folder.

Defined cases: rows without conv_id belong to no conversation; null role or
text is empty; turns of equal number (null first) stand in the order of role
and text, and a repeated row is a turn of its own; an empty table has no
nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_worker_tables, ship_package, written

NODE = ["depth", "k1", "k2"]  # what names a node: depth and the prefix's two hashes
CHUNK = 1 << 20  # bytes of member ids joined before they are hashed


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, parts): turns have conv_id, part, seat (from 0 within the part), two hashes of role and
    text, and chars; parts have conv_id, part, before (turns in earlier parts) and total."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role, text)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(
        "conv_id",
        F.monotonically_increasing_id().alias("at"),
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "text", "role").alias("h2"),
        F.length("text").cast("bigint").alias("chars"),
    )
    rows = written(rows).withColumn("part", F.shiftright("at", 33).cast("int"))
    counts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "conv_id",
        "part",
        "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("total"),
    )
    return rows, written(counts)  # a row per conversation and task


def rebuilt(conversations: DataFrame, heads: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) after each conversation's first ``heads`` turns are replaced by those of ``base``
    (columns over conv_id). turns: conv_id, part, place (from 1), h1, h2, chars; convs: conv_id, length."""
    rows, parts = numbered(conversations)
    convs = parts.groupBy("conv_id").agg(F.max("total").alias("total")).withColumns({"h": heads, "base": base})
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("offered"))
    convs = convs.join(lengths, "base", "left")
    taken = F.least("h", F.coalesce("offered", F.lit(0)))  # turns that the base has to give
    convs = written(convs.withColumn("taken", taken.cast("bigint")).withColumn("length", F.expr("taken + greatest(total - h, 0)")))
    moved = parts.join(convs.select("conv_id", "h", "taken"), "conv_id")
    turns = rows.join(moved, ["conv_id", "part"]).withColumn("place", F.expr("at - first + before + 1"))
    own = turns.where("place > h").withColumn("place", F.expr("place - h + taken"))
    most = convs.agg(F.max("h")).first()[0] or 0
    first = rows.join(parts.where(F.col("before") < most), ["conv_id", "part"])  # only parts that hold first turns
    first = first.withColumn("place", F.expr("at - first + before + 1")).where(F.col("place") <= most)
    first = first.select(F.col("conv_id").alias("base"), "place", "h1", "h2", "chars")
    given = convs.where("taken > 0").join(first, "base").where("place <= taken").withColumn("part", F.lit(-1))
    columns = ["conv_id", "part", "place", "h1", "h2", "chars"]
    return own.select(columns).union(given.select(columns)), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """A row per conversation and prefix: conv_id, its node's name, its parent's (p1, p2) and chars of its last turn."""
    z = {f"z{i}": F.xxhash64("place", f"h{i}") for i in (1, 2)}
    turns = turns.withColumns(z)
    here = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumns({f"x{i}": F.bit_xor(f"z{i}").over(here) for i in (1, 2)})
    sums = turns.groupBy("conv_id", "part").agg(*(F.bit_xor(f"z{i}").alias(f"s{i}") for i in (1, 2)))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = [F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)]
    turns = turns.join(sums.select("conv_id", "part", *so_far), ["conv_id", "part"])
    return turns.select(
        "conv_id",
        F.col("place").alias("depth"),
        *(F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}") for i in (1, 2)),
        *(F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i in (1, 2)),
        "chars",
    )


def nodes_of(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: id, its name, conv_id (smallest member), n_convs, chars, parent and parent_conv_id."""
    least, count = F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
    nodes = paths.groupBy(*NODE).agg(least, count, *(F.max(c).alias(c) for c in ("p1", "p2", "chars")))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(least, count).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in NODE), "conv_id", "n_convs", *(zero.alias(c) for c in ("p1", "p2", "chars")))
    nodes = written(nodes.union(root).withColumn("id", F.monotonically_increasing_id()))
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("k1").alias("p1"),
        F.col("k2").alias("p2"),
        F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return written(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``tree``: id, parent (null: a root) and numeric ``values``; returns id and the sums of the values over
    the subtree of every node. By contraction: rake, compress, expand."""
    edge = [f"edge_{v}" for v in values]  # what a child brings its parent besides its own total
    live = tree.select("id", "parent", *values, *(F.lit(0).cast("bigint").alias(e) for e in edge))
    raked, spliced = [], []
    while True:
        state = written(_raked(live, values, edge))
        raked.append(state.where("leaf").select("id", *values))
        rest = state.where("NOT leaf")
        if rest.isEmpty():
            break
        out = written(_chosen(rest, len(raked), values, edge))
        spliced.append(out.select("id", "only", *values))
        live = _without(rest, out, values, edge)
    done = raked
    for out in reversed(spliced):
        known = done[0]
        for more in done[1:]:
            known = known.union(more)
        below = known.select(F.col("id").alias("only"), *(F.col(v).alias(f"below_{v}") for v in values))
        back = out.join(below, "only").select("id", *((F.col(v) + F.col(f"below_{v}")).alias(v) for v in values))
        done = [*done, written(back)]
    total = done[0]
    for more in done[1:]:
        total = total.union(more)
    return total


def _raked(live: DataFrame, values: list[str], edge: list[str]) -> DataFrame:
    """``live`` with ``leaf`` marked, the leaves' totals added to their parents, and ``only``: the single
    child that is left of a node, if it is single."""
    kids = live.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    state = live.join(kids, "id", "left").withColumn("leaf", F.col("kids").isNull()).drop("kids")
    gifts = [F.sum(F.when(F.col("leaf"), F.col(v) + F.col(e))).alias(f"gift_{v}") for v, e in zip(values, edge)]
    below = state.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        *gifts, F.count_if(~F.col("leaf")).alias("inner"), F.min(F.when(~F.col("leaf"), F.col("id"))).alias("child")
    )
    state = state.join(below, "id", "left")
    added = [(F.col(v) + F.coalesce(f"gift_{v}", F.lit(0))).alias(v) for v in values]
    # a node whose children were all leaves is a leaf of the next round
    return state.select("id", "parent", *added, *edge, "leaf", F.when(F.col("inner") == 1, F.col("child")).alias("only"))


def _chosen(rest: DataFrame, turn: int, values: list[str], edge: list[str]) -> DataFrame:
    """Nodes to take out of unary chains: no two are neighbours. Their values hold their child's edge already;
    ``lift_*`` is what that child's edge becomes."""
    chain = rest.where("only is not null AND parent is not null")
    rank = F.struct(F.xxhash64("id", F.lit(turn)), "id")
    chain = chain.withColumn("rank", rank)
    up = chain.select(F.col("id").alias("parent"), F.col("rank").alias("rank_up"))
    down = chain.select(F.col("id").alias("only"), F.col("rank").alias("rank_down"))
    chain = chain.join(up, "parent", "left").join(down, "only", "left")
    least = (F.col("rank_up").isNull() | (F.col("rank") < F.col("rank_up"))) & (
        F.col("rank_down").isNull() | (F.col("rank") < F.col("rank_down"))
    )
    below = rest.select(F.col("id").alias("only"), *(F.col(e).alias(f"below_{e}") for e in edge))
    own = [(F.col(v) + F.col(f"below_{e}")).alias(v) for v, e in zip(values, edge)]
    lift = [(F.col(v) + F.col(e) + F.col(f"below_{e}")).alias(f"lift_{e}") for v, e in zip(values, edge)]
    return chain.where(least).join(below, "only").select("id", "only", F.col("parent").alias("new_parent"), *own, *lift)


def _without(rest: DataFrame, out: DataFrame, values: list[str], edge: list[str]) -> DataFrame:
    """``rest`` without the nodes of ``out``, whose children go to their parents."""
    kept = rest.join(out.select("id"), "id", "left_anti")
    new = out.select(F.col("only").alias("id"), "new_parent", *(f"lift_{e}" for e in edge))
    kept = kept.join(new, "id", "left")
    edges = [F.coalesce(f"lift_{e}", e).alias(e) for e in edge]
    return kept.select("id", F.coalesce("new_parent", "parent").alias("parent"), *values, *edges)


def joined_ids(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """(``by``, sha256): the SHA-256 of the decimal ``number``s of each group, ascending, comma-joined.

    Sorted by range first, so a hot group's ids are joined to chunks in many
    tasks; one task per group then hashes its chunks as they come.
    """
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        at, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for *key, n in zip(*(batch.column(i).to_pylist() for i in range(len(by) + 1))):
                if at is not None and (key != at or size >= CHUNK):
                    out.append((*at, first, ",".join(held)))
                    at = None
                if at is None:
                    at, first, held, size = key, n, [], 0
                held.append(str(n))
                size += len(held[-1]) + 1
            yield table(out, batch, names)
        if at is not None:
            yield table([(*at, first, ",".join(held))], batch, names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            out = []
            for *key, _, text in zip(*(batch.column(i).to_pylist() for i in range(len(by) + 2))):
                if key != at:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            yield table(out, batch, [*by, "sha256"])
        if at is not None:
            yield table([(*at, sha.hexdigest())], batch, [*by, "sha256"])

    def table(found: list[tuple], like: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
        whole = [pa.array([r[i] for r in found], like.column(0).type) for i in range(len(columns) - 1)]
        return pa.RecordBatch.from_arrays([*whole, pa.array([r[-1] for r in found], pa.string())], columns)

    names = [*by, "first", "ids"]
    order = [*by, number]
    chunked = rows.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunked = chunked.mapInArrow(chunks, f"{keys}, first bigint, ids string")
    chunked = chunked.repartition(*by).sortWithinPartitions(*by, "first")
    return chunked.mapInArrow(digests, f"{keys}, sha256 string")


def conversation_trie(conversations: DataFrame, heads: Column, base: Column) -> DataFrame:
    """A row per node of the trie of the conversations rebuilt with ``heads`` turns of conversation ``base``:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship_package(conversations.sparkSession)
    turns, convs = rebuilt(conversations, heads, base)
    convs, paths = written(convs), written(prefixes(turns))
    nodes = nodes_of(paths, convs)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf = (F.col("n_children") == 0).cast("bigint").alias("n_leaves")
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    totals = subtree_totals(nodes.select("id", "parent", leaf, saved), ["n_leaves", "saved_tokens"])
    last = convs.where("length > 0").withColumnRenamed("length", "depth").join(paths, ["conv_id", "depth"])
    zero = F.lit(0).cast("bigint")
    none = convs.where("length = 0").select(*(zero.alias(c) for c in NODE), "conv_id")
    ends = joined_ids(last.select(*NODE, "conv_id").union(none), NODE, "conv_id")
    rows = nodes.join(totals, "id").join(ends, NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.lit(empty)).alias("ends_sha256"),
    )
