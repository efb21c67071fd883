"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many arcs of a ring of ``CELLS`` cells. A row belongs to the arc
its key's cell lies on; a shard takes the rows of its arcs up to its capacity and the
rest continue clockwise to the next arc whose shard has room.

Rows are never moved one by one on the driver: only the row count of each arc
(``shards * vnodes`` numbers) is collected, the overflow is settled on those
counts, and the resulting plan says for every arc which ranks go to which
shard. Spark then ranks the rows inside their arcs and joins the plan, whose
size depends on the ring alone. A rank is the number of the arc's rows in the
tasks before, known from counts per (arc, task), and the place in the own
task. So no arc is ever in one task, even if one id has a third of all rows.
DataFrame functions only.

Defined cases: null text counts 0 bytes and has a null checksum; a null id is
spread by its text; rows of an arc keep the order they were read in, and
equal rows get a slot each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import inline_rows, written

CELLS = 1 << 14


def ring_arcs(shards: int, vnodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """(end cell, shard) of every arc, clockwise. A shard's own points do not
    depend on how many shards there are; of two in one cell the older shard wins."""
    points = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"{seed}/{shard}/{v}".encode()).digest()
            points.setdefault(int.from_bytes(digest[:8], "big") % CELLS, shard)
    return sorted(points.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Largest load of each shard. ``slack`` 0: the capacities add up to the
    number of rows, so every shard is filled and counts differ by one at most."""
    if slack > 0:
        return [-int(-(1 + slack) * total // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def settle(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, number of ranks, shard): which rows of an arc its shard
    keeps and where the overflow goes.

    First every arc fills its own shard, then what is left travels clockwise,
    arc by arc, until all has found room (at most two rounds of the ring).
    """
    room, moves = list(room), []
    waiting: deque[list[int]] = deque()  # [arc, first rank, ranks]
    left = []
    for arc, (count, shard) in enumerate(zip(counts, owners)):
        took = min(count, room[shard])
        room[shard] -= took
        if took:
            moves.append((arc, 0, took, shard))
        left.append((took, count - took))
    for lap in range(2):
        for arc, shard in enumerate(owners):
            if not lap and left[arc][1]:
                waiting.append([arc, *left[arc]])
            while waiting and room[shard]:
                head = waiting[0]
                took = min(head[2], room[shard])
                room[shard] -= took
                moves.append((head[0], head[1], took, shard))
                head[1] += took
                head[2] -= took
                if not head[2]:
                    waiting.popleft()
    if waiting:
        raise ValueError("the shards have less room than there are rows")
    return moves


def cell_arcs(arcs: list[tuple[int, int]]) -> list[dict]:
    """For every cell the index of the first arc end at or after it, wrapping to arc 0."""
    ends = [end for end, _ in arcs]
    return [{"cell": c, "arc": bisect_left(ends, c) % len(ends)} for c in range(CELLS)]


def shard_plan(counts: dict[int, int], arcs: list[tuple[int, int]], shards: int, slack: float) -> list[dict]:
    """Plan rows: arc, ranks [lo, hi), shard and the slot of rank ``lo``."""
    owners = [shard for _, shard in arcs]
    every = [counts.get(a, 0) for a in range(len(arcs))]
    filled = [0] * shards
    plan = []
    for arc, lo, ranks, shard in settle(every, owners, capacities(sum(every), shards, slack)):
        plan.append({"arc": arc, "lo": lo, "hi": lo + ranks, "shard": shard, "slot": filled[shard]})
        filled[shard] += ranks
    return plan


def ring_shards(
    spark: SparkSession, docs: DataFrame, shards: int = 24, vnodes: int = 64, slack: float = 0.0, seed: int = 0
) -> DataFrame:
    """(doc_id, size, text_crc32, arc, shard, slot), one row per row of ``docs``."""
    arcs = ring_arcs(shards, vnodes, seed)
    text = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # the checksum spreads rows whose ids are missing or repeated
    spot = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32")), F.lit(seed))
    cells = inline_rows(spark, json.dumps(cell_arcs(arcs)), "cell: int, arc: int")  # CELLS rows
    rows = rows.withColumn("spot", spot).withColumn("cell", F.pmod("spot", F.lit(CELLS)).cast("int"))
    rows = rows.join(F.broadcast(cells), "cell").drop("cell", "spot")
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()))  # the task and the place in it, for good
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # one per arc
    plan = inline_rows(
        spark,
        json.dumps(shard_plan(counts, arcs, shards, slack)),
        "arc: int, lo: bigint, hi: bigint, shard: int, slot: bigint",
    )
    part = F.shiftright("at", 33).cast("int")
    sizes = rows.groupBy("arc", part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("arc", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("arc", "part").orderBy("at")
    ranked = rows.withColumn("part", part).withColumn("place", F.row_number().over(inner) - 1)
    ranked = ranked.join(sizes, ["arc", "part"]).withColumn("rank", F.col("base") + F.col("place"))
    plan = F.broadcast(plan.withColumnRenamed("arc", "plan_arc").withColumnRenamed("slot", "slot0"))
    inside = (F.col("arc") == F.col("plan_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(plan, inside)
    return placed.select(
        "doc_id", "size", "text_crc32", "arc", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot")
    )
