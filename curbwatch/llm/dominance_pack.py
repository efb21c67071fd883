"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

A packing problem with integer lengths up to ``capacity`` is its histogram: how
many pieces of each length there are. The histogram has at most ``capacity``
rows however large the corpus is; it alone goes to the driver, where the
problem is solved for all pieces at once:

1. Reduction. A set of pieces that contains the longest piece and dominates
   every other set containing it may be fixed without losing an optimal
   packing: exact complements, a piece nothing fits beside, the longest partner
   where only one fits or where no two partners together are longer, and the
   pair of partners that beats every other pair. Fixed for as many copies at
   once as there are; repeated on the shrunken instance until nothing changes.
2. Best fit decreasing on the remainder, bins of equal content as one group.

The result is a plan: for each length, ranges of ranks with a first sequence
and an offset. Its size depends on the number of lengths, not of pieces. Spark
gives every piece its rank among its length (rank in its task, plus what
earlier tasks had) and looks the place up. Only (id, length) rows are shuffled;
a third of all pieces having one length (cut pieces do) spreads over the tasks.

Defined cases: null or empty text is one end token; a longer text is cut into
full pieces and a rest; repeated rows are packed each on its own; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, written
from .word_tokens import encoded_rows, read_definition

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
Pattern = tuple[tuple[int, int], ...]  # (length, copies) in order of place


class Instance:
    """Lengths with counts; the lengths present are kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.count)

    def take(self, length: int, copies: int) -> None:
        self.count[length] -= copies
        if not self.count[length]:
            del self.count[length]
            self.lengths.remove(length)

    def largest_upto(self, room: int, without: dict[int, int]) -> int:
        """The largest length <= room with a copy left besides ``without``; 0 if none."""
        i = bisect_left(self.lengths, room + 1) - 1
        while i >= 0 and self.count[self.lengths[i]] <= without.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest pieces besides one of length ``without``; fewer if there are fewer."""
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n, self.count[length] - (length == without))
            if len(out) >= n:
                break
        return out[:n]


ENOUGH = 4  # copies of a length from which on ``dominating`` does not see how many there are


def dominating(inst: Instance, long: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of a piece ``long`` (the longest left) in a set that dominates all others with it; None if not known."""
    room = capacity - long
    best = inst.largest_upto(room, {long: 1})
    if not best:
        return ()
    if best == room:
        return (best,)
    low = inst.smallest(3, long)
    if len(low) < 2 or low[0] + low[1] > room:
        return (best,)  # a single partner at most: the longest
    if len(low) == 3 and sum(low) <= room:
        return None  # three partners fit: not decided here
    # two partners at most: the longest one alone if no two are longer together
    pair = 0
    for x in inst.lengths:
        if x > room:
            break
        if inst.count[x] - (x == long) > 0:
            y = inst.largest_upto(min(x, room - x), {long: 1} if x == long else {x: 1})
            pair = max(pair, x + y if y else 0)
    if best >= pair:
        return (best,)
    second = inst.largest_upto(room - best, {best: 1, long: 1} if best != long else {long: 2})
    half = inst.largest_upto(room // 2, {long: 1})
    if second and second >= half:
        return (best, second)  # the longest possible first and second partner
    return None


def reduce(inst: Instance, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets; ``inst`` keeps the rest. (pattern, sequences) of the fixed ones."""
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for long in reversed(list(inst.lengths)):
            while inst.count.get(long):
                partners = dominating(inst, long, capacity)
                if partners is None:
                    break
                need: dict[int, int] = {}
                for length in (long, *partners):
                    need[length] = need.get(length, 0) + 1
                copies = min(inst.count[n] // k for n, k in need.items())
                if len(partners) == 2:
                    # the argument asks whether up to ENOUGH copies of a length are left: while they are, it
                    # decides the same, so all sets until then are fixed at once, and the last ones one by one
                    copies = max(1, min((inst.count[n] - ENOUGH) // k for n, k in need.items()))
                for length, k in need.items():
                    inst.take(length, copies * k)
                fixed.append((tuple(sorted(need.items(), reverse=True)), copies))
                changed = True
    return fixed


def best_fit(inst: Instance, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing; bins with the same content are one group."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}  # by room left
    rooms: list[int] = []

    def add(room: int, pattern: Pattern, bins: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, bins))

    for length in reversed(inst.lengths):
        left = inst.count[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                pattern, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, pattern, bins = capacity, (), -(-left // (capacity // length))
            each = room // length  # the fullest bin takes the next one too while it fits
            used = min(bins, left // each)
            if used:
                add(room - each * length, (*pattern, (length, each)), used)
                left -= used * each
            if used < bins and left:
                add(room - left * length, (*pattern, (length, left)), 1)
                used, left = used + 1, 0
            if used < bins:
                add(room, pattern, bins - used)
    return [g for room in rooms for g in groups[room]]


def pack_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset), sorted
    by length and rank: the places of all pieces."""
    inst = Instance(counts)
    patterns = reduce(inst, capacity)
    patterns += best_fit(inst, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, bins in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + bins * copies
            offset += length * copies
        sequence += bins
    if used != {n: c for n, c in counts.items() if c}:
        raise AssertionError("the plan does not hold every piece once")
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def look_up(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    starts = plan[:, 0] << 44 | plan[:, 1]
    at = np.searchsorted(starts, length.astype(np.int64) << 44 | rank, side="right") - 1
    inside = rank - plan[at, 1]
    return plan[at, 3] + inside // plan[at, 2], plan[at, 4] + inside % plan[at, 2] * length


def cut_pieces(docs: DataFrame, definition: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, places, rows = TaskContext.get().partitionId(), {}, []
        for doc_id, ids in encoded_rows(batches, definition, end_id):
            for piece, start in enumerate(range(0, len(ids), capacity)):
                cut = ids[start : start + capacity]
                place = places[len(cut)] = places.get(len(cut), -1) + 1
                rows.append((doc_id, piece, start, len(cut), zlib.crc32(cut), part, place))
            if len(rows) >= 20_000:
                yield frame(rows)
                rows = []
        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])
        return out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    ship_package(docs.sparkSession)
    pieces = written(cut_pieces(docs, read_definition(tokenizer_path), capacity, end_id))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pack_plan(histogram, capacity)  # at most ``capacity`` lengths
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = look_up(plan, batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select(*out, "rank").mapInPandas(place, schema)
