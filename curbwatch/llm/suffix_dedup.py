"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

A *window* is a string of ``length`` bytes of one text. Suffixes whose windows
are equal have to be sorted together, and a distributed job cannot afford to
send a window for every byte. So suffixes are dealt by the least k-gram of
their window (frequent k-grams count as large), which equal windows share.
Neighbouring windows mostly share it too: a maximal run of them is a *piece*,
sent as one string.

1. A sketch counts all k-grams, so that those of common lines come last in the
   order. It decides how much work there is, never the result.
2. Pieces are named by (least k-gram, hash). K-grams that only one place of the
   corpus has end here, which is most text.
3. A piece found twice is repeated throughout. Of the others those meet that
   share their k-gram with a different piece: one copy of each is sent to the
   task of its k-gram, many k-grams to a task.
4. There the suffixes of a block of pieces are sorted by difference-cover
   blockwise construction (``sorted_suffixes``): the suffixes whose places
   modulo ``PERIOD`` are in the cover are ranked first, by doubling; then one
   bucket of all suffixes at a time is sorted by its first bytes, and what is
   still tied is ordered by the ranks of the two cover suffixes that stand the
   same few bytes further on. Besides the text that needs 4 ranks for 13 bytes
   and one bucket. Neighbours in the order that agree in ``length`` bytes are
   repeated windows.
5. A k-gram whose pieces would make a block too large (near copies in
   thousands, each edited elsewhere) has its windows counted by a 128-bit hash
   instead, in a grouped sum, so that no task holds them together.

Spans of repeated windows go back to every text that holds the piece, and the
bytes they cover are taken out.

Texts are named by MD5 and their id, pieces by 56 bits of k-gram and 64 of
hash: equal names are taken for equal strings.

Defined cases: null or empty text has no bytes; a text shorter than ``length``
stays; a repeated row, or a text found twice, is a repeat of all its windows;
a null id is an id of its own; bytes are those of UTF-8, so what is left need
not be valid UTF-8. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import drop_worker_tables, ship_package, written
from .jaccard_matrix import BLOCK_BITS, CELL_BITS, free_names, frequency_levels
from .shingles import ShingleHasher, mixed

U = np.uint64
GRAM = 32  # bytes of a k-gram
STRIP = 1 << 20  # bytes of text worked on at once
PERIOD, COVER = 13, (0, 1, 3, 9)  # a perfect difference set: every difference modulo 13 occurs
BUCKET = 1 << 17  # suffixes of a bucket, about
BLOCK_BYTES = 1 << 22  # text of a block of pieces, about
GROUP_BYTES = 1 << 24  # text of one k-gram's pieces that a task may hold
NO_ID = -(1 << 63)

PIECE = "m bigint, h bigint, id bigint, text_key binary, start int, n int, several boolean"


# ---------------------------------------------------------------- sorting


def words_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number that sorts like them. ``text`` ends with zeros enough."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[places].view(">u8").ravel().astype(U)


class CoverRanks:
    """Ranks of the suffixes of a text whose places modulo ``PERIOD`` are in ``COVER``."""

    def __init__(self, text: np.ndarray, n: int):
        self.n = n
        slot = np.full(PERIOD, -1, np.int64)
        slot[list(COVER)] = np.arange(len(COVER))
        self.slot = slot
        periods = -(-n // PERIOD) + 1
        places = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        inside = places < n
        places = places[inside]
        self.rank = np.full(periods * len(COVER), -1, np.int64)  # -1: behind the end, before everything
        cells = np.flatnonzero(inside)
        # first by 16 bytes, then by the rank of the suffix one, two, four ... periods on
        first, second = words_at(text, places), words_at(text, places + 8)
        # the end of the text comes before a zero byte: how much of the 16 bytes is there, if there are such bytes
        left = np.minimum(n - places, 16)
        order = np.lexsort((second, first) if text[:n].all() else (left, second, first))
        a, b, c = first[order], second[order], left[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        starts = np.flatnonzero(new)
        ranks = np.repeat(starts, np.diff(np.append(starts, len(order))))
        self.rank[cells[order]] = ranks
        sizes = np.diff(np.append(starts, len(order)))
        open_ = cells[order][np.repeat(sizes > 1, sizes)]
        shift = 1
        while len(open_):
            before = self.rank[open_]
            ahead = open_ + shift * len(COVER)
            behind = np.where(ahead < len(self.rank), self.rank[np.minimum(ahead, len(self.rank) - 1)], -1)
            order = np.lexsort((behind, before))
            open_, before, behind = open_[order], before[order], behind[order]
            group = np.concatenate([[True], before[1:] != before[:-1]])
            new = group | np.concatenate([[True], behind[1:] != behind[:-1]])
            at = np.arange(len(open_))
            group_at = np.maximum.accumulate(np.where(group, at, 0))
            new_at = np.maximum.accumulate(np.where(new, at, 0))
            self.rank[open_] = before + new_at - group_at
            sizes = np.diff(np.append(np.flatnonzero(new), len(open_)))
            open_ = open_[np.repeat(sizes > 1, sizes)]
            shift *= 2

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ranks of cover places."""
        return self.rank[places // PERIOD * len(COVER) + self.slot[places % PERIOD]]


# steps to a cover place common to two residues
STEP = np.array(
    [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]
)


def sorted_suffixes(text: np.ndarray, n: int, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The suffixes of ``text[:n]`` that begin at ``starts``, in order, a bucket at a time. ``text`` goes on
    with at least 16 zeros. Suffixes are told apart by the bytes up to ``n`` only."""
    if not len(starts):
        return
    ranks = CoverRanks(text, n)
    sample = np.sort(words_at(text, starts[:: max(1, len(starts) // 4096)]))
    many = max(1, len(starts) // BUCKET)
    edges = np.unique(sample[np.arange(1, many) * len(sample) // many]) if many > 1 else sample[:0]
    bucket = np.concatenate(
        [np.searchsorted(edges, words_at(text, starts[i : i + BUCKET]), side="right") for i in range(0, len(starts), BUCKET)]
    )
    for b in range(len(edges) + 1):
        chosen = starts[bucket == b]
        if len(chosen):
            yield sorted_bucket(text, n, chosen, ranks)


def sorted_bucket(text: np.ndarray, n: int, places: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    first, second = words_at(text, places), words_at(text, places + 8)
    left = np.minimum(n - places, 16)
    order = np.lexsort((left, second, first) if left.min() < 16 else (second, first))
    places, first, second, left = places[order], first[order], second[order], left[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (left[1:] != left[:-1])])
    group = np.cumsum(new) - 1
    tied = np.bincount(group)[group] > 1
    if tied.any():
        # 16 bytes are equal, so a suffix that ends within them is tied with none: cover places lie inside
        places[tied] = untied(places[tied], group[tied], ranks)
    return places


def untied(places: np.ndarray, group: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """``places`` (sorted by group) in the order of their suffixes within each group.

    Places of one residue are sorted by the rank a fixed step on. Two residues
    are merged by the ranks of the cover places that they have in common; a
    place's position is the sum of its positions in all those lists."""
    top = np.int64(len(ranks.rank) + 1)
    residue = places % PERIOD
    lists, keys = {}, {}
    for r in np.unique(residue).tolist():
        own = np.flatnonzero(residue == r)
        step = int(STEP[r, r])
        own = own[np.argsort(group[own] * top + ranks.at(places[own] + step), kind="stable")]
        lists[r] = places[own]
        for step in {int(d) for d in STEP[r]}:  # as many as the cover has places
            keys[r, step] = group[own] * top + ranks.at(places[own] + step)
    out = np.empty_like(places)
    for r, own in lists.items():
        position = np.arange(len(own))
        for other in lists:
            if other != r:
                step = int(STEP[r, other])
                position += np.searchsorted(keys[other, step], keys[r, step])
        out[position] = own
    return out


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start (ascending) whether its window occurs at another start as well."""
    n = len(text)
    text = np.concatenate([text, np.zeros(24, np.uint8)])
    hit = np.zeros(n + 1, bool)
    last = starts[:0]
    for bucket in sorted_suffixes(text, n, starts):
        run = np.concatenate([last, bucket])
        a, b = run[:-1], run[1:]
        for at, size in [(0, 8), *((i, min(64, length - i)) for i in range(8, length, 64))]:
            views = np.lib.stride_tricks.sliding_window_view(text, size)
            same = (views[a + at] == views[b + at]).all(axis=1)
            a, b = a[same], b[same]
        hit[a] = hit[b] = True
        last = run[-1:]
    return hit[starts]


# ---------------------------------------------------------------- pieces


class PieceFinder:
    """Least k-grams of windows, and the runs of windows that share theirs."""

    def __init__(self, length: int, levels: np.ndarray | None = None, gram: int = GRAM):
        self.length, self.gram, self.levels = length, min(gram, length - 8), levels
        self.hasher = ShingleHasher()
        rng = np.random.default_rng(17)  # letters of either case differ here
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)

    def sums(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of weighted bytes before each place, inverse weights)."""
        powers, inverses = self.hasher._powers(len(text) + 1)
        return np.concatenate([[U(0)], np.cumsum(self.table[text] * powers[: len(text)], dtype=U)]), inverses

    def grams(self, sums: np.ndarray, inverses: np.ndarray) -> np.ndarray:
        k = self.gram
        return mixed((sums[k:] - sums[:-k]) * inverses[: len(sums) - k])

    def cells(self, text: np.ndarray) -> np.ndarray:
        return (self.grams(*self.sums(text)) >> U(64 - CELL_BITS)).view(np.int64)

    def pieces(self, text: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """(least k-gram, hash, start, windows, whether the k-gram occurs several times in it) of the runs
        of ``valid`` windows (those within one text) that share their least k-gram."""
        sums, inverses = self.sums(text)
        order = self.grams(sums, inverses)
        if self.levels is not None:
            order = order >> U(8) | self.levels[(order >> U(64 - CELL_BITS)).view(np.int64)].astype(U) << U(56)
        width = self.length - self.gram + 1
        least = sliding_least(order, width)  # one per window
        change = np.concatenate([[True], (least[1:] != least[:-1]) | ~valid[:-1]])
        start = np.flatnonzero(valid & change)
        if not len(start):
            return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, bool))
        end = np.flatnonzero(valid & np.concatenate([change[1:] | ~valid[1:], [True]])) + 1
        m, n = least[start], end - start
        whole = mixed((sums[end + self.length - 1] - sums[start]) * inverses[start])
        # whether a run holds its k-gram twice: looked up in the few runs whose k-gram the strip holds twice
        marks = np.zeros(1 << 20, bool)
        marks[(m & U(len(marks) - 1)).view(np.int64)] = True
        found = np.sort(order[marks[(order & U(len(marks) - 1)).view(np.int64)]])
        twice = found[1:][found[1:] == found[:-1]]
        several = np.zeros(len(m), bool)
        doubt = np.flatnonzero(np.isin(m, twice))
        if len(doubt):
            grams = n[doubt] + width - 1
            first = np.cumsum(grams) - grams
            at = np.repeat(start[doubt] - first, grams) + np.arange(first[-1] + grams[-1])
            several[doubt] = np.add.reduceat(order[at] == np.repeat(m[doubt], grams), first, dtype=np.int64) > 1
        return m.view(np.int64), mixed(whole ^ n.astype(U)).view(np.int64), start, n, several


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: block minima from the left and from the right."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def strips(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, which windows lie within one text, text of each byte, its place there) of texts laid end to end
    in strips of about ``STRIP`` bytes; longer texts are cut so that every window is whole in one strip."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), STRIP):
            cut = text[at : at + STRIP + length - 1]
            if len(cut) < length:
                continue
            if held and size + len(cut) > STRIP:
                yield laid(held, length)
                held, size = [], 0
            held.append((i, at, cut))
            size += len(cut)
    if held:
        yield laid(held, length)


def laid(held: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for _, _, c in held])
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(c for _, _, c in held), np.uint8)
    place = np.arange(len(text)) - np.repeat(first, sizes)
    valid = (place <= np.repeat(sizes - length, sizes))[: len(text) - length + 1]
    owner = np.repeat(np.array([i for i, _, _ in held]), sizes)
    return text, valid, owner, place + np.repeat(np.array([a for _, a, _ in held]), sizes)


def keyed(docs: DataFrame, length: int) -> DataFrame:
    """(id, text_key, text as bytes) of the rows that are long enough."""
    raw = F.col("text").cast("binary")
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), raw.alias("bytes"))
    return rows.where(F.octet_length("bytes") >= length).withColumn("text_key", F.unhex(F.md5("bytes")))


def gram_levels(docs: DataFrame, length: int) -> np.ndarray:
    """By how much each cell's k-grams are more frequent than chance gives: a sketch of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        finder, counts, seen, held = PieceFinder(length), np.zeros(1 << CELL_BITS, np.int64), set(), []
        for batch in batches:
            texts = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key not in seen:
                    seen.add(key)
                    texts.append(text.as_py())
            for text, *_ in strips(texts, length):
                held.append(finder.cells(text))
                if len(held) == 8:  # the table is larger than a strip
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held = []
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        if counts.any():
            small = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << BLOCK_BITS)
            found = [pa.array(range(len(small)), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())]
            yield pa.RecordBatch.from_arrays(found, ["block", "counts"])

    rows = keyed(docs, length).select("text_key", "bytes")
    return frequency_levels(rows.mapInArrow(run, "block int, counts binary"))


def pieces_of(docs: DataFrame, levels: np.ndarray, length: int) -> DataFrame:
    """The pieces of all texts (``PIECE``). A text that a task meets again and again counts twice: that is enough
    to know that it is repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # a byte per cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        finder, seen = PieceFinder(length, shared.value), {}
        for batch in batches:
            chosen, texts = [], []
            for i, (key, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                if seen.setdefault(key, 0) < 2:
                    seen[key] += 1
                    chosen.append(i)
                    texts.append(text.as_py())
            for text, valid, owner, place in strips(texts, length):
                m, h, start, n, several = finder.pieces(text, valid)
                rows = pa.array(np.array(chosen)[owner[start]])
                numbers = [pa.array(x) for x in (m, h)]
                spots = [pa.array(x, pa.int32()) for x in (place[start], n)]
                whose = [batch.column(c).take(rows) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*numbers, *whose, *spots, pa.array(several)], ["m", "h", "id", "text_key", "start", "n", "several"]
                )

    return keyed(docs, length).select("id", "text_key", "bytes").mapInArrow(run, PIECE)


def cut_out(docs: DataFrame, homes: DataFrame, length: int) -> DataFrame:
    """(m, h, large, bytes) of one copy of each piece in ``homes``."""
    lists = homes.groupBy("id", "text_key").agg(F.collect_list(F.struct("m", "h", "start", "n", "large")).alias("pieces"))
    texts = keyed(docs, length).join(lists, ["id", "text_key"]).dropDuplicates(["id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        for batch in batches:
            for text, pieces in zip(batch.column(0), batch.column(1)):
                text, pieces = text.as_py(), pieces.as_py()
                for i in range(0, len(pieces), 10_000):
                    some = pieces[i : i + 10_000]
                    cuts = [text[p["start"] : p["start"] + p["n"] + length - 1] for p in some]
                    columns = [
                        pa.array([p["m"] for p in some], pa.int64()), pa.array([p["h"] for p in some], pa.int64()),
                        pa.array([p["large"] for p in some], pa.bool_()), pa.array(cuts, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["m", "h", "large", "bytes"])

    return texts.select("bytes", "pieces").mapInArrow(run, "m bigint, h bigint, large boolean, bytes binary")


def compared(pieces: DataFrame, length: int) -> DataFrame:
    """(m, h, at, n): runs of ``n`` windows, from window ``at`` of the piece on, that occur elsewhere in pieces
    of the same k-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for m, h, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                if held and m != held[-1][0] and size >= BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
                if not held or (m, h) != held[-1][:2]:
                    held.append((m, h, text))
                    size += len(text)
        if held:
            yield block(held)

    def block(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(t) for _, _, t in held])
        first = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(held)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = repeated_windows(text, first[owner] + at, length)
        begins = hit & ~np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])])
        ends = hit & ~np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]])
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
        names = [pa.array([held[i][c] for i in owner[begin]], pa.int64()) for c in (0, 1)]
        spots = [pa.array(x, pa.int32()) for x in (at[begin], end - begin + 1)]
        return pa.RecordBatch.from_arrays([*names, *spots], ["m", "h", "at", "n"])

    pieces = pieces.repartition("m").sortWithinPartitions("m", "h")
    return pieces.select("m", "h", "bytes").mapInArrow(run, "m bigint, h bigint, at int, n int")


def counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same, window by window, from counts of the windows' hashes: for k-grams with more pieces than a
    task may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        finders = [PieceFinder(length), PieceFinder(length)]
        finders[1].table = finders[0].table[::-1].copy()
        for batch in batches:
            for m, h, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                for strip, valid, _, place in strips([text], length):
                    hashes = []
                    for finder in finders:
                        sums, inverses = finder.sums(strip)
                        hashes.append(mixed((sums[length:] - sums[:-length]) * inverses[: len(sums) - length]).view(np.int64))
                    whose = [pa.array(np.full(len(valid), x, np.int64)) for x in (m, h)]
                    at = pa.array(place[: len(valid)], pa.int32())
                    yield pa.RecordBatch.from_arrays([*whose, at, *map(pa.array, hashes)], ["m", "h", "at", "w1", "w2"])

    rows = pieces.dropDuplicates(["m", "h"]).select("m", "h", "bytes")
    rows = written(rows.mapInArrow(run, "m bigint, h bigint, at int, w1 bigint, w2 bigint"))
    names = ["m", "w1", "w2"]
    several = rows.groupBy(names).agg(F.count("*").alias("c")).where("c > 1").select(names)
    return rows.join(several, names).select("m", "h", "at", F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame, length: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(text_key, start, n): runs of repeated windows of every text that has any."""
    levels = gram_levels(docs, length)
    # only k-grams found in several places can have repeated windows
    places = pieces_of(docs, levels, length).groupBy("m").agg(F.count("*").alias("c"), F.max("several").alias("several"))
    shared = written(places.where("c > 1 OR several").select("m"))
    live = written(pieces_of(docs, levels, length).join(shared, "m", "left_semi"))
    home = F.min(F.struct("text_key", "id", "start")).alias("home")
    distinct = live.groupBy("m", "h").agg(F.count("*").alias("c"), F.max("several").alias("several"), F.max("n").alias("n"), home)
    distinct = written(distinct.select("m", "h", "c", "several", "n", "home.*"))
    twice = distinct.where("c > 1").select("m", "h")
    spans = live.join(twice, ["m", "h"], "left_semi").select("text_key", "start", "n")
    groups = distinct.groupBy("m").agg(
        F.count("*").alias("pieces"), F.max("several").alias("any"), F.min("c").alias("least"),
        F.sum(F.col("n").cast("bigint") + length - 1).alias("size"),
    )
    # a k-gram whose pieces are all repeated throughout has nothing left to find
    open_ = groups.where("least = 1 AND (pieces > 1 OR any)").select("m", (F.col("size") > group_bytes).alias("large"))
    homes = written(distinct.join(open_, "m").select("m", "h", "c", "n", "text_key", "id", "start", "large"))
    cuts = cut_out(docs, homes, length)
    found = compared(cuts.where("NOT large"), length)
    if not homes.where("large").isEmpty():
        found = found.union(counted(cuts.where("large"), length))
    single = homes.where("c = 1").select("m", "h", "text_key", "start")
    found = found.join(single, ["m", "h"]).select("text_key", (F.col("start") + F.col("at")).alias("start"), "n")
    return spans.union(found)


def without_repeats(docs: DataFrame, length: int = 200, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with ``removed``, the maximal runs of bytes (begin, end) covered by a string of ``length`` bytes
    that also starts elsewhere, and ``kept``, the remaining bytes. Columns of those names that are there
    already give their names up to an underscore."""
    if length < 64:
        raise ValueError("length must be at least 64 bytes")
    ship_package(docs.sparkSession)
    spans = repeated_spans(docs.select("doc_id", "text"), length, group_bytes)
    spans = written(spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    removed, kept, key, found = free_names(docs.columns, "removed", "kept", "text_key", "spans")
    size = F.octet_length("text")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<begin: BIGINT, end: BIGINT>>)")
    whole = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    short = docs.where((size < length) | size.isNull()).withColumns({removed: none, kept: whole})
    rows = docs.where(size >= length).withColumn(key, F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = rows.join(spans.select(F.col("text_key").alias(key), F.col("spans").alias(found)), key, "left").drop(key)
    return short.union(_taken_out(rows, docs, length, [found, removed, kept]))


def _taken_out(rows: DataFrame, docs: DataFrame, length: int, names: list[str]) -> DataFrame:
    found, removed, kept = names
    columns = docs.columns
    span = StructType([StructField("begin", LongType()), StructField("end", LongType())])
    schema = StructType([*docs.schema.fields, StructField(removed, ArrayType(span)), StructField(kept, BinaryType())])
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        for batch in batches:
            runs, left = [], []
            for text, spans in zip(batch.column(at), batch.column(len(columns))):
                text, spans = text.as_py().encode(), spans.as_py()
                if spans is None:
                    left.append(text)
                    runs.append([])
                    continue
                merged = merge(np.array([(s["start"], s["n"]) for s in spans], np.int64), length)
                edges = [0, *merged.ravel().tolist(), len(text)]
                left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                runs.append([{"begin": a, "end": b} for a, b in merged.tolist()])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            more = [pa.array(runs, kind), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *more], [*columns, removed, kept])

    return rows.select(*columns, found).mapInArrow(run, schema)


def merge(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal covered runs (begin, end) of runs of windows (start, count)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    begin, end = spans[:, 0], np.maximum.accumulate(spans[:, 0] + spans[:, 1] + length - 1)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.concatenate([new[1:], [True]])
    return np.stack([begin[new], end[last]], axis=1)


def removed_bytes(removed: Column) -> Column:
    return F.aggregate(removed, F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["begin"])
