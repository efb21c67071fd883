"""Vector code compression: product codes, nearest entries by slice-and-intersect bitmasks.

A vector's components become integers ``floor(scale * x)``; it is cut into
``parts`` equal parts, and each part is written as the index of its nearest
entry in that part's codebook of at most 64 entries.

The nearest entry is found exactly (``SliceIndex``): per dimension the entries'
coordinates are sorted, and prefix masks tell which entries (bits of a uint64)
stand before each place. A radius selects a range of each dimension, whose mask
is the exclusive or of two prefix masks; the masks of all dimensions, ANDed,
are the entries in the box around the point. Those candidates are measured. If
the best lies within the radius nothing outside the box can be nearer;
otherwise the point is asked again with the best distance (or, without
candidates, twice the radius).

Codebooks start as the parts of the rows of smallest id and are improved by
rounds of assignment and floored means. A round is one map whose tasks send
sums per entry (their number is fixed by the codebooks, not by the rows), so
hot labels or ids cost nothing; only codebooks reach the driver.

Defined cases: vectors that are null or hold null or non-finite components take
no part (``usable``); an empty vector has 16 empty parts, all at distance 0 of
entry 0; vectors of another length have codebooks of their own (the number of
lengths is taken to be small); a length that is no multiple of ``parts`` is
filled up with zeros; rows that repeat an id, or have none (they come last),
count each, in order of their vectors; with fewer rows than entries a codebook
has fewer entries; components so large that squared distances would not fit 57
bits raise an error. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import drop_worker_tables, ship_package
from .jaccard_matrix import free_names

U = np.uint64
Books = dict[int, np.ndarray]  # by vector length: (parts, entries, width) integers


class SliceIndex:
    """Exact nearest entry of integer points among at most 64 entries (a row each)."""

    def __init__(self, entries: np.ndarray):
        n, width = entries.shape
        if not 0 < n <= 64:
            raise ValueError("a mask holds 1 to 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.sort(entries, axis=0).T.copy()
        bits = U(1) << order.astype(U)
        self.masks = np.concatenate([np.zeros((width, 1), U), np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        # the radius to begin with: half the usual distance of an entry from the others
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
        apart[apart == 0] = np.inf
        nearest = apart.min(axis=1)
        nearest = nearest[np.isfinite(nearest)]
        self.radius = max(1, int(np.sqrt(np.median(nearest)) / 2)) if len(nearest) else 1

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A mask per point: the entries that lie within ``radius`` of it in every dimension."""
        found = np.full(len(points), (1 << len(self.entries)) - 1, U)
        for d, values in enumerate(self.sorted):
            low = np.searchsorted(values, points[:, d] - radius, side="left")
            high = np.searchsorted(values, points[:, d] + radius, side="right")
            found &= self.masks[d][high] ^ self.masks[d][low]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, ties to the smaller index."""
        best = np.zeros(len(points), np.int64)  # distance and, in the low 6 bits, index
        open_, radius = np.arange(len(points)), np.full(len(points), self.radius, np.int64)
        while len(open_):
            masks = self.candidates(points[open_], radius)
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            gap = points[open_[row]] - self.entries[entry]
            key = np.einsum("pd,pd->p", gap, gap) << 6 | entry
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            hit = row[starts]
            least = np.full(len(open_), -1, np.int64)
            if len(starts):
                least[hit] = np.minimum.reduceat(key, starts)
            sure = (least >= 0) & (least >> 6 <= radius * radius)
            best[open_[sure]] = least[sure]
            some = ~sure
            reach = np.sqrt(np.maximum(least[some] >> 6, 0)).astype(np.int64) + 1
            radius = np.where(least[some] >= 0, reach, 2 * radius[some])
            open_ = open_[some]
        return best & 63, best >> 6


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def cut(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, width) integers of vectors of one length."""
    n, length = vectors.shape
    width = -(-length // parts)
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and width * (2 * max(1.0, float(np.abs(scaled).max()))) ** 2 >= 2.0**57:
        raise ValueError("components are too large for exact squared distances in 57 bits")
    out = np.zeros((n, parts * width), np.int64)
    out[:, :length] = scaled
    return out.reshape(n, parts, width)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) for each length among the lists of ``column``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, values[(first[rows][:, None] + np.arange(length)).astype(np.int64)]


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> Books:
    """The parts of the ``entries`` rows of smallest id, for each vector length."""
    order = Window.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    rows = vectors.select("vec_id", "embedding", F.size("embedding").alias("length"))
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    found: dict[int, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["length"], r["place"])):  # a codebook's worth per length
        found.setdefault(r["length"], []).append(r["embedding"])
    return {n: cut(np.array(v, np.float64).reshape(len(v), n), parts, scale).transpose(1, 0, 2) for n, v in found.items()}


def assigned(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes by part, squared distances by part) of cut vectors."""
    found = [SliceIndex(entries).nearest(points[:, p]) for p, entries in enumerate(book)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def improved(vectors: DataFrame, books: Books, parts: int, scale: int) -> Books:
    """The codebooks after one round: every entry becomes the floored mean of the parts assigned to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # 64 entries a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        books = shared.value
        sums = {n: np.zeros(b.shape, np.int64) for n, b in books.items()}
        counts = {n: np.zeros(b.shape[:2], np.int64) for n, b in books.items()}
        for batch in batches:
            for n, _, values in by_length(batch.column(0)):
                points = cut(values, parts, scale)
                codes, _ = assigned(points, books[n])
                for p in range(parts):
                    np.add.at(sums[n][p], codes[:, p], points[:, p])
                    counts[n][p] += np.bincount(codes[:, p], minlength=counts[n].shape[1])
        for n in books:
            part, entry = np.nonzero(counts[n])
            for axis in range(-1, books[n].shape[2]):  # place -1: the number of parts
                total = counts[n][part, entry] if axis < 0 else sums[n][part, entry, axis]
                spot = [pa.array(x, pa.int32()) for x in (np.full(len(part), n), part, entry, np.full(len(part), axis))]
                yield pa.RecordBatch.from_arrays([*spot, pa.array(total)], ["length", "part", "entry", "place", "total"])

    rows = vectors.select("embedding").mapInArrow(run, "length int, part int, entry int, place int, total bigint")
    rows = rows.groupBy("length", "part", "entry", "place").agg(F.sum("total").alias("total")).collect()  # of fixed number
    counts = {(r["length"], r["part"], r["entry"]): r["total"] for r in rows if r["place"] < 0}
    out = {n: b.copy() for n, b in books.items()}
    for r in rows:
        if r["place"] >= 0:
            spot = (r["part"], r["entry"])
            out[r["length"]][(*spot, r["place"])] = r["total"] // counts[(r["length"], *spot)]
    return out


def train_codebooks(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> Books:
    """Codebooks by vector length, trained on all usable rows of ``vectors`` (vec_id, embedding)."""
    ship_package(vectors.sparkSession)
    rows = vectors.where(usable(F.col("embedding")))
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = improved(rows, books, parts, scale)
    return books


def encode_vectors(vectors: DataFrame, books: Books, parts: int = 16, scale: int = 256) -> DataFrame:
    """The usable rows of ``vectors`` with their ``code`` (a byte per part), ``error`` (squared distances
    summed over parts) and ``codebooks`` (name of the codebooks of their length). Columns of those names
    that are there already give their names up to an underscore."""
    ship_package(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    names = free_names(vectors.columns, "code", "error", "codebooks")
    at = vectors.columns.index("embedding")
    digests = {n: books_digest(b) for n, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        for batch in batches:
            codes = np.zeros((batch.num_rows, parts), np.uint8)
            errors, named = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for n, rows, values in by_length(batch.column(at)):
                found, gaps = assigned(cut(values, parts, scale), shared.value[n])
                codes[rows], errors[rows] = found, gaps.sum(axis=1)
                for r in rows:
                    named[r] = digests[n]
            more = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(named, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    kinds = (BinaryType(), LongType(), StringType())
    schema = StructType([*vectors.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds))])
    return vectors.where(usable(F.col("embedding"))).mapInArrow(run, schema)


def books_digest(book: np.ndarray) -> str:
    """SHA-256 of all components as decimal text, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def decoded(code: bytes, book: np.ndarray, scale: int = 256) -> np.ndarray:
    """The vector that a code stands for: the middle of each component's integer step."""
    return (np.concatenate([book[p, c] for p, c in enumerate(code)]) + 0.5) / scale
