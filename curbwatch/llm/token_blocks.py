"""Token-id output: documents packed into fixed-width id matrices, ready to read as binary.

Each task encodes its documents and packs them block by block (a block is a
bounded number of tokens), best fit decreasing: pieces in order of falling
length go to the open row with the least room that still holds them. A segment
tree over the possible amounts of room finds that row in O(log width). Texts
longer than a row are cut into full pieces and a rest, without loss.

A block needs nothing from another, so nothing is shuffled and a lost executor
costs its own blocks only; all rows but the last few of a block are nearly
full. Written as Parquet, a row group of ``ids`` is the id matrix.

Per row: ``ids`` (``width`` little-endian unsigned 32-bit ids, padded),
``n_tokens``, ``cu_seqlens`` (cumulative segment lengths from 0),
``position_ids`` (``width`` little-endian unsigned 16-bit positions, 0 again at
the first token of every segment and over the padding), ``doc_ids`` and
``starts`` (each segment's document and its first token there).

Defined cases: null or empty text is one end token; repeated rows are packed
each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ship_package
from .word_tokens import encoded_rows, read_definition

ROWS = (
    "part int, block int, row int, ids binary, n_tokens int, cu_seqlens array<int>, "
    "position_ids binary, doc_ids array<bigint>, starts array<bigint>"
)


class RoomTree:
    """Segment tree over the amounts of room 0..capacity: how many open rows have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.rows[room].pop()

    def _count(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.open[node] += change
            node >>= 1

    def least(self, length: int) -> int:
        """The least room >= ``length`` of an open row; -1 if there is none."""
        node = self.size + length
        while not self.open[node]:
            while node & 1:  # a right child: what lies right of it is up
                node >>= 1
                if node <= 1:
                    return -1
            node += 1
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_rows(lengths: list[int], width: int) -> list[list[int]]:
    """Indices of the pieces of each row, best fit decreasing (earlier pieces first among equals)."""
    tree, rows = RoomTree(width), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room < 0:
            row, room = len(rows), width
            rows.append([])
        else:
            row = tree.take(room)
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def packed_rows(pieces: list[tuple], width: int, pad_id: int) -> Iterator[dict]:
    """Matrix rows of (doc_id, start, ids) pieces."""
    for row, members in enumerate(best_fit_rows([len(p[2]) for p in pieces], width)):
        matrix, positions = np.full(width, pad_id, "<u4"), np.zeros(width, "<u2")
        ends = np.cumsum([0, *(len(pieces[i][2]) for i in members)]).tolist()
        for i, at, end in zip(members, ends, ends[1:]):
            matrix[at:end] = pieces[i][2]
            positions[at:end] = np.arange(end - at)
        yield {
            "row": row,
            "ids": matrix.tobytes(),
            "n_tokens": ends[-1],
            "cu_seqlens": ends,
            "position_ids": positions.tobytes(),
            "doc_ids": [pieces[i][0] for i in members],
            "starts": [pieces[i][1] for i in members],
        }


def token_blocks(
    docs: DataFrame,
    tokenizer_path: str,
    width: int = 2048,
    end_id: int = 0,
    pad_id: int = 0,
    block_tokens: int = 1 << 21,
) -> DataFrame:
    """The packed rows of all documents; (part, block, row) names a row."""
    ship_package(docs.sparkSession)
    definition = read_definition(tokenizer_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, held, pieces = TaskContext.get().partitionId(), 0, 0, []

        def finished() -> Iterator[pd.DataFrame]:
            rows = list(packed_rows(pieces, width, pad_id))
            for first in range(0, len(rows), 256):
                yield pd.DataFrame(rows[first : first + 256]).assign(part=part, block=block)[columns]

        for doc_id, ids in encoded_rows(batches, definition, end_id):
            for start in range(0, len(ids), width):
                pieces.append((doc_id, start, ids[start : start + width]))
                held += len(pieces[-1][2])
                if held >= block_tokens:
                    yield from finished()
                    pieces, held, block = [], 0, block + 1
        yield from finished()

    columns = [c.split(" ")[0] for c in ROWS.split(", ")]
    return docs.select("doc_id", "text").mapInPandas(run, ROWS)
