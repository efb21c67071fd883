"""Nearest neighbours by a forest of random-projection trees.

Every tree splits by one random direction per level (the directions of a tree
are orthonormal), at the median of a bounded sample in each node. A query
searches all trees at once: one priority queue holds the open nodes of the
whole forest, ordered by the sum of squared distances to the splits crossed so
far, and leaves are taken from it until ``share`` of the forest's leaves is
reached. The candidates in those leaves are compared exactly, by cosine in
double precision on the original vectors.

Equal vectors are one entry of the index (their ``k + 1`` smallest ids are
kept, which decides every answer), so a vector that a third of all rows have
costs one entry. Leaves larger than ``block`` rows, and leaves asked for by
more than ``block`` queries, are dealt over a grid of tasks. The sample and the
forest are of bounded size; every row is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of each length have a
forest of their own and are compared with each other only (the number of
lengths is taken to be small); repeated rows count once; ties go to the smaller
id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, written


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        """``sample``: unit vectors. Node 1 is a tree's root, node n has the children 2n and 2n + 1."""
        rng = np.random.default_rng(seed)
        self.depth, self.leaves, dim = depth, 1 << depth, sample.shape[1]
        self.directions, self.splits, self.lists = [], [], None
        for _ in range(trees):
            # more levels than dimensions: further sets of orthonormal directions
            sets = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-depth // dim))]
            directions = np.concatenate([*sets, np.empty((dim, 0))], axis=1)[:, :depth]
            split, node, at = np.zeros(1 << depth), np.ones(len(sample), np.int64), sample @ directions
            for level in range(depth):
                for n in range(1 << level, 2 << level):
                    if (inside := at[node == n, level]).size:
                        split[n] = np.median(inside)
                node = 2 * node + (at[:, level] > split[node])
            self.directions.append(directions)
            self.splits.append(split)

    def bins(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each vector in each tree, numbered over the forest."""
        out = np.empty((len(unit), len(self.splits)), np.int64)
        for t, (directions, split) in enumerate(zip(self.directions, self.splits)):
            node, at = np.ones(len(unit), np.int64), unit @ directions
            for level in range(self.depth):
                node = 2 * node + (at[:, level] > split[node])
            out[:, t] = node - self.leaves + t * self.leaves
        return out

    def search(self, unit: np.ndarray, leaves: int) -> list[int]:
        """The bins of the ``leaves`` most promising leaves of all trees, by one shared queue."""
        at = [(unit @ d).tolist() for d in self.directions]
        if self.lists is None:
            self.lists = [s.tolist() for s in self.splits]
        splits = self.lists
        queue = [(0.0, t, 1) for t in range(len(splits))]
        found: list[int] = []
        while queue and len(found) < leaves:
            cost, t, node = heapq.heappop(queue)
            while node < self.leaves:
                margin = at[t][node.bit_length() - 1] - splits[t][node]
                near = 2 * node + int(margin > 0)
                heapq.heappush(queue, (cost + margin * margin, t, near ^ 1))
                node = near
            found.append(node - self.leaves + t * self.leaves)
        return found


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, the same of length one)."""
    v = np.stack([np.asarray(x, np.float64) for x in vectors]) if len(vectors) else np.empty((0, 1))
    scaled = v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
    return v, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(queries, rows) in double precision, each pair summed alike wherever it stands."""
    norms = np.sqrt(np.einsum("qd,qd->q", queries, queries))[:, None] * np.sqrt(np.einsum("xd,xd->x", rows, rows))
    return np.einsum("qd,xd->qx", queries, rows) / norms


def deal(bins: np.ndarray, own: np.ndarray, copies: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries in ``bins``: (entry, own block, other side's block), a copy for each of the latter."""
    block = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % own[bins]
    many = copies[bins]
    entry = np.repeat(np.arange(len(bins)), many)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    return entry, block[entry], other


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    trees: int = 6,
    share: float = 0.25,
    leaf_rows: int = 1024,
    sample_rows: int = 16384,
    block: int = 4096,
    seed: int = 3,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of every row that ``is_query`` selects.

    ``vectors``: vec_id and embedding. ``sample_rows`` bounds the sample the
    splits are fitted on and, with at least 16 sample rows a leaf, the depth.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", is_query.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.max("asked").alias("asked")).collect()  # one per length
    for d in sorted(r["d"] for r in lengths if r["asked"]):
        same = rows.where(F.size("embedding") == d)
        out = out.union(_nearest(same, k, trees, share, leaf_rows, sample_rows, block, seed))
    return out


def _nearest(
    rows: DataFrame, k: int, trees: int, share: float, leaf_rows: int, sample_rows: int, block: int, seed: int
) -> DataFrame:
    """``nearest`` among usable rows (vec_id, embedding, asked) of one vector length."""
    spark = rows.sparkSession
    # entries: distinct vectors with their k + 1 smallest ids (row_number <= n is cut down before the shuffle);
    # repeated rows go first, or they would take the places of other ids
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.select("vec_id", "embedding").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    entries = written(entries.withColumn("key", F.monotonically_increasing_id()))
    n = entries.count()

    chance = min(1.0, 2.0 * sample_rows / n)
    mix = F.xxhash64("key", F.lit(seed))
    sample = entries.where(F.pmod(mix, F.lit(1 << 20)) < int(chance * (1 << 20)) + 1).orderBy(mix).limit(sample_rows)
    sample = units(sample.select("embedding").toPandas()["embedding"])[1]
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf_rows)))), int(np.log2(max(1, len(sample) / 16)))))
    forest = Forest(sample, trees, depth, seed)
    n_bins, probes = trees * forest.leaves, max(trees, int(np.ceil(share * trees * forest.leaves)))

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = forest.bins(units(batch["embedding"])[1])
            yield pd.DataFrame({"bin": found.ravel()})

    def to_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [forest.search(u, probes) for u in units(batch["embedding"])[1]]
            yield pd.DataFrame({"key": batch["key"], "bins": found})

    # queries by entry; the vectors themselves are joined once
    asked = rows.where("asked").select("vec_id", "embedding").distinct()
    asked = asked.join(entries.select("embedding", "key"), "embedding").select("vec_id", "key")
    asked = written(asked)
    targets = entries.join(asked.select("key").distinct(), "key").select("key", "embedding")
    targets = written(targets.join(targets.mapInPandas(to_probes, "key bigint, bins array<bigint>"), "key"))
    held, wanted = np.zeros(n_bins, np.int64), np.zeros(n_bins, np.int64)
    for r in entries.select("embedding").mapInPandas(to_bins, "bin bigint").groupBy("bin").count().collect():
        held[r["bin"]] = r["count"]  # at most one row per bin
    for r in targets.select(F.explode("bins").alias("bin")).groupBy("bin").count().collect():
        wanted[r["bin"]] = r["count"]
    row_blocks, query_blocks = -(-held // block), -(-wanted // block)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v, unit = units(batch["embedding"])
            bins, keys = forest.bins(unit), batch["key"].to_numpy()
            lows = np.array([x[0] for x in batch["ids"]], np.int64)
            for t in range(trees):
                entry, i, j = deal(bins[:, t], row_blocks, query_blocks, keys)
                yield pd.DataFrame(
                    {
                        "bin": bins[entry, t], "i": i, "j": j, "key": keys[entry], "low": lows[entry],
                        "vector": [v[e].tobytes() for e in entry],
                    }
                )

    def query_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v, keys = units(batch["embedding"])[0], batch["key"].to_numpy()
            for row, bins in enumerate(batch["bins"]):
                bins = np.asarray(bins, np.int64)
                entry, j, i = deal(bins, query_blocks, row_blocks, np.full(len(bins), keys[row]))
                yield pd.DataFrame({"bin": bins[entry], "i": i, "j": j, "key": keys[row], "vector": v[row].tobytes()})

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = np.frombuffer(b"".join(left["vector"]), np.float64).reshape(len(left), -1) if len(left) else None
        keys, lows = left["key"].to_numpy(), left["low"].to_numpy()
        for first in range(0, len(right) if len(left) else 0, 256):
            some = right.iloc[first : first + 256]
            score = cosines(np.frombuffer(b"".join(some["vector"]), np.float64).reshape(len(some), -1), x)
            for query, s in zip(some["key"], score):
                best = np.lexsort((lows, -s))[: k + 1] if len(s) <= 4 * k else top_places(s, lows, k + 1)
                out.append(pd.DataFrame({"query": query, "key": keys[best], "low": lows[best], "score": s[best]}))
        empty = pd.DataFrame({"query": [], "key": [], "low": [], "score": []})
        return pd.concat(out) if out else empty

    left = entries.mapInPandas(index_rows, "bin bigint, i bigint, j bigint, key bigint, low bigint, vector binary")
    right = targets.mapInPandas(query_rows, "bin bigint, i bigint, j bigint, key bigint, vector binary")
    cells = left.groupBy("bin", "i", "j").cogroup(right.groupBy("bin", "i", "j"))
    found = cells.applyInPandas(compare, "query bigint, key bigint, low bigint, score double")
    found = found.groupBy("query", "key").agg(F.max("score").alias("score"), F.min("low").alias("low"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # the entries' ids in order of score and id; an answer drops the query's own
    found = found.join(entries.select("key", "ids"), "key").select("query", (-F.col("score")).alias("s"), F.explode("ids").alias("id"))
    answers = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("s", "id"))).alias("near"))
    others = F.filter("near", lambda x: x["id"] != F.col("vec_id"))
    ranked = asked.join(answers, asked["key"] == answers["query"]).select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "hit")
    )
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )


def top_places(score: np.ndarray, lows: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best scores, ties by ``lows``."""
    least = np.partition(score, len(score) - n)[len(score) - n]
    some = np.flatnonzero(score >= least)
    return some[np.lexsort((lows[some], -score[some]))][:n]
