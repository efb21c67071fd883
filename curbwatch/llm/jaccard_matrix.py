"""N-gram Jaccard join: a blocked sparse product of documents by word shingles.

The incidence matrix has a row per distinct shingle set (equal sets are one
*node*) and a column per shingle. Its product with itself counts overlaps; the
product is taken column block by column block (Spark's hash partitions of the
columns), partial counts are added up per pair, and a pair is dropped as soon
as the sizes say that its overlap cannot reach the threshold:

* columns are ordered, frequent ones last (a sketch of bounded size counts all
  shingles of all documents); of a row with n shingles only the first
  ``n - ceil(t n) + 1`` entries take part - any pair that links has a common
  entry among those;
* a pair's sizes must lie within a factor t, and its common entries, together
  with what lies behind the last of them (and behind the leading entries) in
  either row, must reach ``ceil(t (n1 + n2) / (1 + t))``.

What survives is counted exactly on the whole sets.

Groups of near copies would be quadratic, so the product does not run on all
entries at once. First each column is multiplied with a few of its entries only
(stars); the best star of every row, and then all stars that still lie between
two components, are counted exactly. Then the full product is taken between
entries of *different* components: inside a component no pair can change the
result. Those of its pairs go that by their signs (a bit per cell of the whole
set, the parity of its shingles there; more cells for larger sets) have too few in common, and of the others
again the best of every row are counted first, then all that still lie between
two components: a family's rows outside its component meet each of its members,
but most of them need one link only. Every link between different components is
found, so the components are those of all links.

Columns that the sketch finds frequent are salted where they are made
distinct, those with many entries are multiplied in blocks of columns that share
their least node (what two rows have in common there is counted at once, so a
pair is a row only if it may link, and an entry is sent once), large
stars are dealt over parts, and nothing but sketches, bitmaps (of fixed
size) and counters goes to the driver. Identity of shingles and sets is that of
64-bit hashes.

Defined cases: a text with fewer words than a shingle is one shingle, one
without words (or null) is a component of its own; copies get the component of
their set; a repeated doc_id is judged row by row; a null id never names a
component unless all its members' ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import drop_worker_tables, ship_package, written
from .components import components
from .shingles import ShingleHasher, mixed, set_key

CELL_BITS = 22  # cells of the frequency sketch
BLOCK_BITS = 16  # cells of a block of the sketch
NEED_BITS = 27  # bits of the bitmap of wanted rows
SALTS = 64
LEADERS = 6  # entries of a column that the others are compared with first
STAR = 256  # members that are compared with one copy of a star's centre
FREQUENT = 32  # entries from which a column counts as frequent
BLOCK_NODES, BLOCK_ENTRIES = 16384, 300_000  # of a part of a block of the product of frequent columns
CELL_ROWS = 1 << 17  # of whole cells that are multiplied at once
STRIPE = 1 << 20  # pairs of a block that are judged at once
SIGN_BITS = 1024  # of the sign of a set that has no more members
SIGNS = 1 << 20  # words of signs that are compared at once
NO_ID = -(1 << 63)


def distinct_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int | None, int | None, np.ndarray, bool]]:
    """(doc_id, node, members, whether the task sees the node for the first time) of every row. Arrow rows, as
    pandas makes numbers beside a null doubles, which do not hold 64-bit ids and keys."""
    drop_worker_tables()
    hasher, seen = ShingleHasher(words), set()
    for batch in batches:
        keys = batch.column("doc_id").to_pylist()
        for i, members in hasher.sets(batch.column("text").to_pylist()):
            node = set_key(members) if len(members) else None
            yield None if keys[i] is None else int(keys[i]), node, members, node is not None and node not in seen
            seen.add(node)


def arrow_rows(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows of the first few of the fields; the other fields are null."""
    given = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(given[i] if i < len(given) else [None] * len(rows), t) for i, t in enumerate(fields.values())]
    return pa.RecordBatch.from_arrays(arrays, list(fields))


def set_sign(members: np.ndarray) -> bytes:
    """Per cell the parity of the members in it. Two sets differ in at least as many members as their signs in bits.
    The cells are a power of two: eight a member for small sets, and never fewer than members, as a sign with
    fewer cells tells nothing of unlike sets."""
    n = len(members)
    bits = max(64, 1 << (max(min(8 * n, SIGN_BITS), n, 1) - 1).bit_length())
    cells = (members & np.uint64(bits - 1)).astype(np.int64)
    # cell k is bit k % 64 of word k // 64, so the halves of a sign fold onto each other
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def surveyed(docs: DataFrame, words: int) -> DataFrame:
    """A row (doc_id, n, node) per document, with the set's sign where a task sees the node for the first
    time, and each task's sketch in blocks."""

    fields = {
        "doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "sign": pa.binary(), "block": pa.int32(), "counts": pa.binary(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        rows, held, n_held = [], [], 0
        for key, node, members, fresh in distinct_sets(batches, words):
            rows.append((key, len(members), node, set_sign(members) if fresh else None))
            if fresh:
                held.append(members >> np.uint64(64 - CELL_BITS))
                n_held += len(members)
            if n_held > 1 << 21 or len(rows) >= 10_000:
                counts += np.bincount(np.concatenate([*held, np.empty(0, np.uint64)]).astype(np.int64), minlength=len(counts))
                yield arrow_rows(rows, fields)
                rows, held, n_held = [], [], 0
        counts += np.bincount(np.concatenate([*held, np.empty(0, np.uint64)]).astype(np.int64), minlength=len(counts))
        yield arrow_rows(rows, fields)
        if counts.any():
            small = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << BLOCK_BITS)
            yield arrow_rows([(None, None, None, None, block, x.tobytes()) for block, x in enumerate(small)], fields)

    schema = "doc_id bigint, n bigint, node bigint, sign binary, block int, counts binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frequency_levels(survey: DataFrame) -> np.ndarray:
    """Per cell 0, or by how many powers of two its count lies above what chance gives."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch["block"], batch["counts"]):
                part = np.frombuffer(raw, np.uint8)
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        yield pd.DataFrame({"block": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    blocks = survey.where("block is not null").select("block", "counts").repartition("block")
    counts = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for row in blocks.mapInPandas(add, "block int, counts binary").collect():  # a fixed number of blocks
        counts[row["block"]] = np.frombuffer(row["counts"], np.int64)
    counts = counts.ravel()
    mean = counts.mean()
    high = counts / (mean + 8 * mean**0.5 + 32)
    return np.where(high > 1, np.ceil(np.log2(np.maximum(high, 1)) + 1e-9), 0).astype(np.uint8)


def postings(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """The leading entries (h, node, n and position in one number, salt) of every node's row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(levels)  # a byte per cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, out, held = shared.value, [], 0
        for _, node, members, fresh in distinct_sets(batches, words):
            if not fresh:
                continue
            n = len(members)
            levels = level_of[(members >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            if levels.any():
                order = np.argsort(levels, kind="stable")
                members, levels = members[order], levels[order]
            k = n - -(-percent * n // 100) + 1
            salt = np.where(levels[:k] > 0, node % SALTS + 1, 0)
            out.append((members[:k], np.full(k, node), np.arange(k) | n << 32, salt))
            held += k
            if held >= 200_000:
                yield frame(out)
                out, held = [], 0
        if out:
            yield frame(out)

    def frame(parts: list[tuple]) -> pa.RecordBatch:
        h, node, spot, salt = (np.concatenate(x) for x in zip(*parts))
        columns = {"h": h.view(np.int64), "node": node, "spot": spot, "salt": salt.astype(np.int32)}
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, "h bigint, node bigint, spot bigint, salt int")


def shared_columns(entries: DataFrame) -> DataFrame:
    """Entries of columns with several nodes: (h, node, n, pos, salt)."""
    column = Window.partitionBy("h", "salt")
    entries = entries.select(
        "h", "node", F.shiftright("spot", 32).cast("int").alias("n"), F.expr("cast(spot & 4294967295 as int)").alias("pos"),
        "salt", F.min("node").over(column).alias("low"), F.max("node").over(column).alias("high"),
    )
    # salt stays: the rows are dealt by (h, salt) already, so making them distinct moves none
    return entries.where("salt > 0 OR low < high").drop("low", "high").distinct()


def required(a: str, b: str, percent: int) -> Column:
    """The least overlap of two sets of these sizes that links them."""
    return F.expr(f"-floor(-({percent} * (cast({a} as bigint) + {b})) / {100 + percent})")


def stars(entries: DataFrame, percent: int) -> DataFrame:
    """(node, centre, c): the product of every column with ``LEADERS`` of its entries only.

    The leaders of a column and size class are the first nodes by as many
    random orders, so a family of near copies meets in the same few members.
    ``c`` is the number of leading entries shared; kept are pairs that share as
    many as linked rows of one size must. What this leaves out is found by
    ``remaining_pairs``. Columns that are not frequent are sent once, for both
    the leaders and those compared with them.
    """
    entries = entries.withColumn("class", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int"))
    firsts = {f"l{r}": F.min(F.struct(F.xxhash64("node", F.lit(r)), "node")) for r in range(LEADERS)}
    every = F.array_distinct(F.array(*[f"{name}.node" for name in firsts])).alias("all")
    column = Window.partitionBy("h", "class")
    few = entries.where("salt = 0").repartition("h", "class")  # before the minima's structs are made
    few = few.select("node", "n", *(first.over(column).alias(name) for name, first in firsts.items()))
    hot = entries.where("salt > 0")
    leaders = hot.groupBy("h", "class").agg(*(first.alias(name) for name, first in firsts.items()))  # a row per task
    hot = hot.join(leaders.select("h", "class", every), ["h", "class"]).select("node", "n", "all")
    near = few.select("node", "n", every).union(hot).select("node", "n", F.explode("all").alias("centre"))
    shared = near.where("node != centre").groupBy("node", "centre").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    behind = F.ceil(F.expr(f"{percent} * cast(n as bigint) / 100")) - 1
    return shared.where(F.col("c") + behind >= required("n", "n", percent)).select("node", "centre", "c")


def best_of(pairs: DataFrame) -> DataFrame:
    """(node, centre): of each node's pairs that with most in common."""
    best = pairs.groupBy("node").agg(F.max(F.struct("c", "centre")).alias("b"))
    return best.select("node", F.col("b.centre").alias("centre"))


def between(pairs: DataFrame, tied: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ends = [tied.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")) for end in ("node", "centre")]
    pairs = pairs.join(ends[0], "node", "left").join(ends[1], "centre", "left")
    return pairs.where(F.coalesce("node_in", "node") != F.coalesce("centre_in", "centre")).select("node", "centre")


def remaining_pairs(entries: DataFrame, tied: DataFrame, percent: int, signs: DataFrame | None = None) -> DataFrame:
    """(node, centre, c) of all pairs in different components that may reach the threshold: the product of the
    columns that touch several components, bounded by the sizes and the signs (node, sign). ``c`` is the
    largest overlap that is possible, as a share of both sizes.

    Columns with few entries are multiplied by a join. What frequent columns
    have in common is counted in blocks (``block_products``): there the
    same pairs meet in column after column, and a row for each would be the
    square of a family's size times the length of its texts.
    """
    labels = tied.select("node", F.col("component").alias("label"))
    rows = entries.select("h", "node", "n", "pos", "salt").join(labels, "node", "left")
    rows = rows.withColumn("label", F.coalesce("label", "node"))
    facts = {"lo": F.min("label"), "hi": F.max("label"), "size": F.count("*"), "block": F.min("node")}
    cold, hot = rows.where("salt = 0").drop("salt"), rows.where("salt > 0").drop("salt")
    column = Window.partitionBy("h")
    cold = cold.select("*", *(fact.over(column).alias(name) for name, fact in facts.items())).where("lo < hi")
    several = hot.groupBy("h").agg(*(fact.alias(name) for name, fact in facts.items())).where("lo < hi")
    hot = hot.join(several.select("h", "size", "block"), "h")
    rows = cold.drop("lo", "hi").unionByName(hot).withColumn("block", F.when(F.col("size") > FREQUENT, F.col("block")))
    rows = written(rows)
    few = rows.where(F.col("size") <= FREQUENT)
    both = few.alias("l").join(few.alias("s"), F.expr("l.h = s.h AND l.label != s.label"))
    both = both.where("s.n < l.n OR (s.n = l.n AND s.node < l.node)").where(f"s.n * 100L >= {percent}L * l.n")
    pairs = both.groupBy(F.col("l.node").alias("node"), F.col("s.node").alias("centre")).agg(
        F.count("*").alias("c"),
        F.min(F.least(F.expr("l.n - l.pos"), F.expr("s.n - s.pos"))).alias("rest"),
        F.max("l.n").alias("large"),
        F.max("s.n").alias("small"),
        F.lit(None).cast("bigint").alias("most"),
    )
    if signs is None:  # equal ones tell nothing
        signs = entries.select("node").distinct().withColumn("sign", F.lit(bytes(SIGN_BITS // 8)))
    pairs = pairs.union(block_products(rows, signs, percent))
    least = (F.min(x).alias(x) for x in ("rest", "large", "small", "most"))
    pairs = pairs.groupBy("node", "centre").agg(F.sum("c").alias("c"), *least)
    # what lies behind the leading entries of the one that has more behind them
    behind = F.ceil(F.expr(f"{percent} * cast(large as bigint) / 100")) - 1
    reach = F.least(F.col("c") + F.least(F.col("rest") - 1, behind), "most")
    share = reach / (F.col("large") + F.col("small"))
    return pairs.where(reach >= required("large", "small", percent)).select("node", "centre", share.alias("c"))


def block_products(rows: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(node, centre, c, rest, large, small, most) of the pairs in different components that share frequent columns
    and may reach the threshold: c counts those columns, and what other columns can add is bounded by their number;
    ``most`` is the largest overlap that the signs of the whole sets leave possible.

    Columns are dealt into blocks by the least of their nodes (which are hashes), so those of one passage or
    family, which nearly the same nodes share, meet in one block and a pair is a row there once. An entry is sent
    to its column's block alone. Only blocks with very many nodes are cut, into cells of two parts of the nodes.
    """
    frequent = rows.where(F.col("size") > FREQUENT)
    parts = F.greatest(F.ceil(F.max("size") / BLOCK_NODES), F.ceil(F.count("*") / BLOCK_ENTRIES)).cast("int")
    entries = frequent.join(frequent.groupBy("block").agg(parts.alias("parts")), "block")
    entries = entries.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    entries = entries.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = ["block", "i", "j"]
    ends = F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")
    entries = entries.select("block", *ends, "own", "h", "node", "pos")
    facts = F.max("n").alias("n"), F.max("label").alias("label"), F.count("*").alias("held"), F.max("size").alias("size")
    nodes = rows.groupBy("node").agg(*facts).where(F.col("size") > FREQUENT).drop("size")
    nodes = signs.join(nodes, "node").dropDuplicates(["node"])
    nodes = entries.select(*cell, "own", "node").distinct().join(nodes, "node")
    none = {c: F.lit(0).cast("bigint").alias(c) for c in ("h", "n", "label", "held")}  # no nulls: they would make doubles
    entries = entries.select(*cell, "own", "h", "node", "pos", *(none[c] for c in ("n", "label", "held")), F.lit(b"").alias("sign"))
    nodes = nodes.select(
        *cell, "own", none["h"], "node", F.lit(-1).alias("pos"), F.col("n").cast("bigint").alias("n"), "label", "held", "sign"
    )
    dealt = entries.union(nodes).repartition(*cell).sortWithinPartitions(*cell)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_worker_tables()
        for cells in whole_cells(batches, cell):
            yield product_of_cells(cells, cell, percent)

    schema = "node bigint, centre bigint, c bigint, rest bigint, large bigint, small bigint, most bigint"
    return dealt.mapInPandas(multiply, schema)


def whole_cells(batches: Iterator[pd.DataFrame], cell: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell in runs of ``CELL_ROWS`` or somewhat more that end where a cell ends."""
    held, n_held, at = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[cell].to_numpy()
        other = np.flatnonzero((keys != keys[-1]).any(1))
        cut = other[-1] + 1 if len(other) else 0  # the last cell may go on in the next batch
        if cut or (at is not None and (keys[-1] != at).any()):
            held.append(batch.iloc[:cut])
            n_held += cut
            if n_held >= CELL_ROWS:
                yield pd.concat(held)
                held, n_held = [], 0
        held.append(batch.iloc[cut:])
        n_held += len(batch) - cut
        at = keys[-1]
    if held:
        yield pd.concat(held)


def run_ends(*keys: np.ndarray) -> np.ndarray:
    """Per place the end of its run of equal keys."""
    n = len(keys[0])
    last = np.ones(n, bool)
    last[:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    ends = np.flatnonzero(last) + 1
    return np.repeat(ends, np.diff(ends, prepend=0))


def product_of_cells(cells: pd.DataFrame, cell: list[str], percent: int) -> pd.DataFrame:
    """The pairs of whole cells that may reach the threshold. A row with ``pos`` below 0 tells a node's facts."""
    keys = [cells[c].to_numpy() for c in cell]
    same = keys[1] == keys[2]  # a cell of one part: each pair once, else those between its parts
    number = run_ends(*keys)
    column = {c: cells[c].to_numpy() for c in ("own", "h", "node", "pos", "n", "label", "held", "sign")}
    known = column["pos"] < 0
    names, node = np.unique(column["node"], return_inverse=True)
    place = number * len(names) + node  # of a node in a cell
    order = np.flatnonzero(known)[np.argsort(place[known], kind="stable")]
    at = np.searchsorted(place[order], place[~known])
    n, label, held, ids = (column[c][order] for c in ("n", "label", "held", "node"))
    signs = Signs(column["sign"][order])

    number, same, h, pos = (x[~known] for x in (number, same, column["h"], column["pos"].astype(np.int64)))
    side = ((column["own"] != keys[1])[~known] & ~same).astype(np.int8)
    tie = np.where(same, label[at], 0)  # entries of one component are not paired
    order = np.lexsort((tie, side, h, number))
    number, side, tie, h, at, pos = (x[order] for x in (number, side, tie, h, at, pos))
    others = held - np.bincount(at, minlength=len(held))  # entries of the node's row that are not in this cell
    left = n[at] - pos

    found = [(np.empty(0, np.int64),) * 3]  # place of the pair, how many columns, least rest
    waiting = 0
    if len(at):
        first = run_ends(number, h, side, tie)
        for x, y in ranged_pairs(first, run_ends(number, h) - first, STRIPE):
            a, b = at[x], at[y]
            need = least_overlap(n[a], n[b], percent)
            rest = np.minimum(left[x], left[y])
            fit = (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b])) & (label[a] != label[b])
            # what is shared lies before the entry in both rows, or from it on
            fit &= np.minimum(pos[x], pos[y]) + rest >= need
            a, b, need, rest = a[fit], b[fit], need[fit], rest[fit]
            fit = signs.most(a, b, n) >= need
            found.append((a[fit] * len(n) + b[fit], np.ones(fit.sum(), np.int64), rest[fit]))
            waiting += fit.sum()
            if waiting > STRIPE:
                found = [summed_pairs(found)]
                waiting = 0
    pair, c, rest = summed_pairs(found)
    a, b = pair // max(len(n), 1), pair % max(len(n), 1)
    large, small = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
    behind = -(-percent * large // 100) - 1
    fit = c + np.minimum(others[a], others[b]) + np.minimum(rest - 1, behind) >= least_overlap(large, small, percent)
    a, b, c, rest, large, small = (v[fit] for v in (a, b, c, rest, large, small))
    turned = (n[a] > n[b]) | ((n[a] == n[b]) & (ids[a] > ids[b]))
    out = {"node": np.where(turned, ids[a], ids[b]), "centre": np.where(turned, ids[b], ids[a]), "c": c, "rest": rest}
    return pd.DataFrame({**out, "large": large, "small": small, "most": signs.most(a, b, n)})


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """``required`` in numpy."""
    return -(-percent * (a + b) // (100 + percent))


def summed_pairs(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, count, least rest) of every pair once."""
    pair, c, rest = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(pair, kind="stable")
    pair, c, rest = pair[order], c[order], rest[order]
    first = np.flatnonzero(np.diff(pair, prepend=pair[:1] - 1))
    if not len(first):
        return pair, c, rest
    return pair[first], np.add.reduceat(c, first), np.minimum.reduceat(rest, first)


class Signs:
    """Signs of several lengths; two of different lengths are compared at the shorter one."""

    def __init__(self, signs: np.ndarray):
        self.words = np.array([len(x) // 8 for x in signs], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: signs, place of each
        for words in sorted({*self.words.tolist()}, reverse=True):
            own = np.flatnonzero(self.words == words)
            table = np.frombuffer(b"".join(signs[own]), np.uint64).reshape(-1, words)
            for longer, (above, where) in [*self.tables.items()]:
                if longer == 2 * words:  # sizes in reach of each other have signs of one length or of double
                    held = np.flatnonzero(where >= 0)
                    own, table = np.concatenate([own, held]), np.concatenate([table, folded(above[where[held]])])
            at = np.full(len(signs), -1)
            at[own] = np.arange(len(own))
            self.tables[words] = table, at

    def most(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The largest overlap of the sets a and b (of n members) that their signs leave possible."""
        differ, words = np.zeros(len(a), np.int64), np.minimum(self.words[a], self.words[b])
        for w, (table, at) in self.tables.items():
            which = np.flatnonzero((words == w) & (at[a] >= 0) & (at[b] >= 0))
            step = max(1, SIGNS // w)
            for k in range(0, len(which), step):
                part = which[k : k + step]
                differ[part] = np.bitwise_count(table[at[a[part]]] ^ table[at[b[part]]]).sum(1, np.int64)
        return (n[a] + n[b] - differ) // 2


def folded(signs: np.ndarray) -> np.ndarray:
    """Signs of half the length: a cell's parity is that of the two that fall on it."""
    half = signs.shape[1] // 2
    return signs[:, :half] ^ signs[:, half:]


def common_pairs(a: np.ndarray, b: np.ndarray, many: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (place in a, place in b) of equal values of two sorted arrays, about ``many`` at a time: a value may
    stand in both very often, so what is cut are the places in ``a``."""
    first = np.searchsorted(b, a)
    yield from ranged_pairs(first, np.searchsorted(b, a, "right") - first, many)


def ranged_pairs(first: np.ndarray, sizes: np.ndarray, many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (place, one of the ``sizes`` numbers from its ``first`` on), about ``many`` at a time."""
    places = np.flatnonzero(sizes)
    first, sizes = first[places], sizes[places]
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(places):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + many, "right")))
        n = sizes[lo:hi]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(places[lo:hi], n), np.repeat(first[lo:hi], n) + inner
        lo = hi


def bitmap(spark: SparkSession, cells: DataFrame) -> np.ndarray:
    """A bit per value of the column ``cell`` (below 2**NEED_BITS), of fixed size."""
    width = NEED_BITS - 8

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch["cell"].to_numpy()
            for block in np.unique(cells >> width):
                bits = blocks.setdefault(int(block), np.zeros(1 << width, bool))
                bits[cells[cells >> width == block] & ((1 << width) - 1)] = True
            # one block at a time in a partition sorted by block, so memory stays small
            for block in sorted(blocks)[:-1]:
                yield packed(block, blocks.pop(block))
        for block, bits in blocks.items():
            yield packed(block, bits)

    def packed(block: int, bits: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"block": [block], "bits": [np.packbits(bits).tobytes()]})

    cells = cells.distinct().withColumn("block", F.shiftright("cell", width)).repartition("block")
    out = np.zeros(1 << (NEED_BITS - 3), np.uint8)
    size = 1 << (width - 3)
    for row in cells.sortWithinPartitions("block").mapInPandas(mark, "block int, bits binary").collect():  # 256 blocks
        out[row["block"] * size : (row["block"] + 1) * size] |= np.frombuffer(row["bits"], np.uint8)
    return out


def row_cell(doc_id: int, node: int) -> int:
    """The bitmap cell of a row."""
    key = np.array([doc_id & (1 << 64) - 1, node & (1 << 64) - 1], np.uint64)
    return int(mixed(mixed(key[:1]) ^ key[1:])[0] >> np.uint64(64 - NEED_BITS))


def id_cells(doc_id: np.ndarray) -> np.ndarray:
    """The bitmap cells of ids alone, by which texts are left out before they are hashed."""
    return (mixed(mixed(doc_id.view(np.uint64)) ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - NEED_BITS)).astype(np.int64)


def marked_ids(batch: pa.RecordBatch, at: int, no_id: int, bits: np.ndarray) -> np.ndarray:
    """Whether the cells of the ids in column ``at`` are marked."""
    ids = pc.fill_null(batch.column(at).cast(pa.int64()), pa.scalar(no_id, pa.int64()))
    cells = id_cells(ids.to_numpy(zero_copy_only=False).astype(np.int64))
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


def wanted_sets(docs: DataFrame, survey: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, members) of the given nodes, from one document of each, and of a few others (the bitmap's)."""
    doc_id = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")
    chosen = survey.where("node is not null").join(nodes, "node").groupBy("node").agg(F.min(doc_id).alias("doc_id"))

    chosen = written(chosen)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(spark, chosen.mapInPandas(cells_of, "cell bigint")))  # fixed size

    fields = {"doc_id": pa.int64(), "node": pa.int64(), "members": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, rows, held, sent = shared.value, [], 0, set()
        likely = (b.filter(pa.array(marked_ids(b, 0, NO_ID, bits))) for b in batches)
        for key, node, members, _ in distinct_sets(likely, words):
            key = NO_ID if key is None else key
            if node is None or (key, node) in sent:
                continue
            cell = row_cell(key, node)
            if bits[cell >> 3] >> (7 - (cell & 7)) & 1:
                sent.add((key, node))
                rows.append((key, node, members.tobytes()))
                held += len(members)
            if held > 1 << 19:
                yield arrow_rows(rows, fields)
                rows, held = [], 0
        if rows:
            yield arrow_rows(rows, fields)

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, node bigint, members binary")
    # rows of one node hold the same set; what is not wanted goes in the next join, which is by node too
    return found.select("node", "members").dropDuplicates(["node"])


def linked(docs: DataFrame, survey: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (node, centre) that really link, counted on their whole sets."""
    ends = F.least("node", "centre").alias("lo"), F.greatest("node", "centre").alias("hi")
    pairs = pairs.groupBy(*ends).agg(F.max("centre").alias("centre"))  # one that stands both ways once
    pairs = written(pairs.select(F.expr("lo ^ hi ^ centre").alias("node"), "centre"))
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("members"))
    # a star's members are dealt over parts; each part gets a copy of the centre's set
    parts = F.ceil(F.col("members") / STAR).cast("int").alias("parts")
    sized = pairs.join(sizes.select("centre", parts), "centre")
    sized = sized.select("node", "centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    copies = sizes.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    nodes = pairs.select("node").union(pairs.select("centre")).distinct()
    sets = wanted_sets(docs, survey, nodes, words)
    rows = sized.union(copies).join(sets, "node").withColumn("member", F.col("node") != F.col("centre"))
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "member")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, centre = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for node, name, part, raw, member in zip(*(batch[c] for c in ("node", "centre", "part", "members", "member"))):
                members = np.frombuffer(raw, np.uint64)
                if not member:
                    at, centre = (name, part), members
                elif at == (name, part):
                    common = len(np.intersect1d(centre, members, assume_unique=True))
                    if 100 * common >= percent * (len(centre) + len(members) - common):
                        out.append((node, name))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.mapInPandas(compare, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return named(shingle_classes(docs, words, percent))


def shingle_classes(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n, node, class) of every row: its set's size and key, and the key of
    its component (null without words)."""
    ship_package(docs.sparkSession)
    survey = written(surveyed(docs, words))
    rows = survey.where("block is null")
    levels = frequency_levels(survey)
    entries = written(shared_columns(postings(docs, levels, words, percent)))
    pairs = written(stars(entries, percent))
    links = written(linked(docs, rows, best_of(pairs), words, percent))
    links = written(links.union(linked(docs, rows, between(pairs, components(links)), words, percent)))
    signs = survey.where("sign is not null").select("node", "sign")
    rest = written(remaining_pairs(entries, components(links), percent, signs))
    ends = rest.union(rest.select("centre", "node", "c"))
    links = written(links.union(linked(docs, rows, best_of(ends), words, percent)))
    tied = components(links.union(linked(docs, rows, between(rest, components(links)), words, percent)))
    return rows.join(tied, "node", "left").select("doc_id", "n", "node", F.coalesce("component", "node").alias("class"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of every component, that of the smallest doc_id;
    rows without words all stay.

    Texts are not shuffled for it: a bitmap of fixed size tells the rows that
    are alone in their component for sure; only the others are joined with the
    rows to keep.
    """
    last = F.lit((1 << 63) - 1)
    classes = written(shingle_classes(docs, words, percent).where("class is not null"))
    rows = classes.select("class", F.struct(F.coalesce("doc_id", last).alias("doc_id"), "node").alias("row"))
    groups = written(rows.groupBy("class").agg(F.min("row").alias("first"), F.count("*").alias("size")))
    spark = docs.sparkSession
    several = rows.join(groups.where("size > 1").select("class"), "class").select("row.*")
    shared = spark.sparkContext.broadcast(bitmap(spark, several.mapInPandas(cells_of, "cell bigint")))  # fixed size
    node, doubt = free_names(docs.columns, "node", "doubt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits, no_id = ShingleHasher(words), shared.value, (1 << 63) - 1
        for batch in batches:
            nodes, doubts = [None] * batch.num_rows, [False] * batch.num_rows
            keys = batch.column(id_at).to_pylist()
            likely = np.flatnonzero(marked_ids(batch, id_at, no_id, bits))
            for k, members in hasher.sets(batch.column(text_at).take(pa.array(likely)).to_pylist()):
                if len(members):
                    i, node_key = int(likely[k]), set_key(members)
                    cell = row_cell(no_id if keys[i] is None else int(keys[i]), node_key)
                    nodes[i], doubts[i] = node_key, bool(bits[cell >> 3] >> (7 - (cell & 7)) & 1)
            more = [pa.array(nodes, pa.int64()), pa.array(doubts, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, node, doubt])

    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(node, LongType()), StructField(doubt, BooleanType())])
    marked = docs.mapInArrow(run, schema)
    keep_id, keep_node = free_names([*docs.columns, node, doubt], "keep_id", "keep_node")
    keys = groups.select(F.col("first.doc_id").alias(keep_id), F.col("first.node").alias(keep_node))
    same = (F.coalesce(F.col("doc_id"), last) == F.col(keep_id)) & (F.col(node) == F.col(keep_node))
    kept = marked.where(F.col(doubt)).join(keys, same, "left_semi").dropDuplicates(["doc_id", node])
    return marked.where(~F.col(doubt)).union(kept).drop(node, doubt)


def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bitmap cells of (doc_id, node) rows, and those of their ids alone."""
    for b in batches:
        key, node = (b[c].to_numpy(np.int64).view(np.uint64) for c in ("doc_id", "node"))
        rows = (mixed(mixed(key) ^ node) >> np.uint64(64 - NEED_BITS)).astype(np.int64)
        yield pd.DataFrame({"cell": np.concatenate([rows, id_cells(key)])})


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has already."""
    lower = {t.lower() for t in taken}
    out = []
    for name in names:
        while name in lower:
            name = f"_{name}"
        out.append(name)
    return out


def named(rows: DataFrame) -> DataFrame:
    """Each class of rows gets its smallest doc_id; rows without a class their own."""
    names = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    rows = rows.join(names, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
