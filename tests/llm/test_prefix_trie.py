import hashlib
import random
import zlib

from pyspark.sql import functions as F

from curbwatch.llm.prefix_trie import joined_ids, subtree_totals
from curbwatch.llm.queries import op12_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, id string, parent bigint"


def model(rows):
    """The nodes, from whole conversations held in memory."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, cs in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])),
            sum(q not in children for q in inside),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def run(spark, folder, rows, parts=3):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    frame.repartition(parts).write.parquet(f"{folder}/conversations.parquet")
    return [tuple(r) for r in op12_prefix_trie(spark, str(folder)).collect()]


def same(got, want):
    order = lambda r: tuple(-1 if x is None else x for x in r[:-1]) + r[-1:]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_random_conversations_with_nulls_ties_and_repeats(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 12), *range(100, 108), 250, 251, -3, -100, -101, 10**12, None]:
        for turn in range(rng.randint(0, 8)):
            number = rng.choice([turn, turn, turn, 2, None])
            rows.append((c, number, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé\U0001f600", "", None, "c c"])))
    rows += [rows[3], rows[3], (700, 0, "r", "x" * 100_000)]
    same(run(spark, tmp_path, rows), model(rows))


def test_equal_conversations_and_turnless_ones(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t}") for c in range(300, 340) for t in range(4)]
    rows += [(c, 0, "user", "alone") for c in range(401, 420)]  # base absent: rebuilt without turns where h > 0
    got = run(spark, tmp_path, rows)
    same(got, model(rows))
    assert next(r for r in got if r[1] == 0)[7] != hashlib.sha256(b"").hexdigest()


def test_one_conversation_with_a_third_of_all_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(5, t, "user", rng.choice("ab")) for t in range(150)] + [(c, t, "user", rng.choice("ab")) for c in range(60) for t in range(5)]
    same(run(spark, tmp_path, rows, 8), model(rows))


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    assert run(spark, tmp_path / "b", [(None, 1, "user", "x")]) == []


def test_subtree_totals(spark):
    """A chain, a star, random and comb-like trees and a forest of small ones, contracted side by side."""
    rng = random.Random(7)
    shapes = [
        (60, lambda i: i - 1),
        (80, lambda i: 0),
        (120, lambda i: rng.randrange(i)),
        (80, lambda i: i - 1 if i % 2 else max(0, i - 2)),
        (100, lambda i: None if i % 5 == 0 else i - 1 - rng.randrange(i % 5)),
    ]
    parent = {}
    for n, up in shapes:
        base = len(parent)
        for i in range(n):
            above = up(i) if i else None
            parent[base + i] = None if above is None else base + above
    value = {i: rng.randrange(1, 100) for i in parent}
    total = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    name = {i: i * 7919 % 1009 for i in parent}
    rows = [(name[i], None if p is None else name[p], value[i], 1) for i, p in parent.items()]
    tree = spark.createDataFrame(rows, "id bigint, parent bigint, v bigint, one bigint")
    got = {r["id"]: r["v"] for r in subtree_totals(tree, ["v", "one"]).collect()}
    assert got == {name[i]: t for i, t in total.items()}


def test_chunks_do_not_change_a_digest(spark, monkeypatch):
    import curbwatch.llm.prefix_trie as module

    monkeypatch.setattr(module, "CHUNK", 50)
    frame = spark.range(0, 3000).select((F.col("id") % 7 == 0).cast("bigint").alias("g"), F.col("id").alias("n"))
    got = {r["g"]: r["sha256"] for r in joined_ids(frame, ["g"], "n").collect()}
    for g in (0, 1):
        ids = ",".join(str(i) for i in range(3000) if (i % 7 == 0) == bool(g))
        assert got[g] == hashlib.sha256(ids.encode()).hexdigest()
