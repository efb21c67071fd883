import numpy as np
import pytest
from pyspark.sql import functions as F

from curbwatch.llm.common import read_table
from curbwatch.llm.forest_search import Forest, nearest

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, rank int, score string"


def brute(rows, k):
    """query -> [(id, score)] of the usable rows."""
    rows = sorted(set((i, tuple(v)) for i, v in rows))
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    out = {}
    for q in range(len(rows)):
        s = (v * v[q]).sum(axis=1) / (n * n[q])
        near = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = near
    return out


def test_edge_vectors(spark):
    good = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [2.0, 0.0]), (5, [-1.0, 1e-30]), (6, [1.0, 1.0]), (6, [1.0, 1.0])]
    bad = [(7, None), (8, []), (9, [0.0, 0.0]), (10, [1.0, None]), (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]),
           (None, [1.0, 1.0])]
    good_alone = [(13, [1.0, 2.0, 3.0])]  # of its length there is no other: an empty answer
    frame = spark.createDataFrame([(i, v, 0, "s") for i, v in good + good_alone + bad], SCHEMA)
    got = {}
    for r in nearest(frame, F.lit(True), k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(good, 4)
    assert set(got) == set(want)
    for q, near in want.items():
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, len(near) + 1))
        assert [r[1] for r in rows] == [i for i, _ in near]
        assert np.allclose([r[2] for r in rows], [s for _, s in near], atol=1e-12)


def test_rows_repeated_more_often_than_k_count_once(spark):
    rows = [(1, [1.0, 0.0])] * 9 + [(2, [1.0, 0.0])] + [(3, [0.0, 1.0])] * 9 + [(4, [0.0, 1.0]), (5, [0.5, 1.0])]
    frame = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(3)
    near = nearest(frame, F.lit(True), k=2).collect()
    want = brute(rows, 2)
    for q in range(1, 6):
        found = sorted((r["rank"], r["vec_id"]) for r in near if r["query_id"] == q)
        assert found == [(i + 1, v) for i, (v, _) in enumerate(want[q])]


def test_every_length_is_answered(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4 + i % 2)]) for i in range(100)] + [(100, [1.0] * 9), (101, [2.0] * 9)]
    frame = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(3)
    found = {}
    for r in nearest(frame, F.lit(True), k=3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for d in (4, 5, 9):
        for q, near in brute([r for r in rows if len(r[1]) == d], 3).items():
            assert sorted(found.pop(q)) == [(i + 1, v) for i, (v, _) in enumerate(near)]
    assert not found


def test_one_vector_for_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    hot = [float(x) for x in rng.normal(size=8)]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.normal(size=8)], 0, "") for i in range(300)]
    near = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, share=1.0).collect()
    want = brute([r[:2] for r in rows], 5)
    for q in range(0, 300, 50):
        assert [r["vec_id"] for r in sorted((r for r in near if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i, _ in want[q]]


def test_blocks_and_depth_change_nothing_in_a_full_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0, "") for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute([r[:2] for r in rows], 5)
    for settings in ({"leaf_rows": 40, "block": 7}, {"leaf_rows": 1000}):
        near = nearest(frame, F.col("vec_id") % 20 == 0, share=1.0, trees=2, **settings).collect()
        assert len(near) == 100
        for r in near:
            assert want[r["query_id"]][r["rank"] - 1][0] == r["vec_id"]


def test_recall(spark):
    frame = read_table(spark, SF01, "embeddings")
    near = nearest(frame, F.col("vec_id") % 50 == 0, leaf_rows=32)
    found = {}
    for r in near.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute([(r["vec_id"], r["embedding"]) for r in frame.collect()], 5)
    recall = np.mean([len(found[q] & {i for i, _ in want[q]}) / 5 for q in found])
    assert recall >= 0.9


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert nearest(frame, F.lit(True)).collect() == []


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_search_visits_each_leaf_once_and_the_own_first(depth):
    rng = np.random.default_rng(6)
    sample = rng.normal(size=(500, 4))
    forest = Forest(sample, 3, depth, 1)
    everything = forest.search(sample[0], 10**6)
    assert sorted(everything) == list(range(3 * forest.leaves))
    assert set(everything[:3]) == set(forest.bins(sample[:1])[0].tolist())
