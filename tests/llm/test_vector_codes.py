import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbwatch.llm.queries import op13_vector_codes
from curbwatch.llm.vector_codes import SliceIndex, decoded, encode_vectors, train_codebooks

SF01 = "/root/testdata/sf0.01"


def plain_nearest(entries, points):
    gaps = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return gaps.argmin(axis=1), gaps.min(axis=1)


@pytest.mark.parametrize("seed", range(8))
def test_slices_find_the_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    spread = [1, 5, 300, 10**6][seed % 4]
    entries = rng.integers(-spread, spread + 1, (rng.integers(1, 65), rng.integers(1, 7)))
    points = rng.integers(-3 * spread, 3 * spread + 1, (500, entries.shape[1]))
    want = plain_nearest(entries, points)
    got = SliceIndex(entries).nearest(points)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_box_masks_are_exact():
    rng = np.random.default_rng(3)
    entries, points = rng.integers(-50, 50, (64, 3)), rng.integers(-60, 60, (200, 3))
    radius = rng.integers(0, 60, 200)
    masks = SliceIndex(entries).candidates(points, radius)
    inside = (np.abs(points[:, None, :] - entries[None, :, :]) <= radius[:, None, None]).all(axis=2)
    assert [[bool(int(m) >> i & 1) for i in range(64)] for m in masks] == inside.tolist()


def model(rows, parts=16, k=64, rounds=2):
    """(vec_id, code, error, label_error, digest) of usable rows of one length, in plain Python."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    if not rows:
        return []
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-len(rows[0][1]) // parts)
    ints = [[int(np.floor(256.0 * float(x))) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in rows]
    cuts = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(c[p]) for c in cuts[:k]] for p in range(parts)]

    def assign():
        out = []
        for c in cuts:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [c[p] for c, f in zip(cuts, found) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest) for r, f, e in zip(rows, found, errors)]


def table(spark, tmp_path, rows, schema="vec_id bigint, embedding array<float>, label int, code int, error string"):
    folder = str(tmp_path)
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return op13_vector_codes(spark, folder)


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_the_model_on_edge_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=32)], i % 3 or None) for i in range(150)]
    rows += [(7, rows[9][1], 5), (7, rows[9][1], 5), (None, rows[3][1], None), (200, [0.0] * 32, 2), (201, [-0.0] * 32, 2)]
    rows += [(202, None, 1), (203, [None] + [1.0] * 31, 1), (204, [float("nan")] * 32, 1), (205, [float("inf")] * 32, 2)]
    assert key(table(spark, tmp_path / "a", rows).collect()) == key(model(rows))


def test_few_rows_odd_lengths_and_empty_tables(spark, tmp_path):
    few = [(3, [0.25, -0.5, 1.0], 1), (1, [0.25, -0.5, 1.0], 1), (2, [4.0, 0.0, -1.0], None)]
    assert key(table(spark, tmp_path / "a", few).collect()) == key(model(few))
    blank = [(1, [], 1), (2, [], 2)]
    assert key(table(spark, tmp_path / "b", blank).collect()) == key(model(blank))
    assert table(spark, tmp_path / "c", []).collect() == []
    assert table(spark, tmp_path / "d", [(1, None, 1)]).collect() == []


def test_lengths_have_codebooks_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(2)
    long = [(i, [float(np.float32(x)) for x in rng.normal(size=16)], 1) for i in range(0, 160, 2)]
    short = [(i, [float(np.float32(x)) for x in rng.normal(size=5)], 2) for i in range(1, 160, 2)]
    got = key(table(spark, tmp_path, long + short).collect())
    assert got == key(model(long) + model(short))


def test_extremes_raise(spark):
    frame = spark.createDataFrame([(1, [1e30] * 16)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        train_codebooks(frame)


def test_codes_stand_for_vectors_near_by(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=32)], "n") for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, code string")
    books = train_codebooks(frame)
    out = encode_vectors(frame, books)
    assert out.columns == ["vec_id", "embedding", "code", "_code", "error", "codebooks"]
    for r in out.collect():
        back = decoded(bytes(r["_code"]), books[32])
        gap = np.array(back) - np.array(r["embedding"])
        assert abs((gap**2).sum() - r["error"] / 256**2) < 0.1 + 2 * (r["error"] ** 0.5) * 32**0.5 / 256**2


def test_brute_force_on_a_given_table(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = op13_vector_codes(spark, SF01)
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    assert key(got.collect()) == key(model(rows))


def test_one_label_for_most_rows_is_joined_once(spark):
    got = op13_vector_codes(spark, SF01)
    sums = got.groupBy("label_error").agg(F.count("*").alias("n")).collect()
    assert len(sums) <= 10
