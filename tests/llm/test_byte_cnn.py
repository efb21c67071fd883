import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbwatch.llm.byte_cnn import GROUP, SPAN, ByteCnn, chunk_bytes, chunk_groups, chunk_starts, held_out, pool, score_rows, train_classifier

from .data import edge_rows, prose

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(spark, n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 400)).split(" ")
        junk = i % 3 == 0
        rows.append((i, " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in words) if junk else " ".join(words), int(not junk)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABELS)


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 5, 511, 512, 518, 519, 1030, 9999):
        raw = bytes(i % 251 + 1 for i in range(n))
        starts = chunk_starts(n)
        chunks = chunk_bytes(raw, starts)
        assert chunks.shape == (len(starts), SPAN)
        seen = {int(s) + i for s in starts for i in range(SPAN) if s + i < n}
        assert seen == set(range(n))
        assert all(chunks[c, i] == raw[s + i] for c, s in enumerate(starts) for i in range(0, SPAN, 17) if s + i < n)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = ByteCnn().start(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks, first = rng.integers(1, 256, (7, SPAN)).astype(np.uint8), np.array([0, 2, 6])
    labels, weights = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        q = net.probability(pool(net.responses(chunks), first))
        return -np.sum(weights * (labels * np.log(q) + (1 - labels) * np.log(1 - q))) / weights.sum()

    grad = net.gradients(chunks, first, labels, weights)
    for name in ("offset", "combine", "bias"):
        for at in np.argsort(-np.abs(grad[name]))[:3]:
            old, step = net.p[name][at], 1e-2
            net.p[name][at] = old + step
            up = loss()
            net.p[name][at] = old - step
            down = loss()
            net.p[name][at] = old
            assert (up - down) / (2 * step) == pytest.approx(grad[name][at], rel=0.1, abs=1e-3)


def test_training_takes_every_chunk_of_a_text(spark, monkeypatch):
    rng = random.Random(4)
    # longer than 12 chunks, than a group, and one with a repeated row
    texts = {1: prose(rng, 5000), 2: prose(rng, 20), 3: prose(rng, 60_000), 4: "", 5: None}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in texts if not is_held_out(i)], LABELS)
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id bigint, text string")
    seen = {}

    def train(self, cuts, labels, weights, steps, seed, rate):
        seen["cuts"] = [np.array(c) for c in cuts]
        return self

    monkeypatch.setattr(ByteCnn, "train", train)
    train_classifier(docs, labels)
    want = [(t or "").encode() for i, t in texts.items() if not is_held_out(i)]
    assert len(seen["cuts"]) == len(want) and max(len(c) for c in seen["cuts"]) > GROUP
    for cut, raw in zip(seen["cuts"], want):
        assert np.array_equal(cut, chunk_bytes(raw, chunk_starts(len(raw))))


def test_gradients_are_the_same_in_groups(monkeypatch):
    rng = np.random.default_rng(3)
    net = ByteCnn().start(4)
    texts = [rng.integers(1, 256, (n, SPAN)).astype(np.uint8) for n in (3, 2 * GROUP + 7, 1, GROUP)]
    labels, weights = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    assert [len(c) for c, _ in chunk_groups(texts)] == [GROUP, GROUP, GROUP, 11]
    grads = [net.text_gradients(texts, labels, weights)]
    monkeypatch.setattr("curbwatch.llm.byte_cnn.HELD", 0)  # responses computed twice
    grads.append(net.text_gradients(texts, labels, weights))
    monkeypatch.setattr("curbwatch.llm.byte_cnn.GROUP", 10_000)  # all at once
    grads.append(net.text_gradients(texts, labels, weights))
    for other in grads[1:]:
        assert all(np.allclose(grads[0][k], other[k], rtol=1e-3, atol=1e-5) for k in other)


def test_long_texts_score_the_same_in_pieces():
    net = ByteCnn().start(3)
    raw = bytes(random.Random(1).randrange(1, 255) for _ in range(700_000))
    starts = chunk_starts(len(raw))
    whole = pool(net.responses(chunk_bytes(raw, starts)), np.array([0]))
    assert np.allclose(net.pool_long(raw, starts), whole[0], atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = train_classifier(docs, labels, steps=120)
    scored = score_rows(docs, model, ["doc_id"]).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(scored) > 30
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in scored]) >= 0.95


def test_held_out_labels_are_never_learned(spark):
    docs, labels = corpus(spark, 60)
    flipped = labels.withColumn("quality", labels["quality"] * 0 + 1).where(held_out(labels["doc_id"])).union(
        labels.where(~held_out(labels["doc_id"]))
    )
    a, b = (train_classifier(docs, x, steps=10) for x in (labels, flipped))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_edge_cases(spark, edge_docs, no_docs):
    conflicting = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (9, 1, 0), (None, 0, 0), (11, 0, 0), (999, 0, 0)], LABELS)
    model = train_classifier(edge_docs, conflicting, steps=5)
    scored = score_rows(edge_docs, model, edge_docs.columns, "quality_score")
    assert scored.columns == [*edge_docs.columns, "quality_score"]
    rows = scored.collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["quality_score"] <= 1 for r in rows)
    empty = [r["quality_score"] for r in rows if r["text"] in (None, "")]
    assert max(empty) - min(empty) <= 2e-6
    assert score_rows(no_docs, model, ["doc_id"]).collect() == []


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(6, 1, 0), (7, 1, 0)], 1.0)])
def test_without_both_classes_the_share_is_the_score(spark, edge_docs, labels, score):
    model = train_classifier(edge_docs, spark.createDataFrame(labels, LABELS))
    assert {r["score"] for r in score_rows(edge_docs, model, ["doc_id"]).collect()} == {score}
