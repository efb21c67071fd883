import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbwatch.llm import suffix_dedup
from curbwatch.llm.queries import op11_suffix_dedup
from curbwatch.llm.suffix_dedup import COVER, PERIOD, STEP, PieceFinder, CoverRanks, repeated_windows, sliding_least, sorted_suffixes, without_repeats

from .data import edge_rows, prose


def model(texts, length):
    """(bytes, removed, runs, SHA-256 of what is left) of every text, from a table of all windows."""
    raw = [(t or "").encode() for t in texts]
    count = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        left = bytes(b for b, g in zip(t, gone[1:-1]) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out


def plain_texts(seed):
    rng = random.Random(seed)
    yield bytes(rng.randrange(256) for _ in range(700))
    yield b"ab" * 300
    yield b"\0" * 333
    yield b"a" * 500 + b"b" + b"a" * 500
    period = bytes(rng.randrange(3) for _ in range(37))
    yield period * 20 + b"x" + period * 7
    block = bytes(rng.randrange(2) for _ in range(150))
    yield b"".join(rng.choice([block, block[:90], b"q"]) for _ in range(12))
    yield b"z"
    yield b"abcabcabcabd"


def test_cover_meets_every_pair_of_residues():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert STEP.max() < PERIOD


@pytest.mark.parametrize("bucket", [1 << 17, 64])
def test_suffixes_in_order(bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    for text in plain_texts(1):
        padded = np.frombuffer(text + bytes(24), np.uint8)
        got = [p for part in sorted_suffixes(padded, len(text), np.arange(len(text))) for p in part.tolist()]
        assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_cover_ranks():
    for text in plain_texts(2):
        ranks = CoverRanks(np.frombuffer(text + bytes(24), np.uint8), len(text))
        places = [i for i in range(len(text)) if i % PERIOD in COVER]
        assert sorted(places, key=lambda i: text[i:]) == sorted(places, key=lambda i: ranks.at(np.array([i]))[0])


@pytest.mark.parametrize("bucket", [1 << 17, 50])
def test_repeated_windows(bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    for length in (64, 71, 200):
        for text in plain_texts(3):
            starts = np.arange(max(0, len(text) - length + 1))
            windows = [text[i : i + length] for i in starts]
            want = [windows.count(w) > 1 for w in windows]
            assert repeated_windows(np.frombuffer(text, np.uint8), starts, length).tolist() == want


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 7, 499, 500):
        assert sliding_least(x, width).tolist() == [int(x[i : i + width].min()) for i in range(500 - width + 1)]


def test_pieces_cover_all_windows_and_share_their_gram():
    text = np.frombuffer(prose(random.Random(2), 900).encode() + b"ab" * 400, np.uint8)
    finder = PieceFinder(200)
    valid = np.ones(len(text) - 199, bool)
    valid[500:699] = False
    m, _, start, n, several = finder.pieces(text, valid)
    covered = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)])
    assert covered.tolist() == np.flatnonzero(valid).tolist()
    order = finder.grams(*finder.sums(text)).view(np.int64)
    for gram, s, k, more in zip(m, start, n, several):
        inside = order[s : s + k + 200 - finder.gram]
        assert ((inside == gram).sum() > 1) == more
        assert all((order[i : i + 201 - finder.gram].view(np.uint64).min() == np.uint64(np.int64(gram).view(np.uint64))) for i in (s, s + k - 1))


def run(spark, folder, texts, parts=4):
    rows = [(i, t, 1, "x", 2) for i, t in texts]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, m int, kept string, start int")
    frame.repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in op11_suffix_dedup(spark, str(folder)).collect()), key=str)


def want(texts, length=200):
    return sorted(((i, *m) for (i, _), m in zip(texts, model([t for _, t in texts], length))), key=str)


def hard_texts():
    rng = random.Random(6)
    shared, line = prose(rng, 70), "read more about our terms on this page\n"
    out = [t for _, t in edge_rows() if t is None or len(t) < 9000]
    out += [prose(rng, 40) + shared + prose(rng, 40) for _ in range(5)]
    out += [line.join(prose(rng, 30) for _ in range(4)) for _ in range(10)]
    base = prose(rng, 200)
    for _ in range(12):  # near copies
        at = rng.randrange(len(base) - 10)
        out.append(base[:at] + "#" + base[at + rng.randrange(8) :])
    out += ["ab" * 250, "ab" * 170 + "c" * 300, prose(rng, 30) + "=" * 199, "=" * 199, shared.encode()[:199].decode(errors="ignore")]
    return out


def test_query_equals_the_model(spark, tmp_path):
    texts = [(i % 40 if i % 9 else None, t) for i, t in enumerate(hard_texts())]
    got = run(spark, tmp_path, texts)
    assert got == want(texts)


def test_other_lengths_large_groups_and_columns(spark):
    texts = list(enumerate(hard_texts()))
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in texts], "doc_id bigint, text string, kept string, raw int").repartition(3)
    for length, group in ((64, 1), (200, 0), (300, 1 << 24)):
        rows = without_repeats(frame, length, group)
        assert rows.columns == ["doc_id", "text", "kept", "raw", "removed", "_kept"]
        got = {}
        for r in rows.collect():
            raw = (r["text"] or "").encode()
            edges = [0, *(x for span in r["removed"] for x in (span["begin"], span["end"])), len(raw)]
            assert b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) == bytes(r["_kept"])
            got[r["doc_id"]] = (len(raw), sum(s["end"] - s["begin"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["_kept"]).hexdigest())
        assert [got[i] for i, _ in texts] == model([t for _, t in texts], length)


def test_strips_and_blocks_change_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    long = prose(rng, 3000)
    texts = [(1, long), (2, long[5000:9000] + prose(rng, 50)), (3, prose(rng, 1500)), (4, long[:300] * 3)]
    monkeypatch.setattr(suffix_dedup, "STRIP", 700)  # forked workers see it only in strips(), tested here
    pieces = list(suffix_dedup.strips([t.encode() for _, t in texts], 200))
    seen = {(int(o), int(p)) for _, valid, owner, place in pieces for o, p in zip(owner[: len(valid)][valid], place[: len(valid)][valid])}
    assert seen == {(i, p) for i, (_, t) in enumerate(texts) for p in range(len(t.encode()) - 199)}
    assert run(spark, tmp_path, texts) == want(texts)


def test_a_third_of_all_rows_are_one_text(spark, tmp_path):
    rng = random.Random(9)
    hot = prose(rng, 80)
    texts = [(5 if i % 2 else i, hot) for i in range(60)] + [(100 + i, prose(rng, 60)) for i in range(100)]
    got = run(spark, tmp_path, texts, 8)
    assert got == want(texts)
    assert sum(r[2] for r in got if r[2]) == 60 * len(hot.encode())


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, tmp_path / "b", [(1, None), (2, "")]) == [(1, 0, 0, 0, nothing), (2, 0, 0, 0, nothing)]


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        without_repeats(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 10)
