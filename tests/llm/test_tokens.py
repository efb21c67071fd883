import random
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curbwatch.llm.dominance_pack import Instance, look_up, pack_documents, pack_plan, reduce
from curbwatch.llm.queries import tokenizer_path
from curbwatch.llm.token_blocks import best_fit_rows, token_blocks
from curbwatch.llm.word_tokens import WordTokens, read_definition

from .data import edge_rows

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokens():
    return WordTokens(read_definition(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcXYZÉßöñ'stll12.,!?-\x1c\x85\xa0İΣσſ"), st.characters(codec="utf-8")), max_size=40))
def test_ids_equal_the_library(tokens, text):
    assert array("I", tokens.encode(text)).tolist() == tokens.plain(text)


def test_ids_of_edge_texts(tokens):
    for _, text in edge_rows():
        assert array("I", tokens.encode(text or "")).tolist() == tokens.plain(text or "")


@pytest.mark.parametrize("token", ["<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftexT|>"])
def test_special_tokens_in_any_case(tokens, token):
    for text in (token, f"The CAT {token} Sat", f"Word{token}Word! OK", f"{token}{token.lower()}", f"É{token.upper()} B"):
        assert array("I", tokens.encode(text)).tolist() == tokens.plain(text)


def test_blocks_keep_special_tokens_in_any_case(spark, tokens):
    text = "One <|EndOfText|> TWO <|startoftext|> x<|STARTOFTEXT|>"
    (row,) = token_blocks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), PATH, width=64).collect()
    assert np.frombuffer(row["ids"], "<u4")[: row["n_tokens"]].tolist() == [*tokens.plain(text), 0]


def fewest(items, capacity):
    """The optimum by exhaustion."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("many", [1000, 10**6])
def test_plan_is_as_long_as_there_are_lengths(many):
    counts = {1100: many, 600: many, 348: many, 900: many // 3, 50: 7}
    plan = pack_plan(counts, 2048)
    assert len(plan) < len(counts) ** 2 + 40
    placed = {}
    for length, lo, copies, _, _ in plan.tolist():
        placed.setdefault(length, []).append(lo)
    assert set(placed) == set(counts)


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 15, 24])
    items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
    inst = Instance({n: items.count(n) for n in items})
    fixed = sum(bins for _, bins in reduce(inst, capacity))
    rest = sorted((n for n, c in inst.count.items() for _ in range(c)), reverse=True)
    assert fixed + fewest(rest, capacity) == fewest(items, capacity)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
    plan, filled = pack_plan(counts, capacity), {}
    for length, n in counts.items():
        for s, o in zip(*(x.tolist() for x in look_up(plan, np.full(n, length), np.arange(n)))):
            filled.setdefault(s, []).append((o, length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(filled) == list(range(len(filled)))


@pytest.mark.parametrize("seed", range(10))
def test_segment_tree_finds_the_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(200)]
    rows, room = best_fit_rows(lengths, 50), []
    plain = []  # the same by looking at every open row
    for i in sorted(range(200), key=lambda i: -lengths[i]):
        fit = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        least = min((r for r, _ in fit), default=None)
        if least is None:
            room.append(50)
            plain.append(0)
            least = 50
        k = next(k for k, r in enumerate(room) if r == least)
        room[k] -= lengths[i]
    assert sorted(i for r in rows for i in r) == list(range(200))
    assert sorted(50 - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def texts_by_row(tokens):
    return sorted(([*tokens.plain(t or ""), 0] for _, t in edge_rows()), key=lambda x: (len(x), x))


def test_blocks_round_trip(spark, edge_docs, no_docs, tokens):
    pieces = {}
    for r in token_blocks(edge_docs, PATH, width=64, block_tokens=2000).collect():
        ids, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(positions) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.setdefault((doc, start), []).append(ids[a:b].tolist())
    for doc in {d for d, _ in pieces} - {None, 4}:  # 4 and null are ids of several rows
        whole = [x for d, s in sorted(k for k in pieces if k[0] == doc) for x in pieces[d, s][0]]
        (text,) = (t for i, t in edge_rows() if i == doc)
        assert whole == [*tokens.plain(text or ""), 0]
    assert sum(len(x) for p in pieces.values() for x in p) == sum(map(len, texts_by_row(tokens)))
    assert token_blocks(no_docs, PATH).collect() == []


def test_packing_edge_cases(spark, edge_docs, no_docs, tokens):
    rows = pack_documents(edge_docs, PATH, capacity=64).collect()
    for doc in {r["doc_id"] for r in rows} - {None, 4}:
        (text,) = (t for i, t in edge_rows() if i == doc)
        ids = np.array([*tokens.plain(text or ""), 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == [(s, min(64, len(ids) - s)) for s in range(0, len(ids), 64)]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[s : s + 64].tobytes()) for s in range(0, len(ids), 64)]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces)[:-1])]).tolist()
    total = sum(map(len, texts_by_row(tokens)))
    assert sum(r["length"] for r in rows) == total and len(places) <= -(-total // 64) + 1
    assert pack_documents(no_docs, PATH).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_sets_fixed_at_once_are_those_fixed_one_by_one(seed, monkeypatch):
    from curbwatch.llm import dominance_pack

    rng = random.Random(seed)
    capacity = rng.choice([10, 24, 60])
    counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}

    def fixed():
        inst, total = Instance(dict(counts)), {}
        for pattern, bins in reduce(inst, capacity):
            total[pattern] = total.get(pattern, 0) + bins
        return total, {n: c for n, c in inst.count.items() if c}

    at_once = fixed()
    monkeypatch.setattr(dominance_pack, "ENOUGH", 10**9)
    assert at_once == fixed()
