import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from curbwatch.llm.piece_codec import Codec, Vocabulary, encode_documents, le32
from curbwatch.llm.queries import tokenizer_path

from .data import edge_rows

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return Codec(Vocabulary(f.read()))


def same(codec, library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert codec.encode(text).tolist() == ids
    assert codec.decode_bytes(le32(ids)) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab▁xyzéß一😀\x00'-=*#<s>/0123"), st.characters(codec="utf-8")), max_size=60))
def test_random_texts_equal_the_library(codec, library, text):
    same(codec, library, text)


@pytest.mark.parametrize("seed", range(30))
def test_joined_pieces_and_runs(codec, library, seed):
    rng = random.Random(seed)
    pieces = list(codec.v.pieces)
    same(codec, library, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))))
    same(codec, library, rng.choice("a=-# *") * rng.randint(1, 3000) + "abc" * rng.randint(0, 50))


@pytest.mark.parametrize("seed", range(30))
def test_decoding_of_any_ids(codec, library, seed):
    rng = random.Random(seed)
    ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
    assert codec.decode_bytes(le32(ids)) == library.decode(ids)


def test_rows(spark, edge_docs, no_docs, library):
    rows = encode_documents(edge_docs, PATH).collect()
    want = [(i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in edge_rows()]
    assert sorted((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"]) for r in rows) == sorted(
        (i or -1, le32(ids), library.decode(ids)) for i, ids in want
    )
    assert encode_documents(no_docs, PATH).collect() == []
