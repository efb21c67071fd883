"""Exact ids of a word-piece tokenizer file, fast on repeated words.

The tokenizer drops white space, and none of its steps (NFC, lower case, split,
merges) looks across it; so the ids of a text are those of its space-separated
chunks, which repeat. Each worker keeps bounded tables of words and
other chunks; a word with punctuation behind it is looked up in two parts.
Special tokens are matched on the raw text, ahead of lower case, so a chunk that
holds one in any case goes to the tokenizer as it stands.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd

from .common import worker_table

# Python's str.split also cuts at these; the tokenizer's pattern does not.
NOT_BLANK = "\x1c\x1d\x1e\x1f"
# letters that lower-case one by one, whatever is around them
UNPLAIN = re.compile("[İɐ-\U0010ffff]").search
PROBES = ("", "A  b\tc", "The CAT's 12 café x　y", "́a é İΣ", "<|endoftext|>!?..\n", "A<|EndOfText|> <|STARTOFTEXT|>b <|StartOfText|> C")


# a word and what follows it up to the next space; apostrophes may belong to either
WORD_AND_REST = re.compile(r"([a-zß-öø-ÿ]+)([^A-Za-zß-öø-ÿ0-9ªµºÀ-ÖØ-Þ²³¹¼½¾Ā-\U0010ffff'\s]*)").fullmatch


class WordTokens:
    def __init__(self, definition: str, kept: int = 200_000, longest_kept: int = 64):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        # for single lower-case words the steps before the merges change nothing
        self.words_only = Tokenizer.from_str(definition)
        self.words_only.normalizer = normalizers.Sequence([])
        self.words_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        any_case = "|".join(map(re.escape, self.specials)) or "(?!)"
        self.special = re.compile(any_case, re.IGNORECASE).search
        self.kept, self.longest_kept = kept, longest_kept
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def verify(self) -> None:
        for probe in (*PROBES, *(f"a {x}B C{x} d" for t in self.specials for x in (t, t.upper(), t.title()))):
            if array("I", self.encode(probe)).tolist() != self.plain(probe):
                raise ValueError("this tokenizer's ids depend on more than space-separated chunks")

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("I", self.words_only.encode(word, add_special_tokens=False).ids).tobytes()
            if len(self.words) < self.kept and len(word) <= self.longest_kept:
                self.words[word] = ids
        return ids

    def __missing(self, chunk: str) -> bytes:
        if parts := WORD_AND_REST(chunk):
            word, rest = parts.groups()
            ids = self.__word(word)
            if not rest:
                return ids
            ids += self.chunks.get(rest) or self.__missing(rest)
        else:
            ids = array("I", self.plain(chunk)).tobytes()
        if len(self.chunks) < self.kept and len(chunk) <= self.longest_kept:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if any(c in text for c in NOT_BLANK):
            return array("I", self.plain(text)).tobytes()
        if not UNPLAIN(text):
            if self.special(text):
                text = " ".join([c if self.special(c) else c.lower() for c in text.split()])
            else:
                text = text.lower()
        get, word, missing = self.chunks.get, self.words.get, self.__missing
        return b"".join([word(c) or get(c) or missing(c) for c in text.split()])


def encoder_for(definition: str) -> WordTokens:
    digest = hashlib.sha256(definition.encode()).hexdigest()
    return worker_table(f"words {digest}", lambda: WordTokens(definition))


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    WordTokens(definition).verify()
    return definition


def encoded_rows(batches: Iterator[pd.DataFrame], definition: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids with ``end_id`` last) of every row; null text is empty."""
    encoder, end = encoder_for(definition), array("I", [end_id]).tobytes()
    for batch in batches:
        keys, texts = batch["doc_id"].tolist(), batch["text"].tolist()
        for key, text in zip(keys, texts):
            ids = encoder.encode(text if isinstance(text, str) else "") + end
            yield (None if key is None or key != key else int(key)), np.frombuffer(ids, "<u4")
