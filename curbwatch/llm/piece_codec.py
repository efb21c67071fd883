"""Exact BPE encoding and decoding with a SentencePiece model, by backtracking.

A merge-type encoding is determined by its adjacent pairs: a sequence of pieces
is *the* BPE encoding of a text if and only if every two neighbours, merged
again on their own, come out as the same two pieces. So the encoder walks over
the text, takes the longest piece an Aho-Corasick automaton finds at a
position, checks it against its left neighbour by re-merging the two
(remembered per pair), tries the next shorter piece if they don't agree, and
steps back where none does. A prefix has one encoding only, so a position that
failed once always fails: one bit per position makes the walk linear.

Texts are cut where no piece of the vocabulary can cross (before a word's
space mark, around characters in no piece), and the encodings of these chunks
are kept in a bounded table per Python worker, since words repeat. Spark
partitions the documents; nothing is shuffled or collected. The model's bytes
travel with the task.

Defined cases: a null text is an empty one; an empty text has the begin and
end ids alone; characters outside the vocabulary become byte pieces; a text
without spaces is one chunk, walked with a few bytes of state per character.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import ship_package, text_blocks, worker_table

MARK = "▁"  # fixed value: what stands for a space in pieces
UNKNOWN_TEXT = " ⁇ "  # fixed value: what an unknown piece decodes to
ENCODED = "doc_id bigint, ids binary, decoded string"


def merged(text: str, rank: dict[str, float]) -> list[str]:
    """BPE by its definition: merge the best-ranked adjacent pair, leftmost
    first, until none merges. For the short strings of pair checks."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Vocabulary:
    """What the encoder needs of a model, as plain picklable values."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.surface: list[bytes] = []
        self.pieces: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_unknown(i):
                self.surface.append(UNKNOWN_TEXT.encode())
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            else:
                self.pieces[piece] = i
                self.rank[piece] = -sp.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self.alphabet = frozenset("".join(self.pieces))
        # pieces that BPE can really produce
        self.reached = {p: i for p, i in self.pieces.items() if len(p) == 1 or merged(p, self.rank) == [p]}
        for probe in ("", " ", "a", "  a  b ", f"x{MARK} y\n\n", "The cat's 12.5 café\t一\U0001f600"):
            if Codec(self).encode(probe).tolist() != sp.encode(probe, add_bos=True, add_eos=True):
                raise ValueError("the model's normalisation is not the identity with a leading space mark")


def cut_rule(vocabulary: Vocabulary) -> str:
    """Pattern of the chunks of a marked text: runs that no piece of the vocabulary leaves.

    As far as the vocabulary's pieces allow, space marks start a chunk, letters
    and other characters are apart and a line end is alone.
    """
    bodies = [p.lstrip(MARK) for p in vocabulary.pieces]
    if any(MARK in b for b in bodies) or any(p.startswith(MARK * 2) and p.strip(MARK) for p in vocabulary.pieces):
        return "(?s:.+)"
    alone = "" if "\n" in vocabulary.alphabet else "\n"
    end = "|\n" if alone else ""
    if any(x.isalpha() != y.isalpha() for body in bodies for x, y in zip(body, body[1:])):
        return f"{MARK}*[^{MARK}{alone}]+|{MARK}+{end}"
    letters = "".join(sorted(c for c in vocabulary.alphabet if c.isalpha()))  # other characters are in no piece
    return f"{MARK}*[{letters}]+|{MARK}*[^{letters}{MARK}{alone}]+|{MARK}+{end}"


class Memo(dict):
    """A dict that computes what it lacks and keeps a bounded number of values."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.limit:
            self[key] = value
        return value


class Codec:
    """Encodes and decodes whole texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary, kept: int = 300_000, longest_kept: int = 64):
        import ahocorasick

        self.v, self.longest_kept = vocabulary, longest_kept
        self.automaton = ahocorasick.Automaton()
        letters = [c for c in vocabulary.alphabet if c not in vocabulary.reached]
        self.units = list(vocabulary.reached) + letters
        self.unit_ids = [vocabulary.pieces.get(u, -1) for u in self.units]
        self.lengths = list(map(len, self.units))
        self.reach = max(self.lengths)
        place = {u: k for k, u in enumerate(self.units)}
        for unit, k in place.items():
            self.automaton.add_word(unit, k)
        self.automaton.make_automaton()
        # the longest proper prefix that is a unit too: the next choice at the same position
        self.shorter = [next((place[u[:n]] for n in range(len(u) - 1, 0, -1) if u[:n] in place), -1) for u in self.units]
        self.fits = Memo(self._fits, 500_000)
        self.chunks = Memo(self.encode_chunk, kept)
        self.cut = re.compile(cut_rule(vocabulary)).findall
        self.odd = re.compile("[^" + re.escape("".join(vocabulary.alphabet)) + "]").search

    def _fits(self, pair: int) -> bool:
        a, b = self.units[pair >> 20], self.units[pair & 0xFFFFF]
        return merged(a + b, self.v.rank) == [a, b]

    def encode(self, text: str) -> array:
        """All ids of a text, begin and end ids included."""
        return array("I", self.encode_bytes(text))

    def encode_bytes(self, text: str) -> bytes:
        """The same as little-endian unsigned 32-bit numbers."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        chunks, keep = self.chunks, self.longest_kept
        body = [chunks[c] if len(c) <= keep else self.encode_chunk(c) for c in self.cut(marked)]
        return b"".join([le32([self.v.bos]), *body, le32([self.v.eos])])

    def encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        if not self.odd(chunk):
            self.walk(chunk, 0, len(chunk), ids)
            return le32(ids)
        start = 0
        for i, c in enumerate(chunk):
            if c not in self.v.alphabet:
                self.walk(chunk, start, i, ids)
                self.spell(c, ids)
                start = i + 1
        self.walk(chunk, start, len(chunk), ids)
        return le32(ids)

    def spell(self, text: str, ids: list[int]) -> None:
        """A character in no piece: its bytes, or the unknown id in models without byte pieces."""
        raw = text.encode("utf-8", "surrogatepass")
        ids.extend(self.v.byte_ids[b] for b in raw) if self.v.byte_ids[0] >= 0 else ids.append(self.v.unk)

    def walk(self, text: str, start: int, end: int, ids: list[int]) -> None:
        """The encoding of ``text[start:end]``, which holds characters of the vocabulary only."""
        longest, lengths, shorter, fits = self.automaton.iter_long, self.lengths, self.shorter, self.fits
        reach = self.reach
        failed = bytearray(((end - start) >> 3) + 1)
        taken: list[int] = []
        pos, k = start, -2  # -2: not looked up yet, -1: no choice left
        while pos < end:
            if k == -2:
                k = next(longest(text[pos : min(end, pos + reach)]))[1]
            while k >= 0:
                stop = pos + lengths[k] - start
                if not failed[stop >> 3] >> (stop & 7) & 1 and (not taken or fits[taken[-1] << 20 | k]):
                    break
                k = shorter[k]
            if k >= 0:
                taken.append(k)
                pos, k = pos + lengths[k], -2
            else:
                failed[(pos - start) >> 3] |= 1 << ((pos - start) & 7)
                k = taken.pop()
                pos -= lengths[k]
                k = shorter[k]
        for k in taken:
            ids.append(self.unit_ids[k]) if self.unit_ids[k] >= 0 else self.spell(self.units[k], ids)

    def decode_bytes(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        numbers = memoryview(ids).cast("I").tolist()
        raw = b"".join(map(self.v.surface.__getitem__, numbers))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(numbers)
        # the leading space mark is dropped, but not a space that was spelled in bytes
        first = next((i for i in numbers if self.v.surface[i]), None)
        return text[1:] if text.startswith(" ") and first not in (self.v.byte_ids[32], self.v.unk) else text

    def _decode_broken(self, numbers: list[int]) -> str:
        """Byte pieces that aren't UTF-8 become a replacement character each."""
        spelled = set(self.v.byte_ids)
        out, run = [], b""
        for i in numbers:
            if i in spelled:
                run += self.v.surface[i]
                continue
            out += [lenient(run), self.v.surface[i].decode()]
            run = b""
        return "".join([*out, lenient(run)])


def lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every byte that belongs to no character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def le32(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def codec_for(digest: str, vocabulary: Vocabulary) -> Codec:
    return worker_table(f"pieces {digest}", lambda: Codec(vocabulary))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: all ids with begin and end as
    little-endian unsigned 32-bit numbers, and the text they decode to."""
    ship_package(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    digest, vocabulary = hashlib.sha256(model).hexdigest(), Vocabulary(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_for(digest, vocabulary)
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"]
            for first, block in text_blocks(texts):
                ids = [codec.encode_bytes(t if isinstance(t, str) else "") for t in texts[first : first + len(block)]]
                yield pd.DataFrame(
                    {
                        "doc_id": keys.iloc[first : first + len(block)].to_numpy(),
                        "ids": ids,
                        "decoded": list(map(codec.decode_bytes, ids)),
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(run, ENCODED)
