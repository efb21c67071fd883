"""Licence scan: an exact containment join of text blocks with licence templates.

A template is a set of words, a block (a line, or a paragraph of several lines)
too; they match when the block holds at least ``threshold`` of the template's
words. Words are ordered by how many documents hold them, rarest first (one
counting job over all documents; only the templates' few hundred words are
counted and collected). Then

* prefix filter: a match must share one of the template's first
  ``|t| - need + 1`` words, so a block is looked at through an index of these,
* length filter: a block needs ``need`` words of any template at all,
* positional filter: what can still follow after the first shared word, on
  either side, must reach ``need``;

what is left is compared exactly, so no matching block is missed. With ``names``
the exact comparison also asks that the block says which licence it is: the
template's pattern (``NAMES``), if it has one, must stand in it, and the
``need`` words must lie (around it) within twice the template's words, not
scattered over a long line. Beside the join, fixed phrases are found where
their words stand consecutively.

Both jobs are maps over the documents (plus a tiny aggregation); the templates
are a parameter of the job and travel with the tasks.

Defined cases: null text is empty: no words, no places, score 0; a text of one
long line is one block; repeated rows are scanned each on its own; words are
bytes of UTF-8, so any letters outside ASCII belong to words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package

# Phrases that are found word for word, and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices as their authors word them, by label
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
)

# What a notice must say to be of that licence, as patterns over lower-case words between single
# spaces; each gap may hold a few words, but no other version's number and no other variant's name
GAP = r"(?:[^ 0-9]+ ){0,4}?"
APACHE = rf"\bapache {GAP}v?2\b(?! [1-9])|\bv?2 (?:0 )?of the apache\b|\bapache org (?:[^ ]+ )?license 2 0\b"
GPL = r"(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e"
GPL3 = rf"{GPL} {GAP}(?:v?2 or {GAP})?(?:gpl)?v?3\b(?! [1-9])|\bv?3 (?:0 )?of the (?:gnu )?{GPL}"
OTHER_CC = r"(?!(?:nc|nd|sa|non|no|share)\b|noncommercial|noderiv|sharealike)"
CC_BY = rf"\b(?:cc by|attribution) (?:{OTHER_CC}[^ 0-9]+ ){{0,4}}?v?4\b(?! [1-9])"
CC_BY_NC = rf"\bby nc (?:{OTHER_CC}[^ 0-9]+ ){{0,4}}?v?4\b(?! [1-9])"
NAMES: Mapping[str, str] = {
    "Released under the MIT License.": r"\bmit\b",
    "This project is licensed under the terms of the MIT license.": r"\bmit\b",
    "Licensed under the Apache License, Version 2.0.": APACHE,
    "This work is licensed under the GNU General Public License, version 3.": GPL3,
    "Licensed under CC BY-NC 4.0.": CC_BY_NC,
    "Licensed under CC BY 4.0.": CC_BY,
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": CC_BY,
    **{t: APACHE for label, t in TEMPLATES if label == "apache-2.0" and t.startswith("you may")},
    **{t: GPL for label, t in TEMPLATES if label == "gpl"},
}

SCANNED = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, "
    "found array<struct<block: int, label: string, containment: double>>"
)


def _byte_map() -> bytes:
    """A-Z to a-z; what is in no word to a space, but line ends stay."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        if c.isalpha():
            out[b] = ord(c.lower())
        elif not c.isdigit() and c != "\n":
            out[b] = 32
    return bytes(out)


BYTE_MAP = _byte_map()
PARAGRAPH_END = re.compile(rb"\n *(?:\n *)+").split


def plain(text: object) -> bytes:
    """Lower-cased words between spaces, lines kept."""
    return text.encode("utf-8", "surrogatepass").translate(BYTE_MAP) if isinstance(text, str) else b""


def word_set(text: str) -> frozenset[bytes]:
    return frozenset(plain(text).split())


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of every line with words, then of every paragraph of several lines."""
    for line in text.split(b"\n"):
        if words := line.split():
            yield words
    for paragraph in PARAGRAPH_END(text):
        if b"\n" in paragraph.strip(b"\n "):
            yield paragraph.split()


class TemplateIndex:
    """Templates as frequency-ordered word lists, indexed by their prefix words."""

    def __init__(
        self, templates, frequency: Mapping[bytes, int], threshold: float, names: Mapping[str, str] | None = None
    ):
        self.names = [re.compile(names[t].encode()) if names and t in names else None for _, t in templates]
        self.close = names is not None
        self.spread = [2 * len(plain(t).split()) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.sets = [word_set(text) for _, text in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        words = sorted(frozenset().union(*self.sets), key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(words)}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, members in enumerate(self.sets):
            ordered = sorted(members, key=self.order.__getitem__)
            for i, w in enumerate(ordered[: len(ordered) - self.need[t] + 1]):
                self.prefix.setdefault(w, []).append((t, i))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of every template the block contains well enough."""
        present = self.order.keys() & words
        if present.isdisjoint(self.prefix):
            return
        block, seen = sorted(present, key=self.order.__getitem__), set()
        for j, w in enumerate(block):
            for t, i in self.prefix.get(w, ()):
                need, members = self.need[t], self.sets[t]
                if t in seen or len(block) < need:
                    continue
                seen.add(t)
                if 1 + min(len(members) - i - 1, len(block) - j - 1) < need:
                    continue  # not enough can follow its first shared word
                shared = len(members & present)
                if shared >= need and self.close:
                    shared = most_around(words, members, self.names[t], self.spread[t])
                if shared >= need:
                    yield t, shared / len(members)


def most_around(words: list[bytes], members: frozenset[bytes], name: re.Pattern[bytes] | None, spread: int) -> int:
    """The most ``members`` among ``spread`` consecutive words (that hold a match of ``name``, if there is one)."""
    spans: deque[tuple[int, int]] = deque()
    if name is not None:
        line = b" ".join(words)
        at = seen = 0  # words up to the character ``seen``
        for match in name.finditer(line):
            first = at + line.count(b" ", seen, match.start())
            at, seen = first + line.count(b" ", match.start(), match.end()), match.end()
            spans.append((first, at))
        if not spans:
            return 0
    most, named, held = 0, -1, Counter()
    for end, word in enumerate(words):
        if word in members:
            held[word] += 1
        start = end - spread + 1
        if start > 0 and (gone := words[start - 1]) in members:
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
        while spans and spans[0][1] <= end:
            named = spans.popleft()[0]
        if name is None or named >= max(0, start):
            most = max(most, len(held))
    return most


class PhraseFinder:
    def __init__(self, phrases: Mapping[str, str]):
        self.phrases = [(plain(p).split(), label) for p, label in phrases.items()]

    def places(self, words: list[bytes], present: set[bytes]) -> Iterator[tuple[int, str]]:
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                n = len(phrase)
                for i, w in enumerate(words):
                    if w == phrase[0] and words[i : i + n] == phrase:
                        yield i, label


def word_frequency(docs: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """In how many rows of ``docs`` each of the few given words stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words.intersection(plain(text).split()))
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    rows = docs.select("text").mapInPandas(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}  # at most one row per template word


def scan_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = 0.8,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per row: word count, phrase places and every matching block (its number
    among the lines, then paragraphs, of the text) with label and containment.
    ``names``: patterns by template text, such as ``NAMES``."""
    ship_package(docs.sparkSession)
    frequency = word_frequency(docs, frozenset().union(*(word_set(text) for _, text in templates)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, finder = TemplateIndex(templates, frequency, threshold, names), PhraseFinder(phrases)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                text = plain(text)
                words = text.split()
                present = set(words)
                places = list(finder.places(words, present))
                starts = [i for i, _ in places]
                found = []
                if not present.isdisjoint(index.prefix):
                    for number, block in enumerate(blocks(text)):
                        found += [(number, index.labels[t], c) for t, c in index.matches(block)]
                first, last = (min(starts), max(starts)) if starts else (None, None)
                rows.append((doc_id, len(words), len(places), first, last, sorted({x for _, x in places}), found))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "found"]
    return docs.select("doc_id", "text").mapInPandas(run, SCANNED)


def label_list(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
