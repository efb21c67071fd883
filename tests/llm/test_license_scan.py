import math
import random
import re

import pytest

from curbwatch.llm.license_scan import NAMES, PHRASES, TEMPLATES, TemplateIndex, blocks, plain, scan_licenses

from .data import LOWER, edge_rows, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts():
    rng, out = random.Random(3), [t for _, t in edge_rows()]
    for _, template in TEMPLATES:
        words = template.split()
        for keep in (1.0, 0.85, 0.79, 0.5):
            some = [w for w in words if rng.random() < keep]
            rng.shuffle(some)
            line = " ".join([*prose(rng, 3).split(), *some, *prose(rng, rng.randint(0, 30)).split()])
            half = len(some) // 2
            wrapped = " ".join(some[:half]) + "\n" + " ".join(some[half:])
            out += [f"first line\n{line}\nlast", f"text\n\n{wrapped}\n\nmore text", f"text\n{wrapped}"]
    out += ["CC-BY cc by CC\nBY", "All rights\nreserved. all rights reserved", "GNU General Public License"]
    return out


def plain_scan(text):
    """(words, places, blocks found) by comparing every block with every template."""
    text = (text or "").translate(LOWER)
    words = WORDS.findall(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    blocks = [b for b in (WORDS.findall(x) for x in text.split("\n")) if b]
    flat = re.sub(r"[\x00-\x09\x0b-\x2F\x3A-\x60\x7B-\x7F]", " ", text)
    blocks += [WORDS.findall(p) for p in re.split(r"\n *(?:\n *)+", flat) if "\n" in p.strip("\n ")]
    found = []
    for n, block in enumerate(blocks):
        for label, template in TEMPLATES:
            members = set(WORDS.findall(template.translate(LOWER)))
            shared = len(members & set(block))
            if shared >= max(1, math.ceil(0.8 * len(members) - 1e-9)):
                found.append((n, label, shared / len(members)))
    return len(words), sorted(places), sorted(found)


def test_every_matching_block_is_found(spark):
    rows = list(enumerate(texts()))
    scanned = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    for r in scanned.collect():
        n, places, found = plain_scan(rows[r["doc_id"]][1])
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert sorted(tuple(f) for f in r["found"]) == found
        assert r["base_labels"] == sorted({x for _, x in places})
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_other_thresholds(spark, threshold):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "released the license")], "doc_id bigint, text string")
    labels = {r["doc_id"]: {f["label"] for f in r["found"]} for r in scan_licenses(docs, threshold=threshold).collect()}
    assert "mit" in labels[1] and ("mit" in labels[2]) == (threshold == 0.5)


def test_edge_tables(edge_docs, no_docs):
    assert scan_licenses(edge_docs).count() == len(edge_rows())
    assert scan_licenses(no_docs).collect() == []


NOTICES = [
    ("Licensed under CC BY 4.0.", {"cc-by-4.0"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("Licensed under CC BY-SA 4.0.", set()),
    ("Licensed under CC BY-NC-SA 4.0.", set()),
    ("Licensed under CC BY-NC 3.0.", set()),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", set()),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by-4.0"}),
    ("Released under the Apache License.", set()),
    ("Released under the MIT License.", {"mit"}),
    ("This project is licensed under the terms of the BSD license.", set()),
    ("Licensed under the Apache License, Version 1.1.", set()),
    ("Licensed under version 2.0 of the Apache License.", {"apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", set()),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", set()),
    ("This work is licensed under the GNU General Public License (GPL), version 3 or later.", {"gpl-3.0"}),
    ("This work is licensed under version 3 of the GNU General Public License.", {"gpl-3.0"}),
    # scattered over a long line; near each other in one
    ("MIT " + "word " * 30 + "released " + "word " * 30 + "under the " + "word " * 30 + "license", set()),
    ("word " * 99 + "the license, released under " + "word " * 99, set()),
    ("word " * 99 + "Released by its authors under the MIT License. " + "word " * 99, {"mit"}),
    # templates that name no licence are found by words that stand together
    (" ".join(("word " * 40 + w) for w in reversed(TEMPLATES[2][1].split())), set()),
    ("word " * 99 + TEMPLATES[2][1] + " word" * 99, {TEMPLATES[2][0]}),
    ("some text\n\nReleased under\nthe MIT License.\n\nmore", {"mit"}),
    *((template, {label}) for label, template in TEMPLATES),
]


def test_a_notice_must_name_its_licence(spark):
    rows = [(i, text) for i, (text, _) in enumerate(NOTICES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in scan_licenses(docs, names=NAMES).collect():
        text, labels = NOTICES[r["doc_id"]]
        assert {f["label"] for f in r["found"]} == labels, text


def test_names_are_of_templates_and_only_drop_matches():
    assert set(NAMES) <= {t for _, t in TEMPLATES}
    every, named = TemplateIndex(TEMPLATES, {}, 0.8), TemplateIndex(TEMPLATES, {}, 0.8, NAMES)
    for text in texts():
        for block in blocks(plain(text or "")):
            found = dict(every.matches(block))
            assert all(c <= found[t] for t, c in named.matches(block))
