"""Small inputs and plain models of what the operators must give."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 60)
    words = base.split(" ")
    near = " ".join([*words[:58], "changed", "end"])
    return [
        (1, None),
        (2, ""),
        (3, " \n\t\r "),
        (4, "one two"),
        (4, "one two"),
        (5, "ONE two"),
        (None, "a text without an id that has words enough"),
        (None, None),
        (6, base),
        (7, base.upper().replace("É", "é").replace("Ñ", "ñ")),
        (8, near),
        (9, prose(rng, 9000)),
        (10, "x" * 50_000),
        (11, "#$%& " * 50 + "junk | junk"),
        (12, "word " * 300),
        (13, "same line here\n" * 20),
        (14, "\x00\x1c   \U0001f600 ﬁ İ ▁ <s> <|endoftext|>"),
        (15, base),
    ]


def words_of(text) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k: int = 5) -> set:
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_groups(rows: list[tuple], percent: int = 75) -> list[list[int]]:
    """Indices of the rows of each component of linked rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups: dict[int, list[int]] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def near_copies(seed: int, families: int, size: int) -> list[tuple]:
    """Families of texts with more and more words changed, sharing a passage."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 40), []
    for _ in range(families):
        words = prose(rng, rng.choice([12, 60, 150])).split(" ")
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 20))):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            text = " ".join(copy)
            rows.append((len(rows), text + "\n" + passage if rng.random() < 0.3 else text))
    return rows
