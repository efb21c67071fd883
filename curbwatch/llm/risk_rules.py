"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Facts are counted over the whole text of every document. Each rule rejects a
document whose fact lies above a cutoff. Which cutoffs may be used is decided
on labelled documents, per stratum (language): a cutoff is *certified* when an
exact binomial test shows that it rejects less than ``risk / rules`` of the
stratum's good documents. A rule's cutoffs are nested, so they are tested in
fixed order from lax to strict, each at the full level of the rule: a stricter
one rejects no fewer, so the first that fails ends the row. The level is
``alpha`` divided by rules times strata (Bonferroni), so with probability ``1 -
alpha`` all rules together falsely reject less than ``risk`` of the good
documents of every stratum, whichever certified cutoffs are used. Of those the
one that pays best is taken: bad documents rejected minus ``cost`` times good
ones, the laxer of equals.

A stratum needs a number of good labels to certify anything at all. Strata
that have fewer are judged together as one, which the guarantee then is about;
if that is still too small, only the fixed base rules hold there.

The facts of all documents are written once, narrow; the labelled counts are
one aggregation with partial sums; the cutoffs (at most one row per stratum
with thousands of labels) are joined back.

Defined cases: null text has no words and fails the base rules; a null stratum
is a stratum of its own; labels that contradict each other for a doc_id are
left out; repeated rows are judged each on its own; without usable labels the
base rules alone decide; the order of words and ties play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 5
SYMBOLS = "#*$%&|<>"  # fixed value: the characters counted as symbols
BLANK = r"[\x20\x09-\x0D]+"  # fixed value: what separates words
BLANK_CHARS = " \t\n\x0b\x0c\r"

# rule -> (value from the facts, cutoffs from strict to lax)
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.7)),
}


def with_facts(docs: DataFrame, name: str = "facts") -> DataFrame:
    """``docs`` with a struct column of counts. Every step is a projection of
    its own, so shared values (words, window hashes) are computed once."""
    taken = set(docs.columns)
    tmp = {k: _free(f"_{k}", taken) for k in ("text", "trim", "words", "lines", "keys", "sorted", "spots", "n")}
    c = {k: F.col(f"`{v}`") for k, v in tmp.items()}
    none = F.array().cast("array<string>")
    df = docs.withColumn(tmp["text"], F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn(tmp["trim"], F.btrim(c["text"], F.lit(BLANK_CHARS)))
    df = df.withColumns(
        {
            tmp["words"]: F.when(c["trim"] == "", none).otherwise(F.split(c["trim"], BLANK)),
            tmp["lines"]: F.filter(F.split(c["text"], "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != ""),
        }
    )
    df = df.withColumn(tmp["n"], F.size(c["words"]))
    df = df.withColumn(tmp["keys"], _window_keys(c["words"], c["n"]))
    repeated = F.size(F.array_distinct(c["keys"])) < F.size(c["keys"])
    places = F.sort_array(F.transform(c["keys"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(tmp["sorted"], F.when(repeated, places))  # few texts repeat a window
    df = df.withColumn(tmp["spots"], _repeated_spots(c["sorted"]))
    stripped = c["text"]
    for symbol in SYMBOLS:
        stripped = F.replace(stripped, F.lit(symbol), F.lit(""))
    capitals = F.translate(c["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    facts = F.struct(
        c["n"].cast("long").alias("n_words"),
        F.char_length(F.array_join(c["words"], "")).cast("long").alias("word_chars"),
        (F.octet_length(c["text"]) - F.octet_length(stripped)).cast("long").alias("n_symbols"),
        (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long").alias("n_dup_lines"),
        _covered(c["spots"]).alias("n_repeat_words"),
        F.size(c["lines"]).cast("long").alias("n_lines"),
        (F.octet_length(c["text"]) - F.octet_length(capitals)).cast("long").alias("n_capitals"),
    )
    return df.withColumn(name, facts).drop(*tmp.values())


def _free(name: str, taken: set[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def _window_keys(words: Column, n: Column) -> Column:
    """Hashes of all windows of five words, in text order."""
    word_keys = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    packed = F.struct(word_keys.alias("k"), starts.alias("s"))
    # a one-element array binds the word hashes to a lambda variable, so they are hashed once per text
    return F.flatten(
        F.transform(F.array(packed), lambda p: F.transform(p["s"], lambda i: F.xxhash64(*[F.get(p["k"], i + j) for j in range(WINDOW)])))
    )


def _repeated_spots(places: Column) -> Column:
    """Ascending starts of the windows whose key occurs more than once."""
    same = F.transform(
        places,
        lambda p, j: F.when(
            F.coalesce(F.get(places, j - 1)["h"] == p["h"], F.lit(False))
            | F.coalesce(F.get(places, j + 1)["h"] == p["h"], F.lit(False)),
            p["i"],
        ),
    )
    return F.sort_array(F.array_compact(same))


def _covered(spots: Column) -> Column:
    """Number of words inside the windows that start at the ascending ``spots``."""
    widths = F.transform(
        spots, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(spots, k + 1) - p, F.lit(WINDOW))).cast("long")
    )
    return F.coalesce(F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def base_failed(facts: str = "facts") -> Column:
    """The fixed rules: under 10 words, or over a fifth of the words in repeated windows."""
    return (F.col(f"{facts}.n_words") < 10) | (
        100 * F.col(f"{facts}.n_repeat_words") > 20 * F.col(f"{facts}.n_words")
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), exactly, term by term in logarithms.
    From k >= n * rate on it is about a half or more: given as 1."""
    odds = F.log(F.lit(rate / (1 - rate)))
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        start,
        lambda a, i: F.struct(
            (a["t"] + F.log((n - i) / (i + 1)) + odds).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")
        ),
        lambda a: a["s"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(total)


def certified_cutoffs(
    facts: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    risk: float = 0.02,
    alpha: float = 0.05,
    cost: float = 10.0,
) -> DataFrame:
    """One row per stratum with a certified cutoff: ``stratum`` and a column
    ``cut_<rule>`` per rule, null where nothing was certified. Strata that were
    judged together have the same cutoffs.

    ``facts``: doc_id, the stratum's column and the struct ``facts``.
    """
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    labels = labels.where("lo = hi").select("doc_id", F.col("lo").alias("quality"))
    rows = facts.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), "facts.*").join(labels, "doc_id")
    tests = [(rule, cut) for rule, (_, cuts) in RULES.items() for cut in cuts]
    sums = []
    for i, (rule, cut) in enumerate(tests):
        over = F.expr(RULES[rule][0]) > cut
        for good in (1, 0):
            sums.append(F.count(F.when(over & (F.col("quality") == good), 1)).alias(f"{'bad good'.split()[good]}{i}"))
    counts = rows.groupBy("stratum").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("n"), *sums)
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy()))  # rows: strata
    rate = risk / len(RULES)
    # with fewer good labels not even a cutoff that rejects none of them passes
    needed = F.log(alpha / len(RULES) / F.col("strata")) / F.log(F.lit(1 - rate))
    counts = counts.withColumn("small", F.col("n") < needed).withColumn("own", F.when(~F.col("small"), F.col("stratum")))
    every = ["n", *(f"{kind}{i}" for i in range(len(tests)) for kind in ("good", "bad"))]
    groups = counts.groupBy("small", "own").agg(*(F.sum(c).alias(c) for c in every))
    groups = groups.withColumn("strata", F.count("*").over(Window.partitionBy()))
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(cut).alias("cut"),
                    F.col(f"good{i}").alias("good"),
                    F.col(f"bad{i}").alias("bad"),
                )
                for i, (rule, cut) in enumerate(tests)
            ]
        )
    )
    cells = groups.select("small", "own", "n", "strata", cells.alias("c")).select("*", "c.*")
    tail = binomial_tail(F.col("good"), F.col("n"), rate)
    # a cutoff that passes is behind none that failed: laxer ones reject no more good documents
    certified = cells.where((F.col("bad") > 0) & (tail <= F.lit(alpha / len(RULES)) / F.col("strata")))
    gain = F.col("bad") - cost * F.col("good")
    best = certified.groupBy("small", "own", "rule").agg(F.max(F.struct(gain.alias("gain"), "cut")).alias("best"))
    best = best.where("best.gain > 0")
    best = best.groupBy(F.col("small").alias("best_small"), F.col("own").alias("best_own")).agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("best.cut"))).alias(f"cut_{rule}") for rule in RULES]
    )
    same = (F.col("small") == F.col("best_small")) & F.col("own").eqNullSafe(F.col("best_own"))
    return counts.join(best, same).select("stratum", *(f"cut_{rule}" for rule in RULES))


def judged(rows: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``rows`` (with ``facts``) and the columns base_failed and kept."""
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), F.struct(*[f"cut_{r}" for r in RULES]).alias("_cuts"))
    joined = rows.join(cuts, F.col(f"`{stratum}`").eqNullSafe(F.col("_stratum")), "left")
    over = F.lit(False)
    for rule, (value, _) in RULES.items():
        value = value
        for fact in ("n_symbols", "word_chars", "n_repeat_words", "n_words", "n_dup_lines", "n_lines", "n_capitals"):
            value = value.replace(fact, f"facts.{fact}")
        over = over | F.coalesce(F.expr(value) > F.col(f"_cuts.cut_{rule}"), F.lit(False))
    # as one CASE over both sides of the join, a filter on ``kept`` is not split and moved below the facts
    kept = F.when(base_failed(), F.lit(False)).otherwise(~over)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("_stratum", "_cuts")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Texts are not shuffled: the
    facts are written narrow to find the cutoffs and counted again where the rows are judged."""
    facts = written(with_facts(docs.select("text", "doc_id", stratum)).drop("text"))
    cutoffs = written(certified_cutoffs(facts, labels, stratum, **risk))
    packed = docs.select(F.struct("*").alias("row"), "text", "doc_id", stratum)  # own names can't clash
    return judged(with_facts(packed), cutoffs, stratum).where("kept").select("row.*")


def judge_documents(docs: DataFrame, labels: DataFrame, columns: Sequence[str] = ("doc_id", "lang"), **risk) -> DataFrame:
    """The named columns of every row with facts, base_failed and kept."""
    facts = written(with_facts(docs.select("text", *columns)).drop(*({"text"} - set(columns))))
    return judged(facts, certified_cutoffs(facts, labels, **risk))
