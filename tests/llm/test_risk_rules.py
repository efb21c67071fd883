import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curbwatch.llm.risk_rules import RULES, binomial_tail, certified_cutoffs, judge_documents, kept_documents, with_facts

from .data import WORD, edge_rows

LABELS = "doc_id bigint, quality int, toxic int"


def facts_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def test_facts_against_brute_force(edge_docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    rows = with_facts(edge_docs, "counted").select("text", *(f"counted.{n}" for n in names)).collect()
    for r in rows:
        assert tuple(r)[1:] == facts_of(r["text"])


@pytest.mark.parametrize("n,rate", [(50, 0.1), (400, 0.01), (3000, 0.002)])
def test_binomial_tail_is_exact(spark, n, rate):
    ks = range(0, math.ceil(n * rate))
    rows = spark.range(len(ks)).select("id", binomial_tail(F.col("id"), F.lit(n).cast("long"), rate).alias("p")).collect()
    for r in rows:
        exact = math.fsum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(r["id"] + 1))
        assert r["p"] == pytest.approx(exact, rel=1e-9)


def labelled(spark, good, bad, good_over=0):
    """Facts and labels: symbol shares of 0 (good; ``good_over`` of them 0.06) and 0.5 (bad)."""
    rows = [(i, "en", 100, 500, 30 if i < good_over else 0) for i in range(good)]
    rows += [(good + i, "en", 100, 500, 250) for i in range(bad)]
    facts = spark.createDataFrame(rows, "doc_id bigint, lang string, w bigint, c bigint, s bigint").selectExpr(
        "doc_id", "lang",
        "named_struct('n_words', w, 'word_chars', c, 'n_symbols', s, 'n_dup_lines', 0L, 'n_repeat_words', 0L,"
        " 'n_lines', 5L, 'n_capitals', 0L) AS facts",
    )
    return facts, spark.createDataFrame([(i, int(i < good), 0) for i in range(good + bad)], LABELS)


def test_cutoffs_need_enough_labels(spark):
    # one stratum: (1 - 0.005) ** n must reach 0.05 / 4
    assert certified_cutoffs(*labelled(spark, 870, 50)).collect() == []
    (row,) = certified_cutoffs(*labelled(spark, 880, 50)).collect()
    assert row["stratum"] == "en" and row["cut_symbols"] == 0.3 and row["cut_capitals"] is None


def test_cutoffs_that_reject_good_documents_are_not_certified(spark):
    """60 of 9000 good documents lie at 0.06: more than the rule's risk of 1 in 200."""
    risk = 0.02 / len(RULES)
    tail = math.fsum(math.comb(9000, i) * risk**i * (1 - risk) ** (9000 - i) for i in range(61))
    assert tail > 0.05 / len(RULES)
    (row,) = certified_cutoffs(*labelled(spark, 9000, 50, good_over=60)).collect()
    assert row["cut_symbols"] > 0.06


def test_false_rejections_stay_below_the_risk(spark):
    facts, labels = labelled(spark, 9000, 300, good_over=5)
    (row,) = certified_cutoffs(facts, labels).collect()
    over = facts.join(labels, "doc_id").where(f"quality = 1 AND facts.n_symbols / 500 > {row['cut_symbols']}").count()
    assert over <= 0.005 * 9000


def test_small_strata_are_judged_together(spark):
    facts, labels = labelled(spark, 3000, 90)
    lang = "CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'b' WHEN doc_id % 3 = 1 THEN NULL ELSE 'c' END"
    facts = facts.withColumn("lang", F.expr(lang))
    many = {r["stratum"]: r["cut_symbols"] for r in certified_cutoffs(facts, labels).collect()}
    assert many == dict.fromkeys(["a", "b", "c", None], 0.3)  # 1000 or 500 good ones each, 3000 in all
    some = facts.where("lang <> 'a'").where("doc_id < 1200 OR doc_id >= 3000")
    assert certified_cutoffs(some, labels).collect() == []  # 600 good ones


def test_cutoffs_act_and_hold_on_labels_not_used(spark):
    """On a given table: certified on half of the labels, counted on the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    facts = with_facts(docs.select("doc_id", "lang", "text")).drop("text").cache()
    judged = judge_documents(docs, labels).where("NOT base_failed")
    assert judged.where("NOT kept").count() > 0
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    cutoffs = certified_cutoffs(facts, labels.where(half), risk=0.04)
    from curbwatch.llm.risk_rules import judged as apply

    unseen = apply(facts, cutoffs).where("NOT base_failed").join(labels.where(~half), "doc_id")
    rates = unseen.groupBy("lang").agg(F.avg(F.when(F.col("quality") == 1, (~F.col("kept")).cast("int"))).alias("wrong"))
    assert all(r["wrong"] is None or r["wrong"] < 0.04 for r in rates.collect())
    facts.unpersist()


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (11, 0, 0), (None, 1, 0), (99, None, None)], LABELS)
    rows = judge_documents(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        n, _, _, _, repeated, _ = next(f for f in map(facts_of, (t for i, t in edge_rows() if i == r["doc_id"])) if f[0] == r["facts"]["n_words"])
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and r["kept"] == (not r["base_failed"])
    kept = kept_documents(edge_docs, labels)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in rows if r["kept"])
    assert judge_documents(no_docs, labels).collect() == []
    assert judge_documents(edge_docs, labels.limit(0)).count() == len(edge_rows())
