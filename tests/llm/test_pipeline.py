"""The stages one by one against plain models, on whole small tables."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from curbwatch.llm import queries as corpus_queries
from curbwatch.llm.common import read_table
from curbwatch.llm.word_tokens import WordTokens, read_definition
from tools.oracle_check import compare, duck_connection

from .data import jaccard_groups
from .test_risk_rules import facts_of

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of every stage."""
    docs, out = read_table(spark, SF001, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF001).cache()
        out.append((name, docs, result))
        docs = result
    return out


def test_filtering_stages_return_the_columns_of_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert not set(rows_of(after)) - set(rows_of(before))


def test_rules_stage_drops_what_fails_the_base_rules(stages):
    _, before, after = stages[1]
    kept = [(i, t) for i, t in rows_of(before) if not (facts_of(t)[0] < 10 or 100 * facts_of(t)[4] > 20 * facts_of(t)[0])]
    assert sorted(rows_of(after)) == sorted(kept)  # 200 rows certify no further cutoff


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    _, before, after = stages[2]
    rows = sorted(rows_of(before))
    assert sorted(i for i, _ in rows_of(after)) == sorted(rows[min(g)][0] for g in jaccard_groups(rows))


def test_packing_stage_holds_every_token_of_every_document(stages):
    _, before, after = stages[3]
    tokens = WordTokens(read_definition(corpus_queries.tokenizer_path("word_bpe_49k.json")))
    want = {i: len(tokens.plain(t)) + 1 for i, t in rows_of(before)}
    got = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF001).columns) == sorted(stages[-1][2].columns)


def test_all_operators_are_registered():
    names = contract.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", sorted(corpus_queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duck_connection(SF01)
    ok, message = compare(spark, SF01, name, contract.queries()[name], corpus_queries.oracle_sql()[name], con)
    assert ok, message
