import pytest
from pyspark.errors import AnalysisException

from curbwatch.functions import apply_filters, emitted_kinds, fine_report_params, split_type_filter
from curbwatch.operators import KINDS


def _ids(df):
    return sorted(int(r["ID"]) for r in df.select("ID").collect())


@pytest.mark.parametrize(
    "filters,ids",
    [
        (None, list(range(1, 13))),
        ({}, list(range(1, 13))),
        ({"TYPE": 6}, [1, 2]),
        ({"TYPE": {"$in": [1, 5]}}, [6, 7, 8, 9, 10]),
        ({"TYPE": {"$in": []}}, []),
        ({"TYPE": {"$in": [6, None]}}, [1, 2]),
        ({"SECTOR_NAME": None}, []),
        ({"SECTOR_NAME": ""}, [4]),
        ({"sector_name": "East"}, [11, 12]),
        ({"SECTOR_NAME": "North", "PLATE_SOURCE": "MANUAL_VALIDATION"}, [2, 7, 9]),
        ({"PLATE_SOURCE": "MANUAL_VALIDATION"}, [2, 5, 7, 9]),
        ({"FINE_TYPE": {"$in": [88, 99]}, "TYPE": {"$in": [7, None]}}, [5]),
    ],
)
def test_filter_semantics(edge, filters, ids):
    assert _ids(apply_filters(edge, filters)) == ids


@pytest.mark.parametrize(
    "bad",
    [
        {"TYPE": [6, 7]},
        {"TYPE": {"$nin": [6]}},
        {"TYPE": {}},
        {"TYPE": {"$in": [6], "$gt": 1}},
        {"TYPE": {"$in": 6}},
        {"TYPE": {"$in": [[6]]}},
        {"TYPE": {6, 7}},
    ],
)
def test_bad_filter_values_raise(edge, bad):
    with pytest.raises(ValueError):
        apply_filters(edge, bad)


def test_unknown_column_raises(edge):
    with pytest.raises(AnalysisException):
        apply_filters(edge, {"NOPE": 1}).collect()


def test_split_type_filter_is_pure():
    filters = {"TYPE": {"$in": [1]}, "SECTOR_NAME": "x"}
    entry, rest = split_type_filter(filters)
    assert entry == {"TYPE": {"$in": [1]}} and rest == {"SECTOR_NAME": "x"}
    assert filters == {"TYPE": {"$in": [1]}, "SECTOR_NAME": "x"}
    assert split_type_filter(None) == (None, {})


@pytest.mark.parametrize(
    "filters,kinds",
    [
        (None, ["PaidTransaction", "dropped", "fine"]),
        ({}, ["PaidTransaction", "dropped", "fine"]),
        ({"SECTOR_NAME": "x"}, []),
        ({"TYPE": 6}, []),
        ({"TYPE": 0}, []),
        ({"TYPE": None}, []),
        ({"TYPE": {"$in": []}}, []),
        ({"TYPE": {"$in": [7]}}, ["fine"]),
        ({"TYPE": {"$in": [5, 1]}}, ["PaidTransaction", "dropped"]),
        ({"TYPE": {"$in": [4, None]}}, []),
        ({"type": {"$in": [1]}}, []),
    ],
)
def test_emitted_kinds(filters, kinds):
    assert emitted_kinds(filters, KINDS) == kinds


def test_filter_clause_binds_values():
    from curbwatch.functions import filter_clause

    text, args = filter_clause({"SECTOR_NAME": "x' OR 1=1 --", "TYPE": {"$in": [1, None]}, "a`b{c}": {"$in": []}})
    assert text == "`SECTOR_NAME` = :f0 AND `TYPE` IN (:f1_0, :f1_1) AND FALSE"
    assert args == {"f0": "x' OR 1=1 --", "f1_0": 1, "f1_1": None}
    assert filter_clause(None) == ("TRUE", {})


def test_injection_text_is_a_value(edge):
    from curbwatch.operators import transaction_count

    assert transaction_count(edge, {"SECTOR_NAME": "North' OR '1'='1"}).collect()[0][0] == 0


def test_fine_report_params():
    assert fine_report_params() == {}
    assert fine_report_params(sector_name="North", fine_type=0) == {"sector_name": "North", "fine_type": 0}
    assert fine_report_params(start_date=1, end_date=2) == {"start_date": 1, "end_date": 2}
    for bad in (
        {"sector_name": "ab"},
        {"sector_name": "x" * 51},
        {"start_date": -1},
        {"end_date": "3"},
        {"fine_type": True},
        {"fine_type": 1.5},
    ):
        with pytest.raises(ValueError):
            fine_report_params(**bad)


@pytest.mark.parametrize("key", ["a.b", "a`b", "a{b}", "{d}", "src.TYPE", "`TYPE`", "x y", ":p"])
def test_odd_keys_mean_the_column_of_that_name_everywhere(spark, edge, key):
    """The filter and the reports agree: the named column if there is one, else the same error."""
    from curbwatch.operators import transaction_count

    with_column = edge.withColumn(key, edge["TYPE"])
    assert _ids(apply_filters(with_column, {key: 6})) == [1, 2]
    assert transaction_count(with_column, {key: 6}).collect()[0][0] == 2
    for run in (apply_filters, transaction_count):
        with pytest.raises(AnalysisException) as e:
            run(edge, {key: 6}).collect()
        assert e.value.getCondition().startswith("UNRESOLVED_COLUMN")


@pytest.mark.parametrize("filters", [{"TYPE": {"$in": []}}, {"SECTOR_NAME": None}])
def test_filters_that_nothing_passes(edge, filters):
    assert apply_filters(edge, filters).count() == 0


@pytest.mark.parametrize("filters", [{"SECTOR_NAME": "North"}, {"TYPE": 6}])
def test_type_distribution_needs_a_type_list(edge, filters):
    from curbwatch.operators import transaction_type_distribution

    assert transaction_type_distribution(edge, filters).collect() == []
