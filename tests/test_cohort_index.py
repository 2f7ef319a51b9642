"""Value codes and bitmaps: the scan gets the interval, values join nothing, cases are not shuffled, any filters agree."""

import random

import pytest

from cellguard.operators import cohort_index as X
from cellguard.operators.filters import RangeFilter, ValueFilter, select_cases


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    values = [(1000 * i + v, i, str(n), n) for i in (1, 2, 3) for v, n in enumerate([5.0, -2.0, 10.0, 0.5, 7.25, 100.0])]
    values += [(3900, 3, "some text", None), (3901, 3, "other", None)]
    variable = [(f"s{c}", v[1], v[0]) for c in range(70_000) for v in [rng.choice(values[:6])]]
    variable += [(f"s{c}", v[1], v[0]) for c in range(0, 70_000, 2) for v in [rng.choice(values[6:12])]]
    variable += [(f"s{c}", v[1], v[0]) for c in range(0, 70_000, 5) for v in rng.sample(values[12:], 2)]
    value = spark.createDataFrame(values, "id long, item int, name string, name_numeric double")
    variable = spark.createDataFrame(variable, "case string, item int, value long").cache()
    codes = X.value_codes(value).cache()
    coded = X.write_coded(X.coded_variable(variable, codes), str(tmp_path_factory.mktemp("coded") / "t"))
    return variable, value, codes, coded


FILTERS = [[RangeFilter(1, "0", "8")], [RangeFilter(2, None, "0.5")], [RangeFilter(3)], [RangeFilter(3, "-5", None)],
           [ValueFilter(3, (3900, 3000))], [ValueFilter(1, (42,))], [RangeFilter(1, "11", "99")],
           [RangeFilter(1, "5", None), RangeFilter(2, "0", "10"), ValueFilter(3, (3901, 3002, 3003))],
           [RangeFilter(1, "0", None), RangeFilter(1, None, "6")], []]


def cases(df):
    return sorted(r["case"] for r in df.collect())


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_filters_agree(spark, tables, k):
    variable, value, codes, coded = tables
    want = cases(select_cases(variable, value, FILTERS[k]))
    assert cases(X.select_cases_coded(coded, codes, FILTERS[k])) == want


def test_bitmaps_agree(spark, tables):
    variable, value, codes, coded = tables
    numbers = X.case_numbers(variable.select("case").distinct()).cache()
    index = X.case_bitmaps(coded, numbers).cache()
    assert numbers.select("bucket").distinct().count() == 3
    for fs in FILTERS:
        want = cases(select_cases(variable, value, fs))
        chosen = X.select_bitmaps(index, codes, fs)
        assert X.count_cases(chosen).first()["n"] == len(want) and cases(X.cases_of(chosen, numbers)) == want


def test_the_scan_gets_the_interval_and_values_join_nothing(spark, tables):
    _, _, codes, coded = tables
    plan = X.select_cases_coded(coded, codes, [RangeFilter(1, "0", "8")])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(code,1)" in plan and "LessThanOrEqual(code,3)" in plan and "PartitionFilters: [isnotnull(item" in plan
    assert "Join" not in plan and "hashpartitioning(value" not in plan and "hashpartitioning(case" in plan
    codes_of = {(r["item"], r["value"]): r["code"] for r in codes.collect()}
    assert [codes_of[1, 1000 + v] for v in (1, 3, 0, 4, 2, 5)] == [0, 1, 2, 3, 4, 5] and codes_of[3, 3901] == 6
