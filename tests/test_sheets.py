"""Sheets by position, nested rows, and the two options of the loader and the export."""

import pytest
from pyspark.sql import functions as F

from cellguard.config import LoadConfig
from cellguard.plans.load import column_rules
from cellguard.sources.files import nested_rows, scan_sheet_folder


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "one.csv").write_text("Id,Name,\n,,Unit\nid,name,unit\n1,ann,kg\nid,name,unit\n,, \n2,\"b\nob\",m,extra\n")
    (tmp_path / "two.csv").write_text("\ufeffName,Other,Id\n,,\nx,y,z\neve,q,3\n", encoding="utf-8")
    (tmp_path / "void.csv").write_text("")
    return str(tmp_path / "*.csv")


def rows(df):
    return df.columns, sorted((tuple(r) for r in df.collect()), key=str)


def test_three_header_rows_go_by_position(spark, folder):
    cols, got = rows(scan_sheet_folder(spark, folder, header_rows=2))
    assert cols == ["Id", "Name", "Unit", "Other", "SheetName"]
    assert got == sorted([
        ("id", "name", "unit", None, "one"), ("1", "ann", "kg", None, "one"), ("id", "name", "unit", None, "one"),
        (None, None, " ", None, "one"), ("2", "b\nob", "m", None, "one"), ("z", "x", None, "y", "two"),
        ("3", "eve", None, "q", "two")], key=str)
    cols, got = rows(scan_sheet_folder(spark, folder, header_rows=2, drop_empty=True, ignore=["other", "unit"], sheet_col=None))
    assert cols == ["Id", "Name"] and len(got) == 6
    assert got.count(("id", "name")) == 2 and (None, None) not in got
    cols, got = rows(scan_sheet_folder(spark, folder, header_rows=3, ignore=[2]))
    assert cols == ["id", "name", "x", "y", "SheetName"] and ("id", "name", None, None, "one") in got


def test_columns_by_name_and_position(spark, folder):
    cols, got = rows(scan_sheet_folder(spark, folder, header_rows=2, keep=["NAME", "Id"]))
    assert cols == ["NAME", "Id", "SheetName"] and ("eve", "3", "two") in got and ("b\nob", "2", "one") in got
    cols, got = rows(scan_sheet_folder(spark, folder, header_rows=1, keep=["Id"], ignore_case=False))
    assert cols == ["Id", "SheetName"] and ("1", "one") in got and ("3", "two") in got


def test_nested_rows(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": "y"}, [(1, "p"), (2, "q")], ["u", "v"], [["1", "2"], ["3"]]),
                                (2, {"b": "z"}, [], None, [])],
                               "k int, m map<string,string>, s array<struct<n: int, t: string>>, l array<string>, ll array<array<string>>")
    assert rows(nested_rows(df, "k", "m", ["b", "a"])) == (["k", "b", "a"], [(1, "y", "x"), (2, "z", None)])
    assert rows(nested_rows(df, "k", "s")) == (["k", "n", "t"], [(1, 1, "p"), (1, 2, "q")])
    assert rows(nested_rows(df, "k", "l")) == (["k", "l"], [(1, "u"), (1, "v")])
    assert rows(nested_rows(df, "k", "ll", width=2)) == (["k", "c1", "c2"], [(1, "1", "2"), (1, "3", None)])
    assert rows(nested_rows(df.select("k", F.struct("k", "l").alias("st")), "k", "st", ["k"]))[1] == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        nested_rows(df, "k", "m")


def test_whole_years_option(spark):
    d = spark.createDataFrame([(0, "smoking_years", ""), (1, "age_bl", ""), (2, "birth_date", "")], "seq int, name string, values string")

    def kinds(**how):
        found = column_rules(spark, ["smoking_years", "age_bl", "birth_date"], d, LoadConfig(**how))
        return {r["col"]: r["kind"] for r in found.collect()}

    assert kinds() == {"smoking_years": "year", "age_bl": "age", "birth_date": "date"}
    assert kinds(round_years=1) == {"smoking_years": "int_only", "age_bl": "age", "birth_date": "date"}
