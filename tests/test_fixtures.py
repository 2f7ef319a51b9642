"""The reference README's examples end to end: dictionary + cohort CSV -> store; section files; checksums;
sheet stacking; CSV sink; precomputed results."""

import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from cellguard.config import ChartConfig, LoadConfig
from cellguard.plans.load import load_cohort
from cellguard.plans.precompute import precompute, read_precomputed
from cellguard.sources import files as S

DICT_CSV = """Name,Label,Description,Values,Domain
gender,Gender,Gender,1 = male||2 = female||. = missing,Demographics
degree,Highest Degree,Highest degree reported at first visit,0 = GED||1 = Bachelor||2 = Master||3 = Doctorate||. = Missing,Demographics
current_status,Enrollment,"Enrollment status within cohort (e.g., enrolled, deceased, etc.)",0 = Enrolled||1 = Deceased||2 = Disenrolled,Demographics
edu_yrs,Years of Education,Total years of education as of first visit,"Integers between 0 and 21||. = Missing",Demographics
"""

COHORT_CSV = """subject_id,gender,degree,current_status,edu_yrs,age_bl,age_fu,followup_years,intake_date
0,1,3,0,21,65,68,3,07/21/2013
1,2,1,2,16,65,92,27,09/09/1994
"""

ROLES = {"age_bl": "age_bl", "age_fu": "age_fu", "gender": "gender", "current_status": "enrollment",
         "followup_years": "followup_years"}


def _write(text, name):
    d = tempfile.mkdtemp(prefix="cellguard-test-")
    p = os.path.join(d, name)
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_readme_cohort_loads(spark):
    dictionary = S.scan_dictionary(spark, _write(DICT_CSV, "dict.csv"))
    assert [r.name for r in dictionary.orderBy("seq").collect()] == ["gender", "degree", "current_status", "edu_yrs"]
    cohort = S.scan_cohort(spark, _write(COHORT_CSV, "cohort.csv"))
    cfg = LoadConfig(datamodel_vars=ROLES, case_col="subject_id", age_min=30, age_max=100, age_step=5)
    st = load_cohort(cohort, dictionary, cfg)
    subj = sorted(tuple(r) for r in st.subjects.collect())
    assert subj == [("0", 65, 65, "male", "enrolled", 3), ("1", 65, 95, "female", "disenrolled", 27)]
    items = {r.varname: r for r in st.item.collect()}
    assert set(items) == {"gender", "degree", "current_status", "edu_yrs"}
    edu = items["edu_yrs"]
    assert (edu.range_start, edu.range_end, edu.range_step, edu.rounded) == (15.0, 25.0, 5.0, 5)
    assert edu.is_numeric and not items["gender"].is_numeric
    names = {(r.item, r.name) for r in st.value.collect()}
    assert {(1, "male"), (1, "female"), (2, "doctorate"), (2, "bachelor"), (2, "ged"), (4, "15"), (4, "25")} <= names
    var = {(r.case, r.item) for r in st.variable.collect()}
    assert var == {(c, i) for c in ("0", "1") for i in (1, 2, 3, 4)}
    cats = st.category.collect()
    assert [(c.id, c.name, c.order) for c in cats] == [(1, "Demographics", 0)]


def test_repeated_and_missing_ids_are_refused(spark):
    dictionary = S.scan_dictionary(spark, _write(DICT_CSV, "dict.csv"))
    cfg = LoadConfig(datamodel_vars=ROLES, case_col="subject_id", age_min=30, age_max=100, age_step=5)
    head, first, second = COHORT_CSV.strip().split("\n")[:3]
    for rows in ([first, second, first], [first, "," + second.split(",", 1)[1]]):
        cohort = S.scan_cohort(spark, _write("\n".join([head, *rows]) + "\n", "cohort.csv"))
        try:
            load_cohort(cohort, dictionary, cfg)
            raise AssertionError("ids that do not tell subjects apart were accepted")
        except ValueError as e:
            assert "case column" in str(e)


def test_lists_longer_than_a_thousand_values_are_kept(spark):
    rows = [(str(i), f"word{i}") for i in range(1500)]
    cohort = spark.createDataFrame(rows, "subject_id string, remark string")
    dictionary = spark.createDataFrame([(0, "remark", "Remark", "x" * 700, "", "Notes", 0)],
                                       "seq long, name string, label string, description string, values string, "
                                       "domain string, priority int")
    st = load_cohort(cohort, dictionary, LoadConfig(case_col="subject_id"))
    assert st.value.where("listed").count() == 1500
    item = st.item.collect()[0]
    assert item.is_loaded and item.range_start is None and len(item.description) == 700


def test_equal_numbers_share_a_value(spark):
    cohort = spark.createDataFrame([("a", "1"), ("b", "1.0"), ("c", "2.0")], "subject_id string, score string")
    dictionary = spark.createDataFrame([(0, "score", "Score", "", "", "Notes", 0)],
                                       "seq long, name string, label string, description string, values string, "
                                       "domain string, priority int")
    st = load_cohort(cohort, dictionary, LoadConfig(case_col="subject_id"))
    assert sorted(r.name for r in st.value.collect()) == ["1", "2.0"]
    assert st.variable.select("value").distinct().count() == 2


def test_dictionary_requires_fields(spark):
    p = _write("Name,Label\nx,y\n", "bad.csv")
    try:
        S.scan_dictionary(spark, p)
        raise AssertionError("missing columns accepted")
    except ValueError as e:
        assert "required" in str(e)


def test_section_files(spark):
    tabs = _write("# comment\n\nFAQ==2==header==What is the ABC study?\nFAQ==2==text==A==B\nHome==0==bold==Hi\n",
                  "tabs.txt")
    t = S.scan_sections(spark, tabs, "tabs").orderBy("line").collect()
    assert [(r.header, r.order, r.text_type, r.text) for r in t] == [
        ("FAQ", 2, "header", "What is the ABC study?"), ("FAQ", 2, "text", "A==B"), ("Home", 0, "bold", "Hi")]
    assert [r.line for r in t] == [2, 3, 4]
    com = _write("table==0==first\ntable==1==second\nother==0==x\n", "comments.txt")
    c = S.comments_for(S.scan_sections(spark, com, "comments"), "table").collect()
    assert [r.comment for r in c] == ["first", "second"]


def test_checksums_latest(spark):
    d = tempfile.mkdtemp(prefix="cellguard-files-")
    for i, body in enumerate([b"old", b"newest"]):
        p = os.path.join(d, f"f{i}.bin")
        with open(p, "wb") as fh:
            fh.write(body)
        os.utime(p, (1_000_000 + i, 1_000_000 + i))
    files = S.file_checksums(spark, d)
    row = S.latest_checksum(files).collect()[0]
    assert (row.type, row.value) == ("md5", hashlib.md5(b"newest").hexdigest())
    empty = S.latest_checksum(files.where("false")).collect()[0]
    assert empty.value == "Unavailable"


def test_stack_sheets(spark):
    a = spark.createDataFrame([("x", "1", "lab")], "Name string, Values string, Label string")
    b = spark.createDataFrame([("y", "2", ""), ("", "", "")], "NAME string, values string, label string")
    out = S.stack_sheets({"Demo": a, "Labs": b}, keep=["name", "values"], sheet_col="Domain", drop_empty=True)
    rows = sorted(tuple(r) for r in out.collect())
    assert out.columns == ["name", "values", "Domain"]
    assert rows == [("x", "1", "Demo"), ("y", "2", "Labs")]


def test_csv_sink_joins_multiline(spark):
    d = tempfile.mkdtemp(prefix="cellguard-csv-") + "/out"
    df = spark.createDataFrame([("a\nb", None)], "t string, u string")
    S.write_rows_csv(df.coalesce(1), d, join_multiline="||")
    back = spark.read.option("header", True).csv(d).collect()
    assert back[0].t == "a||b" and back[0].u in (None, "")


def test_precompute_roundtrip(spark):
    from cellguard.registry import store as RS
    from conftest import SF_SMALL

    st = RS.store(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="cellguard-pre-")
    cfg = ChartConfig(mask=5, jitter_salt=None)
    precompute(st, cfg, d)
    pre = read_precomputed(spark, d)
    assert pre["population"].collect()[0][0] == st.subjects.count()
    assert pre["null_subject_counts"].agg(F.sum(F.abs("value"))).collect()[0][0] == 0
    assert pre["chart_age_bl"].count() == pre["null_age_bl"].count() > 0


def test_chart_from_precomputed_equals_direct(spark):
    from cellguard.operators import filters as FL
    from cellguard.plans.chart import filter_chart
    from cellguard.registry import store as RS
    from conftest import SF_SMALL

    st = RS.store(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="cellguard-pre2-")
    precompute(st, RS.CFG_F, d)
    pre = read_precomputed(spark, d)
    for fs in (None, RS.F_AND, RS.F_EMPTY, RS.F_ALL):
        sel = FL.select_cases(st.variable, st.value, fs) if fs is not None else None
        a = filter_chart(st.subjects, RS.CFG_F, sel)
        b = filter_chart(st.subjects, RS.CFG_F, sel, precomputed=pre)
        for part in ("subject_counts", "age_bl", "age_fu"):
            assert sorted(tuple(r) for r in getattr(a, part).collect()) == \
                sorted(tuple(r) for r in getattr(b, part).collect()), (fs, part)


def test_store_write_read_roundtrip(spark):
    from cellguard.registry import store as RS
    from conftest import SF_SMALL

    st = RS.store(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="cellguard-store-") + "/store"
    S.write_store(st, d)
    assert os.path.isdir(os.path.join(d, "variable", "item=1"))  # partitioned by item
    back = S.read_store(spark, d)
    for name in ("variable", "value", "item", "category", "subjects"):
        a, b = getattr(st, name), getattr(back, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), name
