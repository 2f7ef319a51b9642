"""The study cohort derived from the driver's TPC-H-like tables (one subject per order).

``cohort_wide`` is shaped like the reference's input CSV (one row per subject, every column text) so that it can go
through the loader; ``subjects`` is the six-column chart table built directly with the raw ages. Both are plain
joins and aggregates over ``orders``, ``lineitem`` and ``customer``: their work grows with those tables.

Derivation (fixed): case = o_orderkey; age_bl = 30 + min(l_quantity); age_fu = 30 + max(l_quantity) (NULL for an
order without line items); sex from o_orderstatus (F female, O male, P other); enrollment = lower(c_mktsegment);
followup_years = age_fu - age_bl.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEX_BY_STATUS = {"F": "female", "O": "male", "P": "other"}
SEX_CODE_BY_STATUS = {"F": "1", "O": "2", "P": "3"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # partial aggregation map-side; one shuffle on l_orderkey
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_quantity").alias("q_min"),
            F.max("l_quantity").alias("q_max"),
            F.max("l_discount").alias("d_max"),
            F.avg("l_quantity").alias("q_avg"),
        )
    )


def _map_col(c, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v))) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def _fmt2(c: str):
    """Two-decimal text of a number; NULL stays NULL. Numbers that a decimal gives the same text for are cast, the others
    (zeros and what rounds to them have a sign, the very large and NaN no decimal) are formatted one by one."""
    x = F.abs(F.col(c))
    plain = (x >= 0.01) & (x < 1e12)
    return F.when(plain, F.col(c).try_cast("decimal(18,2)").cast("string")).when(
        F.col(c).isNotNull(), F.format_string("%.2f", F.col(c)))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart table (case, age_bl, age_fu, sex, enrollment, followup_years) with raw ages."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    lines = _order_lines(spark, sf_dir).select("l_orderkey", "q_min", "q_max")
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left")
    age_bl = (F.lit(30) + F.col("q_min")).cast("int")
    age_fu = (F.lit(30) + F.col("q_max")).cast("int")
    return j.select(
        F.col("o_orderkey").alias("case"),
        age_bl.alias("age_bl"),
        age_fu.alias("age_fu"),
        _map_col(F.col("o_orderstatus"), SEX_BY_STATUS).alias("sex"),
        F.lower("c_mktsegment").alias("enrollment"),
        (age_fu - age_bl).alias("followup_years"),
    )


def cohort_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort as the loader expects it: one row per subject, every column text, names as in DICTIONARY.

    Orders are hash-partitioned by key first: that is the partitioning the join with the per-order line
    aggregates needs at scale (so it is reused there), and it spreads the unpivot and parsing of the loader over
    all cores even when the orders input is one small file.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    ).repartition(F.col("o_orderkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    lines = _order_lines(spark, sf_dir)
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left")
    age_bl = (F.lit(30) + F.col("q_min")).cast("long")
    age_fu = (F.lit(30) + F.col("q_max")).cast("long")
    return j.select(
        F.col("o_orderkey").cast("string").alias("subject_id"),
        age_bl.cast("string").alias("age_bl"),
        age_fu.cast("string").alias("age_fu"),
        _map_col(F.col("o_orderstatus"), SEX_CODE_BY_STATUS).alias("gender"),
        F.lower("c_mktsegment").alias("current_status"),
        (age_fu - age_bl).cast("string").alias("followup_years"),
        F.floor(F.col("o_totalprice") / 1000).cast("string").alias("price_k"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_dt"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.lower(F.substring("o_orderpriority", 3, 100)).alias("priority_desc"),
        _fmt2("d_max").alias("disc"),
        _fmt2("q_avg").alias("qty_avg"),
        _fmt2("c_acctbal").alias("balance_band"),
        F.col("o_custkey").cast("string").alias("cust_ref"),
        F.lower(F.substring("o_orderpriority", 3, 100)).alias("urgency"),
    )


# The data dictionary describing cohort_wide (Name, Label, Description, Values, Domain, Priority).
DICTIONARY = [
    ("gender", "Sex", "Sex of the subject", "1 = female||2 = male||3 = other||. = missing", "Demographics", 1),
    ("age_bl", "Age at baseline", "Age at cohort entry", "", "Demographics", 1),
    ("age_fu", "Age at follow-up", "Age at the most recent visit", "", "Demographics", 1),
    ("current_status", "Enrollment", "Enrollment status (market segment)",
     "1 = automobile||2 = building||3 = furniture||4 = household||5 = machinery", "Enrollment", 1),
    ("followup_years", "Years of follow-up", "Years between baseline and follow-up", "Integers||. = Missing",
     "Enrollment", 1),
    ("price_k", "Order value (thousands)", "Total order price in thousands", "", "Orders", 0),
    ("order_dt", "Order date", "Date of the order", "", "Orders", 0),
    ("priority", "Order priority", "Priority given to the order",
     "1 = urgent||2 = high||3 = medium||4 = not specified||5 = low", "Orders", 0),
    ("disc", "Largest discount", "Largest discount on a line of the order", "", "Orders", 0),
    ("qty_avg", "Mean quantity", "Mean quantity per line", "", "Orders", 0),
    ("balance_band", "Account balance", "Account balance band of the customer",
     "1 = <0||2 = 0-2,500||3 = 2,500-5,000||4 = 5,000+", "Accounts", 0),
    ("urgency", "Urgency", "Urgency named in the order priority", "1 = urgent||2 = high", "Orders", 0),
]

DATAMODEL_VARS = {
    "age_bl": "age_bl",
    "age_fu": "age_fu",
    "gender": "gender",
    "current_status": "enrollment",
    "followup_years": "followup_years",
}


def dictionary(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The dictionary above as a DataFrame with its row position (``seq``), as ``scan_dictionary`` returns it.

    Given the tables' folder, the codes of enrolment and priority come from the values the tables hold."""
    rows = [(i, *r) for i, r in enumerate(DICTIONARY)]
    d = spark.createDataFrame(
        rows, "seq long, name string, label string, description string, values string, domain string, priority int"
    )
    if sf_dir is None:
        return d

    def codes(name: str, text) -> object:
        found = F.sort_array(F.collect_set(text))
        numbered = F.transform(found, lambda x, i: F.concat_ws(" = ", (i + 1).cast("string"), F.regexp_replace(
            x, "^[0-9]-", "")))
        return table(spark, sf_dir, name).agg(F.array_join(numbered, "||")).scalar()

    status, priority = codes("customer", F.lower("c_mktsegment")), codes("orders", F.lower("o_orderpriority"))
    return d.withColumn("values", F.when(F.col("name") == "current_status", status)
                        .when(F.col("name") == "priority", priority).otherwise(F.col("values")))
