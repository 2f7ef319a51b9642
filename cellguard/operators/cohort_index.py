"""Filters without joins: order-preserving value codes (P1, J1) and bitmaps of cases.

``value_codes`` numbers an item's values in numeric order (values without a number after the others). A range on the
item is then one interval of codes, a value list is a list of codes, and both are predicates on a column of the variable
table that reach the Parquet scan: ``write_coded`` sorts an item's files by code, so their statistics prune.

``case_bitmaps`` holds, for a value code and a bucket of 32,768 numbered cases, one bit a case. A filter is the OR of its
codes' bitmaps, a conjunction the AND over filters; what is shuffled is a bitmap a (filter, bucket), never a case. It
suits items with few values; ``select_cases_coded`` answers the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import ValueFilter
from .ranks import grouped_rank
from .rows import with_row_index

SLICES = 8  # tasks that share the writing of one item


def value_codes(value: DataFrame) -> DataFrame:
    """(item, value, code, name_numeric): codes 0, 1, ... per item, in the order of the numbers, then of the names."""
    v = value.select("item", F.col("id").alias("value"), "name", "name_numeric",
                     F.col("name_numeric").isNull().alias("__text"))
    ranked = grouped_rank(v, ["item"], ["__text", "name_numeric", "name", "value"], "code")
    return ranked.select("item", "value", F.col("code").cast("int").alias("code"), "name_numeric")


def coded_variable(variable: DataFrame, codes: DataFrame) -> DataFrame:
    """(case, item, code): the variable table with codes, joined once when the store is written."""
    return variable.join(codes.select("item", "value", "code"), ["item", "value"]).select("case", "item", "code")


def write_coded(coded: DataFrame, path: str) -> DataFrame:
    """Write by item, each file sorted by code, and read back."""
    dealt = coded.repartition("item", F.pmod(F.xxhash64("case"), F.lit(SLICES))).sortWithinPartitions("item", "code")
    dealt.write.mode("overwrite").partitionBy("item").parquet(path)
    return coded.sparkSession.read.parquet(path).select("case", F.col("item").cast("int").alias("item"), "code")


def code_predicates(codes: DataFrame, filters: list) -> list[Column]:
    """A predicate on (item, code) per filter: from one row of interval ends, and the codes of the listed values."""
    asked = []
    for i, f in enumerate(filters):
        own = F.col("item") == f.item
        if isinstance(f, ValueFilter):
            hit = own & F.col("value").isin(list(f.values))
            asked.append(F.collect_set(F.when(hit, F.col("code"))).alias(f"list{i}"))  # as many as the filter names
            continue
        bounds = own
        if f.lo is not None:
            bounds = bounds & (F.col("name_numeric") >= float(f.lo))
        if f.hi is not None:
            bounds = bounds & (F.col("name_numeric") <= float(f.hi))
        asked += [F.min(F.when(bounds, F.col("code"))).alias(f"lo{i}"), F.max(F.when(bounds, F.col("code"))).alias(f"hi{i}")]
    row = codes.where(F.col("item").isin(sorted({f.item for f in filters}))).agg(*asked).first()
    out = []
    for i, f in enumerate(filters):
        own = F.col("item") == f.item
        if isinstance(f, ValueFilter):
            found = sorted(row[f"list{i}"])
            out.append(own & F.col("code").isin(found) if found else F.lit(False))
        elif row[f"lo{i}"] is None:
            out.append(F.lit(False))
        else:
            out.append(own & F.col("code").between(row[f"lo{i}"], row[f"hi{i}"]))
    return out


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def select_cases_coded(coded: DataFrame, codes: DataFrame, filters: list) -> DataFrame:
    """P5 on codes: DataFrame[case] of subjects meeting every filter; rows that meet none never leave the scan."""
    if not filters:
        return coded.select("case").distinct()
    tests = code_predicates(codes, filters)
    met = coded.where(_any(tests)).groupBy("case").agg(*[F.bool_or(t).alias(f"f{i}") for i, t in enumerate(tests)])
    return met.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") for i in range(len(tests))])).select("case")


def case_numbers(cases: DataFrame) -> DataFrame:
    """(case, bucket, bit): every case's number as a bucket and a bit position."""
    numbered = with_row_index(cases.select("case"), "__no", 1)
    return numbered.select("case", F.bitmap_bucket_number("__no").alias("bucket"), F.bitmap_bit_position("__no").alias("bit"))


def case_bitmaps(coded: DataFrame, numbers: DataFrame, items: list[int] | None = None) -> DataFrame:
    """(item, code, bucket, bits) of the given items, or of all."""
    rows = coded if items is None else coded.where(F.col("item").isin(items))
    return rows.join(numbers, "case").groupBy("item", "code", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def select_bitmaps(bitmaps: DataFrame, codes: DataFrame, filters: list) -> DataFrame:
    """(bucket, bits) of the cases that meet every filter."""
    if not filters:
        return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    tests = code_predicates(codes, filters)
    which = F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]), lambda i: i.isNotNull())
    each = (bitmaps.where(_any(tests)).select("bucket", "bits", F.explode(which).alias("f"))
            .groupBy("f", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
    both = each.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met"))
    return both.where(F.col("met") == len(filters)).select("bucket", "bits")


def count_cases(selected: DataFrame) -> DataFrame:
    """One row: how many cases are selected."""
    return selected.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def cases_of(selected: DataFrame, numbers: DataFrame) -> DataFrame:
    """DataFrame[case]: the numbered cases whose bit is set; a bitmap is 4 KB a bucket, a case only tests its own."""
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    mask = F.expr("shiftleft(1, cast(bit % 8 as int))")
    return numbers.join(selected, "bucket").where(byte.bitwiseAND(mask) != 0).select("case")
