"""Property tests: Spark rounding and range expressions against plain-Python statements of the same rules, on
random inputs (negative numbers included, where a truncating modulo would differ from a flooring one)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellguard.functions import codes as K
from cellguard.functions import rounding as R
from cellguard.operators.histogram import histogram


values = st.one_of(st.integers(-10_000, 10_000).map(float),
                   st.floats(-10_000, 10_000, allow_nan=False).map(lambda v: round(v, 2)))


@settings(max_examples=25, deadline=None)
@given(st.lists(values, min_size=1, max_size=40))
def test_rounding_properties(spark, xs):
    """Multiples of 5, within a step of x and on the right side of it; monotone; the middle lies in its bin."""
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", R.int_floor(F.col("x")).alias("f"), R.int_ceil(F.col("x")).alias("c"),
                     R.int_mid(F.col("x")).alias("m"), R.int_round(F.col("x")).alias("r")).collect()
    for r in rows:
        assert r.f % 5 == 0 and r.r % 5 == 0
        assert r.f <= r.x < r.f + 5
        assert r.x - 1 <= r.c < r.x + 5 and (r.c == r.x) == (r.x % 5 == 0)
        assert abs(r.r - r.x) <= 2.5
        assert r.m == r.f if r.x == r.f else r.m == r.f + 2
    ordered = sorted(rows, key=lambda r: r.x)
    for a, b in zip(ordered, ordered[1:]):
        assert a.f <= b.f and a.r <= b.r and a.m <= b.m


@settings(max_examples=25, deadline=None)
@given(st.integers(-500, 500), st.integers(1, 500), st.lists(st.integers(-1000, 1000), min_size=1, max_size=40))
def test_between_label_is_end_exclusive(spark, lo, width, xs):
    lo = abs(lo)
    hi = lo + width
    df = spark.createDataFrame([(f"{lo:,}-{hi:,}", float(x)) for x in xs], "label string, x double")
    b = K.range_bounds(F.col("label"))
    got = [r[0] for r in df.select(*[c.alias(n) for n, c in b.items()], "x").select(
        K.in_range(F.col("x"))).collect()]
    assert got == [lo <= math.trunc(x) < hi for x in xs]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-50, 150, allow_nan=False), min_size=0, max_size=60), st.integers(1, 12), st.booleans())
def test_histogram_matches_spec(spark, xs, bins, top):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r.n for r in histogram(df, "v", 0, 100, bins=bins, top_overflow=top).orderBy("bin").collect()]
    step = 100 / bins
    want = [0] * bins
    for x in xs:
        b = math.floor((x - 0) / step)
        if b < 0:
            continue
        if b >= bins:
            if not top:
                continue
            b = bins - 1
        want[b] += 1
    assert got == want
