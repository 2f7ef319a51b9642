"""Streaming visits: any key and token, hot keys, restarts, and two batches equal to one."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cellguard.operators.visits import answer_visits, logged, mark_returning
from cellguard.streaming.visits import answer_stream, mark_returning_stream, read_answers, read_marked

T0 = dt.datetime(2024, 5, 1, 12)
VISIT = "kind string, address string, token string, ts timestamp, id long"


def at(i):
    return T0 + dt.timedelta(minutes=i)


def as_stream(spark, folder, parts, schema):
    """Files in order, one a micro-batch."""
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
        df.coalesce(1).write.parquet(os.path.join(folder, f"part={n}"))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(folder))


SCHEMA = "key string, ts timestamp, id long, token string"


def made():
    rows = [("hot address", at(i), i, f"t{i}" if i % 2 else None) for i in range(0, 300, 3)]
    rows += [(None if i % 9 == 1 else f"k{i % 13}", at(i), i, f"t{i}") for i in range(300) if i % 3]
    return rows


def marked_plainly(rows):
    first = {}
    for key, ts, i, token in sorted(rows, key=lambda r: (r[1], r[2])):
        first.setdefault(key, (ts, i, token))
    return {(i, (ts, i) > first[key][:2], first[key][2]) for key, ts, i, _ in rows}


@pytest.mark.parametrize("cuts", [[300], [150, 300], [1, 20, 299, 300]])
def test_stream_in_any_batches_matches_one_pass(spark, tmp_path, cuts):
    rows = made()
    parts, low = [], 0
    for high in cuts:
        parts.append([r for r in rows if low <= r[2] < high])
        low = high
    stream = as_stream(spark, str(tmp_path / "in"), parts, SCHEMA)
    path = str(tmp_path / "out")
    mark_returning_stream(stream, "key", "ts", "id", path, "token", availableNow=True).awaitTermination()
    got = {(r["id"], r["returning"], r["first_token"]) for r in read_marked(spark, path).collect()}
    assert got == marked_plainly(rows)
    batch = mark_returning(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", "token")
    assert got == {(r["id"], r["returning"], r["first_token"]) for r in batch.collect()}


def test_a_restarted_stream_goes_on(spark, tmp_path):
    rows, path, folder = made(), str(tmp_path / "out"), str(tmp_path / "in")
    stream = as_stream(spark, folder, [rows[:80]], SCHEMA)
    mark_returning_stream(stream, "key", "ts", "id", path, "token", availableNow=True).awaitTermination()
    spark.createDataFrame([("late", at(900), 900, "z"), ("hot address", at(901), 901, "y")], SCHEMA).coalesce(1).write.parquet(
        os.path.join(folder, "part=9"))
    mark_returning_stream(stream, "key", "ts", "id", path, "token", availableNow=True).awaitTermination()
    got = {r["id"]: r for r in read_marked(spark, path).collect()}
    assert len(got) == 82 and read_marked(spark, path).count() == 82
    assert not got[900]["returning"] and got[901]["returning"] and got[901]["first_token"] is None


def visits():
    """One of each rule, in order."""
    return [("check", "a", None, at(0), 0), ("submit", "a", None, at(1), 1), ("check", "a", None, at(2), 2),
            ("submit", "a", None, at(3), 3), ("check", "a", None, at(4), 4), ("token", None, "T1", at(5), 5),
            ("token", None, None, at(6), 6), ("token", None, "", at(7), 7), ("token", None, "nobody", at(8), 8),
            ("check", None, None, at(9), 9), ("check", "untrackable", None, at(10), 10), ("submit", None, None, at(11), 11),
            ("submit", "untrackable", None, at(12), 12), ("check", "untrackable", None, at(13), 13),
            ("check", "old", None, at(14), 14), ("check", "blank", None, at(15), 15), ("check", "blank", None, at(16), 16),
            ("token", None, "seed", at(17), 17), ("token", None, "T15", at(18), 18)]


def test_visitor_rules(spark):
    log = spark.createDataFrame([("old", "seed", at(-9), -9), ("old", "later", at(-8), -8), ("blank", None, at(-7), -7)],
                                "address string, token string, ts timestamp, id long")
    plain = {r["id"]: r for r in answer_visits(spark.createDataFrame(visits(), VISIT), log, "s").collect()}
    rows = [(*r[:2], {"T1": plain[1]["token"], "T15": plain[15]["token"]}.get(r[2], r[2]), *r[3:]) for r in visits()]
    answers = answer_visits(spark.createDataFrame(rows, VISIT), log, "s")
    got = {r["id"]: r for r in answers.collect()}
    made_1 = got[1]["token"]
    assert [got[i]["returning"] for i in (0, 2, 4, 9, 10, 13, 14, 15, 16)] == [False, True, True, False, False, False, True, True, True]
    assert got[2]["token"] == got[4]["token"] == made_1 and len(made_1) == 18 and made_1.endswith("20240501")
    assert got[3]["token"] not in (None, made_1) and got[0]["token"] is None
    assert got[14]["token"] == "seed" and got[15]["token"] and got[15]["token"] != got[16]["token"]  # none set: new ones
    assert [got[i]["accepted"] for i in (5, 6, 7, 8, 17, 18)] == [True, False, False, False, True, True]
    assert [got[i]["error"] for i in (5, 6, 7, 8)] == [None, "unknown", "unknown", "unrecognized"]
    assert {r["id"] for r in logged(answers).collect()} == {1, 2, 3, 4, 5, 11, 12, 14, 15, 16, 17, 18}


@pytest.mark.parametrize("cut", [3, 6, 12])
def test_answers_in_two_batches_equal_one(spark, tmp_path, cut):
    once = answer_visits(spark.createDataFrame(visits(), VISIT), None, "s").collect()
    stream = as_stream(spark, str(tmp_path / "in"), [visits()[:cut], visits()[cut:]], VISIT)
    path = str(tmp_path / "out")
    answer_stream(stream, path, "s", availableNow=True).awaitTermination()
    got = read_answers(spark, path).select(*once[0].__fields__)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, once), key=str)
    assert spark.read.parquet(f"{path}/log").where(F.col("id") == 2).count() == 1


def test_an_address_with_a_third_of_the_log(spark):
    rows = [("submit", "hot", None, at(0), 0)] + [("check", "hot", None, at(i), i) for i in range(1, 500)]
    got = answer_visits(spark.createDataFrame(rows, VISIT), None, "s").collect()
    assert len(got) == 500 and len({r["token"] for r in got}) == 1 and sum(r["returning"] is True for r in got) == 499
