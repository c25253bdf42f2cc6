"""Bitmaps against plain comparison."""

import datetime as dt
import random

from sparkloom.operators import orphans as O

NTZ = "timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    parents = {f"t{i}": day(rnd.randrange(200)) if i % 9 else None for i in range(0, 60, 2)}
    refs = []
    for i in range(600):
        target = "t1" if i % 3 == 0 else f"t{rnd.randrange(62)}"  # one missing target holds a third
        refs.append(("a", f"r{i}", target, day(rnd.randrange(200)) if i % 5 else None))
    refs += refs[:7] + [("a", "null", None, day(1))]
    got = O.find_orphans(spark.createDataFrame(refs, f"ref_table string, ref_key string, target string, at {NTZ}"), spark.createDataFrame(list(parents.items()), f"target string, first_at {NTZ}"))
    want = {(k, t) for _, k, t, at in refs if t is not None and (t not in parents or parents[t] and at and parents[t] > at)}
    assert {(r["ref_key"], r["target"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_same_month_is_compared_by_time(spark):
    refs = spark.createDataFrame([("a", "early", "x", day(3)), ("a", "late", "x", day(20)), ("a", "equal", "x", day(10))], f"ref_table string, ref_key string, target string, at {NTZ}")
    got = O.find_orphans(refs, spark.createDataFrame([("x", day(10))], f"target string, first_at {NTZ}"))
    assert [r["ref_key"] for r in got.collect()] == ["early"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], f"ref_table string, ref_key string, target string, at {NTZ}")
    some = spark.createDataFrame([("a", "r", "x", None)], none.schema)
    parents = spark.createDataFrame([], f"target string, first_at {NTZ}")
    assert O.find_orphans(none, parents).count() == 0
    assert O.find_orphans(some, parents).count() == 1


def test_many_keys_in_a_range(spark):
    refs = spark.range(50_000).selectExpr("'a' AS ref_table", "concat('r', id) AS ref_key", "concat('t', id) AS target", f"CAST(NULL AS {NTZ}) AS at", "1 AS ref_count")
    parents = spark.range(0, 50_000, 2).selectExpr("concat('t', id) AS target", f"CAST(NULL AS {NTZ}) AS first_at")
    got = O.find_orphans(refs, parents)
    assert got.count() == 25_000 and got.where("CAST(substring(target, 2) AS int) % 2 = 0").count() == 0


def test_target_names(spark):
    df = spark.createDataFrame([(" a.b() ",), ("a.b",), ("\ta.b()\n",), ("a.b()()",)], "t string")
    assert [r[0] for r in df.select(O.clean_target(df["t"])).collect()] == ["a.b", "a.b", "a.b", "a.b()"]


def test_containers_of_both_kinds(spark):
    df = spark.range(1, 40_000).selectExpr("id AS _id", "CASE WHEN id % 100 = 0 THEN 1 ELSE 2 END AS m")
    got = {(r["_bucket"], r["_period"]): r for r in O.bitmaps(df, "m").collect()}
    assert len(got) == 4
    assert len(got[1, 1]["_list"]) == 327 and got[1, 1]["_bits"] is None
    assert got[1, 2]["_list"] is None and sum(bin(b).count("1") for b in got[1, 2]["_bits"]) == 32_768 - 327
    assert got[1, 1]["_list"] is not None and max(got[1, 1]["_list"]) < O.CONTAINER
