"""Rounding of registered columns equals DuckDB's; intervals of one start have one order."""

import math

import duckdb
from pyspark.sql import functions as F

from contourlake.operators import region as R
from contourlake.plans.registry import rounded_as_sql


def test_halves_of_large_values(spark):
    values = [math.nextafter((2_300_000_000_000 + 7919 * i + 0.5) / 1e6, 0) for i in range(4000)] + [(1_200_000_000 + 7 * i + 0.5) / 1e3 for i in range(4000)] + [-0.5, 0.0, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", rounded_as_sql(F.col("v"), 6).alias("six"), rounded_as_sql(F.col("v"), 3).alias("three")).collect()
    con = duckdb.connect()
    expected = [con.execute("SELECT round(v, 6), round(v, 3) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [[r["v"] for r in got]]).fetchall()][0]
    assert [(r["six"], r["three"]) for r in got] == expected
    assert any(r["six"] != s for r, (s,) in zip(got, df.select(F.round("v", 6)).collect()))


def test_intervals_of_one_start(spark):
    rows = [("a", "T", 1.0, 1.0, x) for x in ("t", "", "n", "a")]
    for some in (rows, rows[::-1]):
        iv = spark.createDataFrame(some, "token string, tier string, t1 double, t2 double, label string")
        assert {r["label"]: r["i"] for r in R.number_intervals(iv).collect()} == {"": None, "a": 1, "n": 2, "t": 3}
        frames = spark.createDataFrame([("a", 1.0)], "token string, time double")
        assert R.attach_intervals(frames, iv, ["T"]).first()["t"] == "t"
