"""Tasks of windows over tokens stay small: parts by the number of rows, few sorts, frames read no more than needed."""

import re

from pyspark.sql import functions as F

from contourlake.operators import inspect as I
from contourlake.sources import adapters as A

SF = "/root/testdata/sf0.001"
UP, DOWN = "octave jump; jump (rise)", "octave jump; jump (fall)"
CARRIED = [(False, ""), (False, ""), (True, UP), (True, "carryover"), (False, ""), (True, DOWN), (False, ""), (False, ""), (False, ""), (True, UP), (True, DOWN), (False, ""), (False, "")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_order_lines_grow_with_rows(spark, monkeypatch):
    few = {tuple(r) for r in A.order_frames(spark, SF).collect()}
    n = A.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(A, "ROWS_PER_PART", 500)
    df = A.order_frames(spark, SF)
    assert df.rdd.getNumPartitions() == -(-n // 500) > 4
    assert I.flag_pitch_jumps(df).rdd.getNumPartitions() == -(-n // 500)
    assert {tuple(r) for r in df.collect()} == few


def test_jumps_sort_twice(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("token"), F.rand(1).alias("time"), (100 + F.rand(2)).alias("f0"))
    assert len(re.findall(r"\bSort \[", plan(I.flag_pitch_jumps(rows)))) == 2


def test_carryover_between_stops(spark, frames):
    """Hits, stops and nulls in turn: the flag goes on from a hit up to the first stop, in either direction."""
    f0 = [100, 100, 210, 212, None, 211, 100, 102, 104, 220, 221, 100, 100]
    got = I.flag_pitch_jumps(frames([("a", 0.01 * i, None if f is None else float(f)) for i, f in enumerate(f0)])).orderBy("time").collect()
    assert [(r["flagged_jump"], r["jump_note"]) for r in got] == CARRIED


def test_constant_columns_do_not_need_times(spark):
    """A column that is constant in all frames is told without the times; only the others look at them."""
    from contourlake.operators.resample import token_constant_columns

    rows = spark.createDataFrame([("a", 1.0, "x", 1), ("a", 2.0, "x", 1), ("a", None, "x", 2), ("b", 1.0, None, 1), ("b", 2.0, None, 3)], "token string, time double, c string, d int")
    never = rows.withColumn("time", F.raise_error(F.lit("times were read")).cast("double"))
    assert token_constant_columns(never, ["c"]) == ["c"]
    assert token_constant_columns(rows, ["c", "d"]) == ["c"]
    assert token_constant_columns(rows.filter("token = 'a'"), ["c", "d"]) == ["c", "d"]


def test_resampling_passes(spark):
    """Neighbours, ends and the number of frames of a token come from one window."""
    from contourlake.operators.resample import resample_equal

    df = resample_equal(A.order_frames(spark, SF).drop("intensity"), carried=["speaker", "tone", "item"])
    assert len(re.findall(r"- Window \[", plan(df))) == 4
