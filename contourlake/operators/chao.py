"""Five-level tone numerals from contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contourlake.functions.scalars import classify_contour


def robust_range(raw: DataFrame, *, token="token", f0="f0", tone="tone") -> DataFrame:
    """One row: the tones with the highest and lowest mean, mean and sd of the former's token peaks and the latter's token valleys, and the range between.

    Only f0 above 0 counts, in semitones too. Ties between tones go to the first in order. With one peak or one
    valley its deviation, and so the range, is null.
    """
    known = raw.filter(F.col(f0) > 0).select(F.col(token).alias("token"), F.col(tone).cast("string").alias("tone"), F.col(f0).cast("double").alias("f"))
    tokens = known.groupBy("tone", "token").agg(F.sum("f").alias("s"), F.count("f").alias("n"), F.max("f").alias("peak"), F.min("f").alias("valley"))
    means = tokens.groupBy("tone").agg((F.sum("s") / F.sum("n")).alias("m"))
    ends = means.agg(F.min(F.struct(-F.col("m"), "tone"))["tone"].alias("highest_tone"), F.min(F.struct("m", "tone"))["tone"].alias("lowest_tone"))
    both = tokens.crossJoin(F.broadcast(ends)).filter("tone = highest_tone or tone = lowest_tone")
    peak, valley = F.when(F.col("tone") == F.col("highest_tone"), F.col("peak")), F.when(F.col("tone") == F.col("lowest_tone"), F.col("valley"))
    one = both.groupBy("highest_tone", "lowest_tone").agg(F.avg(peak).alias("mu_max"), F.stddev_samp(peak).alias("sigma_max"), F.avg(valley).alias("mu_min"), F.stddev_samp(valley).alias("sigma_min"))
    return one.select("*", (F.col("mu_max") + F.col("sigma_max")).alias("upper"), F.when(F.col("mu_min") - F.col("sigma_min") < 1, 1.0).otherwise(F.col("mu_min") - F.col("sigma_min")).alias("lower"))


def scaled_contours(contours: DataFrame, raw: DataFrame | None = None, *, tone="tone", time="time", f0="f0_predicted", **roles) -> DataFrame:
    """tone, time and the three scales: chao_ref (1-5 between the extremes), chao_int (0-5) and chao_rob (0-5 on the log robust range, null without raw data)."""
    c = contours.select(F.col(tone).cast("string").alias("tone"), F.col(time).cast("double").alias("time"), F.col(f0).cast("double").alias("f"))
    ends = c.agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    share = F.try_divide(F.col("f") - F.col("lo"), F.col("hi") - F.col("lo"))
    flat = F.col("hi") == F.col("lo")
    c = c.crossJoin(F.broadcast(ends)).select("tone", "time", "f", F.when(flat, 3.0).otherwise(share * 4 + 1).alias("chao_ref"), F.when(flat, 2.5).otherwise(share * 5).alias("chao_int"))
    if raw is None:
        return c.withColumn("chao_rob", F.lit(None).cast("double"))
    r = robust_range(raw, **roles).select("upper", "lower")
    span = F.log("upper") - F.log("lower")
    value = F.when((span > 0) & (F.col("f") > 0), (F.log("f") - F.log("lower")) / span * 5).when((span > 0) & (F.col("f") == 0), 0.0)  # its logarithm lies below every bound
    return c.crossJoin(F.broadcast(r)).withColumn("chao_rob", F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), value)))).drop("upper", "lower")


def _value_at(points: Column, name: str, x: Column) -> Column:
    """Linear interpolation in an array of points sorted by time, flat beyond its ends."""
    before = F.size(F.filter(points, lambda p: p["time"] <= x))
    lo, hi = F.element_at(points, F.greatest(before, F.lit(1))), F.get(points, before)
    inside = lo[name] + F.try_divide(x - lo["time"], hi["time"] - lo["time"]) * (hi[name] - lo[name])
    return F.when(before == 0, lo[name]).when(before == F.size(points), lo[name]).otherwise(inside)


#: Points of the fine grid on which turning points are looked for, and the first and last of them that count (from 0).
GRID, FIRST, LAST = 200, 19, 179


def chao_digit(value: Column, rounding) -> Column:
    """A place on the five-point scale as a digit 1 to 5, rounded by the scale's rule."""
    return F.greatest(F.lit(1), F.least(F.lit(5), rounding(value).cast("int"))).cast("string")


def contour_to_chao(contours: DataFrame, raw: DataFrame | None = None, *, tone="tone", time="time", f0="f0_predicted", threshold=0.5, **roles) -> DataFrame:
    """Per tone with at least two points: digits on the three scales, shape, the sample times and the values there.

    A dip (else a peak) that lies more than ``threshold`` away from both ends adds a middle digit.
    """
    c = scaled_contours(contours, raw, tone=tone, time=time, f0=f0, **roles).filter("chao_ref is not null and time is not null")
    points = c.groupBy("tone").agg(F.array_sort(F.collect_list(F.struct("time", "chao_ref", "chao_int", "chao_rob"))).alias("p")).filter(F.size("p") >= 2)
    p = F.col("p")
    grid = F.transform(F.sequence(F.lit(FIRST), F.lit(LAST)), lambda k: F.struct(_value_at(p, "chao_ref", k / float(GRID - 1)).alias("v"), k.alias("k")))
    d = points.withColumn("grid", grid).withColumn("v0", _value_at(p, "chao_ref", F.lit(0.0))).withColumn("v1", _value_at(p, "chao_ref", F.lit(1.0)))
    low = F.array_min("grid")
    high = F.array_min(F.transform("grid", lambda g: F.struct((-g["v"]).alias("v"), g["k"].alias("k"))))
    d = d.withColumn("low", low).withColumn("high", high)
    dip = (F.col("v0") - F.col("low.v") > threshold) & (F.col("v1") - F.col("low.v") > threshold)
    peak = (-F.col("high.v") - F.col("v0") > threshold) & (-F.col("high.v") - F.col("v1") > threshold)
    middle = F.when(dip, F.col("low.k") / float(GRID - 1)).when(peak, F.col("high.k") / float(GRID - 1))
    d = d.withColumn("sample_times", F.when(middle.isNotNull(), F.array(F.lit(0.0), middle, F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    for name in ("ref", "int", "rob"):
        d = d.withColumn(f"{name}_continuous", _at_times(p, f"chao_{name}"))
    digit = lambda c, rounding: F.array_join(F.transform(c, lambda v: chao_digit(v, rounding)), "")
    robust = F.when(F.exists("rob_continuous", lambda v: v.isNull()), F.lit(None)).otherwise(digit("rob_continuous", F.ceil))
    d = d.withColumn("refline", digit("ref_continuous", F.rint)).withColumn("interval", digit("int_continuous", F.ceil)).withColumn("robust", robust)
    return d.select("tone", F.size("sample_times").alias("n_digits"), "refline", "interval", "robust", classify_contour("refline").alias("shape"), "sample_times", "ref_continuous", "int_continuous", "rob_continuous")


def _at_times(points: Column, name: str) -> Column:
    return F.transform("sample_times", lambda x: _value_at(points, name, x))


def publish_wide(numerals: DataFrame) -> DataFrame:
    """The numerals with up to three samples in columns of their own: t1-t3, v1-v3 (reference), i1-i3 and r1-r3."""
    slots = [F.get(c, F.lit(k)).alias(f"{name}{k + 1}") for name, c in (("t", "sample_times"), ("v", "ref_continuous"), ("i", "int_continuous"), ("r", "rob_continuous")) for k in range(3)]
    return numerals.select("tone", "n_digits", "refline", "interval", "robust", "shape", *slots)
