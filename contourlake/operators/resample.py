"""Resampling of tokens to equally spaced points: each pair of neighbour frames makes the points between them.

Frames stay rows, sorted once by token and time; no step looks through a whole token for one point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Positions on the grid are known to about 1e-15 of its length; this much either way makes sure of every candidate.
MARGIN = 1e-6


def finite(time: str) -> Column:
    """Whether a time is known and finite."""
    return F.abs(F.col(time).cast("double")) < F.lit(float("inf"))


def points_between(left: Column, right: Column, n: int) -> Column:
    """Numbers of the points that may lie between two positions on a grid of 0..n-1; null where there is none."""
    first = F.greatest(F.lit(0), F.ceil(left - MARGIN).cast("int"))
    last = F.least(F.lit(n - 1), F.floor(right + MARGIN).cast("int"))
    return F.when(first <= last, F.sequence(first, last))


def grid_time(point: Column, n: int, start: Column, end: Column) -> Column:
    return F.when(point == n - 1, end).otherwise(start + point * ((end - start) / (n - 1)))


def token_constant_columns(data: DataFrame, columns: list[str], *, token="token", time="time") -> list[str]:
    """Which of the columns have one value (null counting as one) in every token, told by 64-bit hashes: an aggregation of two numbers a column.

    What is constant in all frames is so in those of a finite time. The times, which may take a window to make, are only read for the other columns.
    """
    differs = lambda c: F.min(F.xxhash64(c)) != F.max(F.xxhash64(c))

    def varying(rows: DataFrame, of: list[str]) -> list[str]:
        if not of:
            return []
        per = rows.groupBy(token).agg(*(differs(c).alias(c) for c in of))
        some = per.agg(*(F.bool_or(c).alias(c) for c in of)).first()
        return [c for c in of if some[c]]

    out = varying(data.filter(finite(time)), varying(data, columns))
    return [c for c in columns if c not in out]


def resample_equal(data: DataFrame, *, n=21, token="token", time="time", f0="f0", intensity="intensity", method="linear", carried: list[str] | None = None) -> DataFrame:
    """n points at equal steps per token: point, time, time_prop (0-1), f0[, intensity] and the columns that are constant within tokens.

    A point takes its value from the nearer of its two neighbour frames: nothing where that frame is unvoiced,
    that frame's own value where the farther one is, else the linear blend (``nearest``: never a blend). Even
    steps are addressed by one global index, uneven ones by their times. Frames of equal time count once, the
    first by the other columns' order; frames without a finite time are dropped. A token of one frame gives one row.
    """
    if n < 2 or method not in ("linear", "nearest"):
        raise ValueError("n must be at least 2; method: linear or nearest")
    has_int = intensity in data.columns
    if carried is None:
        carried = token_constant_columns(data, [c for c in data.columns if c not in (token, time, f0, intensity, "point", "time_prop")], token=token, time=time)
    level = F.col(intensity).cast("double") if has_int else F.lit(None).cast("double")
    pitch = F.col(f0).cast("double")
    d = data.filter(finite(time)).select(token, *carried, F.col(time).cast("double").alias("__t"), F.when(pitch > 0, pitch).alias("__f"), pitch.alias("__raw"), level.alias("__i"))
    w, whole = Window.partitionBy(token).orderBy("__t", "__f", "__raw", "__i"), Window.partitionBy(token)
    d = d.withColumn("__before", F.lag("__t").over(w)).filter("__before is null or __before != __t").drop("__before")
    smooth = has_int and method == "linear"
    if smooth:
        sounding = F.when(F.col("__i").isNotNull() & ~F.isnan("__i"), F.struct(F.col("__t").alias("t"), F.col("__i").alias("i")))
        backwards = whole.orderBy(F.desc("__t")).rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("__above", F.last(sounding, ignorenulls=True).over(backwards))
        d = d.withColumn("__below", F.last(sounding, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of the order of w, so all these are one pass over a token
    d = d.select("*", (F.row_number().over(w) - 1).alias("__k"), *(F.lead(f"__{c}").over(w).alias(f"__n{c}") for c in "tfi"), F.min("__t").over(every).alias("__t0"), F.max("__t").over(every).alias("__t9"), F.count("*").over(every).alias("__m"))
    span = F.col("__t9") - F.col("__t0")
    d = d.withColumn("__dx", F.try_divide(span, F.col("__m") - 1))
    off = F.sum(F.abs(F.col("__nt") - F.col("__t") - F.col("__dx"))).over(whole)
    d = d.withColumn("__even", F.coalesce(F.try_divide(off, span) <= 1e-9, F.lit(False)))

    k, t, nt = F.col("__k"), F.col("__t"), F.col("__nt")
    position = lambda k, t: F.when(F.col("__even"), F.try_divide(k.cast("double"), F.col("__m") - 1)).otherwise(F.try_divide(t - F.col("__t0"), span)) * (n - 1)
    right = F.when(k >= F.col("__m") - 2, F.lit(float(n - 1))).otherwise(position(k + 1, nt))
    d = d.withColumn("__p", F.explode(F.when(F.col("__m") < 2, F.array(F.lit(0))).otherwise(points_between(position(k, t), right, n))))
    single = F.col("__m") < 2
    d = d.withColumn("__x", F.when(single, t).otherwise(grid_time(F.col("__p"), n, F.col("__t0"), F.col("__t9"))))
    x, index = F.col("__x"), F.try_divide(F.col("__x") - F.col("__t0"), F.col("__dx"))
    mine = F.when(F.col("__even"), F.floor(index) == k).otherwise((k <= F.col("__m") - 2) & (x >= t) & ((x < nt) | (k == F.col("__m") - 2)))
    d = d.filter(single | mine).withColumn("__phase", F.when(F.col("__even"), index - F.floor(index)).otherwise(F.try_divide(x - t, nt - t)))

    phase, early = F.col("__phase"), F.col("__phase") < 0.5
    near, far = F.when(early, F.col("__f")).otherwise(F.col("__nf")), F.when(early, F.col("__nf")).otherwise(F.col("__f"))
    blend = near if method == "nearest" else F.when(near.isNull(), F.lit(None)).when(far.isNull(), near).otherwise(near + F.when(early, phase).otherwise(1 - phase) * (far - near))
    own = F.when(early, F.col("__i")).otherwise(F.col("__ni"))
    if smooth:
        lo, hi = F.col("__below"), F.col("__above")
        inside = lo["i"] + (x - lo["t"]) / (hi["t"] - lo["t"]) * (hi["i"] - lo["i"])
        own = F.when(lo.isNull(), hi["i"]).when(hi.isNull(), lo["i"]).otherwise(inside)
    values = [(F.col("__p") + 1).alias("point"), x.alias(time), F.when(single, 0.5).otherwise(F.col("__p") / float(n - 1)).alias("time_prop"), F.when(single, F.col("__raw")).otherwise(blend).alias(f0)]
    return d.select(token, *values, *([F.when(single, F.col("__i")).otherwise(own).alias(intensity)] if has_int else []), *carried)
