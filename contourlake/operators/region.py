"""Regions of tokens: voiced spans, gaps, labelled intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import is_vowel_label, token_key, voiced


def trim_to_voiced(data: DataFrame, *, token="token", time="time", f0="f0", min_run=2) -> DataFrame:
    """The frames from a token's first to its last voiced frame, counting only runs of at least ``min_run`` voiced frames, or any if there are none; gaps inside stay."""
    w = Window.partitionBy(token).orderBy(time)
    d = data.withColumn("__v", voiced(f0)).withColumn("__rn", F.row_number().over(w))
    d = d.withColumn("__run", F.when(F.col("__v"), F.col("__rn") - F.sum(F.col("__v").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    d = d.withColumn("__len", F.when(F.col("__v"), F.count("*").over(Window.partitionBy(token, "__run", "__v"))))
    whole = Window.partitionBy(token)
    edge = lambda f, c: f(F.when(c, F.col("__rn"))).over(whole)
    long, any_ = F.col("__len") >= min_run, F.col("__v")
    lo, hi = F.coalesce(edge(F.min, long), edge(F.min, any_)), F.coalesce(edge(F.max, long), edge(F.max, any_))
    return d.withColumn("__lo", lo).withColumn("__hi", hi).filter(F.col("__rn").between(F.col("__lo"), F.col("__hi"))).select(*data.columns)


def flag_f0_gaps(data: DataFrame, *, token="token", time="time", f0="f0") -> DataFrame:
    """Adds n_missing (unvoiced frames of the token) and has_gap (one of them lies between voiced frames)."""
    v, whole = voiced(f0), Window.partitionBy(token)
    first, last = F.min(F.when(v, F.col(time))).over(whole), F.max(F.when(v, F.col(time))).over(whole)
    d = data.withColumn("n_missing", F.sum((~v).cast("int")).over(whole)).withColumn("__in", ~v & (F.col(time) > first) & (F.col(time) < last))
    return d.withColumn("has_gap", F.coalesce(F.bool_or("__in").over(whole), F.lit(False))).drop("__in")


def tier_names(tiers: list[str]) -> list[str]:
    """Column prefixes of tiers: other signs become ``_``, lower case, repeated names numbered."""
    out: list[str] = []
    for tier in tiers:
        base = re.sub("[^A-Za-z0-9]+", "_", tier).strip("_").lower() or "tier"
        name, n = base, 0
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def _order_of_one_start(intervals: DataFrame) -> list[str]:
    """Columns that order intervals of one start: ``place``, the interval's number in its tier, where there is one; then end and label."""
    return [c for c in ("place", "t2", "label") if c in intervals.columns]


def number_intervals(intervals: DataFrame, *, token="token") -> DataFrame:
    """Adds the ordinal of each interval with a label among those of its tier; null for blank ones. Intervals of one start go by their places in the tier, without these by their ends, then their labels."""
    named = F.length(F.trim(F.coalesce("label", F.lit("")))) > 0
    w = Window.partitionBy(token, "tier").orderBy("t1", *_order_of_one_start(intervals)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return intervals.withColumn("i", F.when(named, F.sum(named.cast("int")).over(w)))


def attach_intervals(data: DataFrame, intervals: DataFrame, tiers: list[str], *, token="token", time="time") -> DataFrame:
    """Adds <tier>, <tier>_start, <tier>_end and <tier>_i to frames: the interval with the greatest start not after the frame, if it has not ended.

    Of intervals of one start the last one counts, in the order of ``number_intervals``.
    Frames and interval starts of a token and tier are laid in one order by time and the last interval is
    carried forward, so there is no join on a range; tokens are matched by their keys.
    """
    out = data.withColumn("__key", token_key(token))
    numbered, same = number_intervals(intervals), _order_of_one_start(intervals)
    for tier, name in zip(tiers, tier_names(tiers)):
        marks = numbered.filter(F.col("tier") == tier).select(token_key("token").alias("__key"), F.col("t1").alias("__at"), F.lit(0).alias("__kind"), F.struct("t1", "i", *same).alias("__iv"))
        frames = out.withColumn("__row", F.struct(*out.columns)).select("__key", F.col(time).alias("__at"), F.lit(1).alias("__kind"), "__row")
        both = frames.unionByName(marks, allowMissingColumns=True)
        w = Window.partitionBy("__key").orderBy("__at", "__kind", *(f"__iv.{c}" for c in same)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("__last", F.when(F.col("__key").isNotNull(), F.last("__iv", ignorenulls=True).over(w))).filter("__kind = 1")
        fits = F.col("__at") <= F.col("__last.t2")
        put = lambda c, fits=fits: F.when(fits, F.col(f"__last.{c}"))
        out = both.select("__row.*", put("label").alias(name), put("t1").alias(f"{name}_start"), put("t2").alias(f"{name}_end"), put("i").alias(f"{name}_i"))
    return out.drop("__key")


def filter_intervals(data: DataFrame, name: str, mode: str, labels: list[str] = (), *, token="token") -> DataFrame:
    """Frames whose interval is a vowel, has one of the labels, or belongs to the rhyme (from the token's first vowel on)."""
    if mode == "vowel":
        return data.filter(is_vowel_label(name))
    if mode == "labels":
        return data.filter(F.trim(name).isin(*labels))
    if mode != "rhyme":
        raise ValueError("mode: vowel, labels or rhyme")
    first = F.min(F.when(is_vowel_label(name), F.col(f"{name}_i"))).over(Window.partitionBy(token))
    return data.withColumn("__first", first).filter(F.col(f"{name}_i") >= F.col("__first")).drop("__first")


def unlabelled_tokens(data: DataFrame, name: str, *, token="token") -> DataFrame:
    """Tokens without any labelled interval."""
    blank: Column = F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) == 0
    return data.groupBy(token).agg(F.bool_and(blank).alias("b")).filter("b").select(token)
