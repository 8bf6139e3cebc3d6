"""Pitch normalisation by speaker, and time normalisation by token or segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import semitones


def speaker_statistics(data: DataFrame, *, f0="f0", speaker="speaker", tone="tone", mean_method="simple") -> DataFrame:
    """speaker_mean (all frames, or the mean of the tones' means) and speaker_sd of each speaker.

    Both come from one pass aggregated by speaker and tone, so a speaker with most of the rows costs no
    more than any other: the sums of a tone are merged, never its rows.
    """
    parts = data.groupBy(speaker, tone).agg(F.sum(f0).alias("s"), F.count(f0).alias("n"), F.avg(f0).alias("m"), F.coalesce(F.var_pop(f0), F.lit(0.0)).alias("v")).withColumn("m0", F.coalesce("m", F.lit(0.0)))
    total = parts.groupBy(speaker).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.avg("m").alias("by_tone"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m0") * F.col("m0")).alias("squares"))
    mean = F.try_divide("s", "n")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("within") + F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1)))
    return total.select(speaker, (F.col("by_tone") if mean_method == "weighted" else mean).alias("speaker_mean"), spread.alias("speaker_sd"))


def normalise_f0(data: DataFrame, *, f0="f0", speaker="speaker", tone="tone", method="semitone", mean_method="simple") -> DataFrame:
    """Adds speaker_mean and f0_norm: semitones over the speaker's mean, or z-scores by the sd of all the speaker's frames."""
    if method not in ("semitone", "zscore") or mean_method not in ("simple", "weighted"):
        raise ValueError("method: semitone or zscore; mean_method: simple or weighted")
    stats = speaker_statistics(data, f0=f0, speaker=speaker, tone=tone, mean_method=mean_method).withColumnRenamed(speaker, "__speaker")
    joined = data.join(stats, F.col(speaker).eqNullSafe(F.col("__speaker")), "left").drop("__speaker")
    norm = semitones(f0, "speaker_mean") if method == "semitone" else F.try_divide(F.col(f0) - F.col("speaker_mean"), F.col("speaker_sd"))
    return joined.withColumn("f0_norm", norm).drop("speaker_sd")


def time_is_normalised(data: DataFrame, *, time="time", token="token", eps=1e-8) -> DataFrame:
    """One row: ``normalised``, whether a time column already runs from 0 to 1 in most tokens."""
    t = F.col(time)
    spans = data.groupBy(token).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    one = spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.median(F.col("hi") - F.col("lo")).alias("span"))
    fits = (F.col("lo") >= -eps) & (F.col("hi") <= 1 + eps) & (F.col("lo") <= 0.05) & (F.col("hi") >= 0.95) & (F.col("span") >= 0.9)
    return one.select(F.coalesce(fits, F.lit(False)).alias("normalised"))


def resolve_time(data: DataFrame, *, time="time", token="token", time_normalised="auto", out="time01") -> DataFrame:
    """Adds 0-1 time: ``no`` scales each token (a single time becomes 0.5), ``yes`` takes the column and fails on values outside, ``auto`` decides by the data."""
    t, w = F.col(time), Window.partitionBy(token)
    lo, hi = F.min(t).over(w), F.max(t).over(w)
    scaled = F.when(t.isNull(), F.lit(None)).when(hi == lo, 0.5).otherwise(F.try_divide(t - lo, hi - lo))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    clamped = F.when(t.isNull(), F.lit(None)).otherwise(clamped)
    if time_normalised == "no":
        return data.withColumn(out, scaled)
    if time_normalised == "yes":
        bad = (t < -1e-8) | (t > 1 + 1e-8)
        return data.withColumn(out, F.when(bad, F.raise_error(F.lit("time values lie outside 0 to 1"))).otherwise(clamped).cast("double"))
    known = time_is_normalised(data, time=time, token=token)
    return data.crossJoin(F.broadcast(known)).withColumn(out, F.when(F.col("normalised"), clamped).otherwise(scaled)).drop("normalised")


def normalise_time_token(data: DataFrame, *, time="time", token="token", out="token_t01") -> DataFrame:
    """Adds whole-token 0-1 time; null for a token of one time and for a null token."""
    w = Window.partitionBy(token)
    lo, hi = F.min(time).over(w), F.max(time).over(w)
    share = F.try_divide(F.col(time) - lo, hi - lo)
    return data.withColumn(out, F.when(F.col(token).isNotNull() & share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))


def normalise_time_segment(data: DataFrame, *, time="time", segment: str) -> DataFrame:
    """Adds <segment>_t01 (0-1 within the segment) and <segment>_tseq (the segment's number less one, plus that)."""
    start, end = F.col(f"{segment}_start"), F.col(f"{segment}_end")
    share = F.try_divide(F.col(time) - start, end - start)
    t01 = F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    data = data.withColumn(f"{segment}_t01", t01)
    number = F.col(f"{segment}_i") - 1 if f"{segment}_i" in data.columns else F.lit(0)
    return data.withColumn(f"{segment}_tseq", number + F.col(f"{segment}_t01"))
