"""Summaries of tokens, discards and table contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import voiced
from contourlake.operators.region import trim_to_voiced

NO_METADATA = "(no metadata)"


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up; sums that fall short of a half by floating-point noise count as halves."""
    return F.round(x + 1e-9, digits)


def token_summary(data: DataFrame, *, token="token", time="time", f0="f0", intensity="intensity") -> DataFrame:
    """Frames, voiced and unvoiced frames, mean, min and max f0 (2 digits), duration (3 digits) and mean intensity (1 digit) of each token."""
    v, f = voiced(f0), F.when(voiced(f0), F.col(f0))
    extra = [half_up(F.avg(intensity), 1).alias("mean_intensity")] if intensity in data.columns else []
    return data.groupBy(token).agg(F.count("*").alias("n_frames"), F.count_if(v).alias("n_voiced"), F.count_if(~v).alias("n_unvoiced"), half_up(F.avg(f), 2).alias("mean_f0"), half_up(F.min(f), 2).alias("min_f0"), half_up(F.max(f), 2).alias("max_f0"), half_up(F.max(time) - F.min(time), 3).alias("duration_s"), *extra)


def voiced_share(data: DataFrame, *, token="token", time="time", f0="f0", min_run=2, min_tokens=4) -> DataFrame:
    """voiced_s and voiced_prop of each token, and low_voiced: under half the corpus median where there are at least ``min_tokens`` tokens."""
    whole = data.groupBy(token).agg((F.max(time) - F.min(time)).alias("duration_s"))
    inner = trim_to_voiced(data, token=token, time=time, f0=f0, min_run=min_run).groupBy(F.col(token).alias("__t")).agg((F.max(time) - F.min(time)).alias("voiced_s"))
    t = whole.join(inner, F.col(token).eqNullSafe(F.col("__t")), "left").withColumn("voiced_s", F.coalesce("voiced_s", F.lit(0.0))).withColumn("voiced_prop", F.try_divide("voiced_s", "duration_s"))
    corpus = t.agg(F.median("voiced_prop").alias("mid"), F.count("voiced_prop").alias("n"))
    return t.crossJoin(F.broadcast(corpus)).select(token, "duration_s", "voiced_s", "voiced_prop", F.coalesce((F.col("n") >= min_tokens) & (F.col("voiced_prop") < 0.5 * F.col("mid")), F.lit(False)).alias("low_voiced"))


def discard_breakdown(tokens: DataFrame, *, dropped="dropped", speaker: str | None = "speaker", tone: str | None = "tone") -> DataFrame:
    """Discarded and total tokens of every speaker and tone, with margins (``Total``) and a grade: whole group gone, half or more, or none.

    With one of the two columns alone (the other None) there is one margin, its values in ``group``. A missing or
    empty value counts as ``(no metadata)``.
    """
    level = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NO_METADATA))
    if speaker is None or tone is None:
        named = tokens.select(level(speaker or tone).alias("group"), F.col(dropped).alias("d"))
        counts = named.rollup("group").agg(F.count_if("d").alias("discarded"), F.count("*").alias("total"), F.grouping("group").alias("g"))
        return counts.select(F.when(F.col("g") == 1, "Total").otherwise(F.col("group")).alias("group"), "discarded", "total", *_cell_and_grade())
    named = tokens.select(level(speaker).alias("speaker"), level(tone).alias("tone"), F.col(dropped).alias("d"))
    cube = named.cube("speaker", "tone").agg(F.count_if("d").alias("discarded"), F.count("*").alias("total"), F.grouping("speaker").alias("gs"), F.grouping("tone").alias("gt"))
    return cube.select(F.when(F.col("gs") == 1, "Total").otherwise(F.col("speaker")).alias("speaker"), F.when(F.col("gt") == 1, "Total").otherwise(F.col("tone")).alias("tone"), "discarded", "total", *_cell_and_grade())


def _cell_and_grade() -> list[Column]:
    share = 100 * F.col("discarded") / F.col("total")
    text = F.concat(F.col("discarded").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), F.format_string("%.1f", share), F.lit("%)"))
    grade = F.when(F.col("total") == 0, "").when(F.col("discarded") == F.col("total"), "whole group gone").when(share >= 50, "half or more").otherwise("")
    return [text.alias("cell"), grade.alias("grade")]


def sorted_levels(data: DataFrame, column: str) -> DataFrame:
    """Distinct levels in order, the missing one last."""
    levels = data.select(F.coalesce(F.col(column).cast("string"), F.lit(NO_METADATA)).alias("level")).distinct()
    return levels.withColumn("place", F.row_number().over(Window.orderBy((F.col("level") == NO_METADATA).cast("int"), "level")))


def cardinalities(data: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and distinct values of each column."""
    return data.agg(F.count("*").alias("n_observations"), *(F.count_distinct(c).alias(f"n_{c}") for c in columns))


def drop_discarded(data: DataFrame, *, flag="token_dropped") -> DataFrame:
    """Rows not marked as discarded, without the mark; unknown counts as kept."""
    return data.filter(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).drop(flag)


def discard_counts(data: DataFrame, *, token="token", flag="token_dropped") -> DataFrame:
    """One row: discarded and all tokens."""
    return data.agg(F.count_distinct(F.when(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)), F.col(token))).alias("n_drop"), F.count_distinct(token).alias("n_tot"))


def frame_positions(data: DataFrame, *, token="token", time="time") -> DataFrame:
    """Adds the frame's index in its token and its place in percent."""
    w = Window.partitionBy(token)
    d = data.withColumn("frame_index", F.row_number().over(w.orderBy(time)))
    return d.withColumn("frame_pct", F.try_divide(100.0 * (F.col("frame_index") - 1), F.count("*").over(w) - 1))


def part_lines(data: DataFrame, part: str, *, token="token", time="time") -> DataFrame:
    """Adds line_group (token, and part where there is one); frames without aligned time are dropped."""
    return data.filter(F.col(time).isNotNull()).withColumn("line_group", F.concat_ws("##", token, F.col(part).cast("string")))


def unpivot(diagnostics: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Diagnostics in long form: key, metric, value."""
    return diagnostics.unpivot([key], metrics, "metric", "value")


def nearest(values: Column, x: Column, n: int) -> Column:
    """The n elements of an array of structs whose ``time`` is nearest to x, the earlier first on ties."""
    marked = F.transform(values, lambda v: F.struct(F.abs(v["time"] - x).alias("d"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(marked), 1, n), lambda m: m["v"])
