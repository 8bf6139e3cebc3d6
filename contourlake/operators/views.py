"""Loading, viewing, picking and exporting frames: projections, summaries, token filters and the export of a measured region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contourlake.functions.scalars import token_key
from contourlake.operators import correct, metadata as meta, region, resample, summaries

#: Names of an intensity column, best first.
INTENSITY_NAMES = ("intensity", "intensity_db", "int", "db")


def load_projection(table: DataFrame, recordings: DataFrame | None = None, *, token="token", time="time", f0="f0", keep: tuple[str, ...] = (), name="basename") -> DataFrame:
    """token, time, f0, intensity (null without such a column) and the columns to keep; bad numbers become null.

    With recordings only tokens that have one stay, matched by key.
    """
    lower = {c.lower(): c for c in reversed(table.columns)}
    found = next((lower[n] for n in INTENSITY_NAMES if n in lower), None)
    number = lambda c: F.col(c).cast("string").try_cast("double")
    level = number(found) if found else F.lit(None).cast("double")
    rows = table.select(F.col(token).cast("string").alias("token"), number(time).alias("time"), number(f0).alias("f0"), level.alias("intensity"), *keep)
    if recordings is None:
        return rows
    have = recordings.select(token_key(name).alias("__k")).distinct()
    return rows.withColumn("__k", token_key("token")).join(have, "__k", "left_semi").drop("__k")


def view(table: DataFrame, columns: list[str], digits: int | None = 2) -> DataFrame:
    """The chosen columns; fractions rounded to so many digits (missing or negative: 2), other types as they are."""
    digits = 2 if digits is None or digits < 0 else digits
    types = dict(table.dtypes)
    return table.select(*(F.round(c, digits).alias(c) if types[c] in ("double", "float") or types[c].startswith("decimal") else F.col(c) for c in columns))


def table_summary(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: known and missing values, distinct values, mean and sd of numbers, and the extremes as text."""
    types = dict(table.dtypes)
    columns = columns or table.columns
    numeric = lambda c: types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or types[c].startswith("decimal")
    none = F.lit(None).cast("double")
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count_distinct(c).alias("n_distinct"), (F.avg(c).cast("double") if numeric(c) else none).alias("mean"), (F.stddev_samp(c).cast("double") if numeric(c) else none).alias("sd"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max")) for c in columns]
    return table.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def pick_tokens(data: DataFrame, *, token="token", speaker="speaker", tone="tone", flagged: DataFrame | None = None, of_class: DataFrame | None = None, speakers=None, tones=None, edited: DataFrame | None = None, unedited: DataFrame | None = None, kept_without: DataFrame | None = None, discarded: DataFrame | None = None) -> DataFrame:
    """Tokens of the data that pass every given filter; the filter tables (one column token) are matched by key.

    ``flagged``, ``of_class``, ``edited`` and ``discarded`` keep their tokens, ``unedited`` and ``kept_without`` all others.
    A list of speakers or tones keeps tokens with a frame of one of them; an empty list keeps none.
    """
    rows = data.filter(F.col(token).isNotNull())
    out = rows.select(token).distinct().withColumn("__k", token_key(token))
    for column, values in ((speaker, speakers), (tone, tones)):
        if values is not None:
            out = out.join(rows.filter(F.col(column).cast("string").isin(*map(str, values))).select(token_key(token).alias("__k")).distinct(), "__k", "left_semi")
    for how, tables in (("left_semi", (flagged, of_class, edited, discarded)), ("left_anti", (unedited, kept_without))):
        for t in tables:
            if t is not None:
                out = out.join(t.select(token_key("token").alias("__k")).distinct(), "__k", how)
    return out.select(token)


def export_region(data: DataFrame, mode: str, *, token="token", time="time", f0="f0", tier: str | None = None, interval="vowel", labels: list[str] = (), min_run=2) -> DataFrame:
    """The frames to measure: ``whole`` tokens, their ``voiced`` part, or chosen intervals (vowel, labels, rhyme) of an attached ``tier``."""
    if mode == "whole":
        return data
    if mode == "voiced":
        return region.trim_to_voiced(data, token=token, time=time, f0=f0, min_run=min_run)
    if mode == "interval" and tier:
        return region.filter_intervals(data, tier, interval, labels, token=token)
    raise ValueError("mode: whole, voiced, or interval with a tier")


def region_losses(data: DataFrame, kept: DataFrame, *, token="token") -> DataFrame:
    """One row: tokens before and after, lost tokens and lost frames."""
    count = lambda d, a, b: d.agg(F.count_distinct(token).alias(a), F.count("*").alias(b))
    both = count(data, "n_tokens", "__a").crossJoin(F.broadcast(count(kept, "n_kept", "__b")))
    return both.select("n_tokens", "n_kept", (F.col("n_tokens") - F.col("n_kept")).alias("n_lost"), (F.col("__a") - F.col("__b")).alias("n_frames_lost"))


def export(data: DataFrame, corrected: DataFrame | None = None, dropped: DataFrame | None = None, metadata: DataFrame | None = None, *, key="key", mode="voiced", n: int | None = None, method="linear", token="token", time="time", f0="f0", **region_options) -> DataFrame:
    """Measured contours: corrected f0 in place of the raw one, discarded tokens out, the region, gap flags, even points, metadata.

    Gaps are flagged on the native frames, before any resampling: a point takes its value from the nearer frame, so a
    short gap may leave none missing. ``n`` points a token replace the frames' own times; None keeps these.
    """
    if corrected is not None or dropped is not None:
        none = data.select(F.col(token).alias("token")).limit(0)
        whole = correct.compare(data, data if corrected is None else corrected, none if dropped is None else dropped, token=token, time=time, f0=f0)
        data = summaries.drop_discarded(whole.withColumn(f0, F.col("f0_corrected")).drop("f0_corrected", "edited"))
    out = region.flag_f0_gaps(export_region(data, mode, token=token, time=time, f0=f0, **region_options), token=token, time=time, f0=f0)
    if n is not None:
        out = resample.resample_equal(out, n=n, method=method, token=token, time=time, f0=f0)
    return out if metadata is None else meta.join_all_metadata(out, metadata, key, token=token)
