"""Metadata joined to frames by token key, and checks of that match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import split_parts, token_key


def join_first_metadata(data: DataFrame, metadata: DataFrame, key: str, *, token="token", order: str) -> DataFrame:
    """Columns the data lacks, from the first metadata row (by ``order``) of the same token key."""
    new = [c for c in metadata.columns if c not in data.columns and c != key]
    m = metadata.withColumn("__mkey", token_key(key))
    first = m.groupBy("__mkey").agg(F.min_by(F.struct(*new), order).alias("__m")) if new else m.select("__mkey").distinct()
    out = data.withColumn("__key", token_key(token)).join(first, F.col("__key").eqNullSafe(F.col("__mkey")), "left")
    return out.select(*data.columns, *(F.col(f"__m.{c}").alias(c) for c in new))


def join_all_metadata(data: DataFrame, metadata: DataFrame, key: str, *, token="token") -> DataFrame:
    """Every metadata row of the same token key; columns the data has too get the ending ``.meta``."""
    m = metadata.withColumn("__mkey", token_key(key)).drop(key)
    for c in metadata.columns:
        if c in data.columns and c != key:
            m = m.withColumnRenamed(c, c + ".meta")
    return data.withColumn("__key", token_key(token)).join(m, F.col("__key").eqNullSafe(F.col("__mkey")), "left").drop("__key", "__mkey")


def match_report(data: DataFrame, metadata: DataFrame, key: str, *, token="token") -> DataFrame:
    """One row: tokens, matched tokens, tokens without metadata and metadata keys without tokens."""
    a = data.select(token_key(token).alias("k")).distinct().withColumn("a", F.lit(1))
    b = metadata.select(token_key(key).alias("k")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "k", "full")
    return both.agg(F.count("a").alias("n_tokens"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_matched"), F.count_if(F.col("b").isNull()).alias("n_without_metadata"), F.count_if(F.col("a").isNull()).alias("n_without_token"))


def split_token(data: DataFrame, separator: str, names: list[str], *, token="token") -> DataFrame:
    """Adds one column per part of the token name; short names leave null."""
    return data.select("*", *(p.alias(n or f"column_{i + 1}") for i, (n, p) in enumerate(zip(names, split_parts(token, separator, len(names))))))


def part_counts(data: DataFrame, separator: str, *, token="token") -> DataFrame:
    """Fewest and most parts of the distinct token names."""
    n = F.size(F.split(token, r"\Q" + separator + r"\E", -1))
    return data.select(token).distinct().agg(F.min(n).alias("min_parts"), F.max(n).alias("max_parts"))


def first_of_token(data: DataFrame, columns: list[str], *, token="token", time="time") -> DataFrame:
    """One row per token with the columns of its first frame by time."""
    return data.groupBy(token).agg(F.min_by(F.struct(*columns), time).alias("m")).select(token, *(F.col(f"m.{c}").alias(c) for c in columns))


def event_starts(data: DataFrame, *, token="token", time="time") -> DataFrame:
    """Adds event_start: whether a frame is its token's first."""
    return data.withColumn("event_start", F.row_number().over(Window.partitionBy(token).orderBy(time)) == 1)
