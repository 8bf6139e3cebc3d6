"""Exact medians of groups of any size, from counts of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins a unit of value: how finely a group is cut up before values are ranked.
BINS = 4096

#: Values beyond this share the outermost bins (they are still ranked exactly).
FAR = 1e15


def group_medians(counts: DataFrame, key: str, value: str, n: str, *, same=(), sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per group: the key, ``median`` (the mean of the two middle values), columns that are the ``same`` in a whole group, and ``sums`` over it.

    ``counts`` has a group's values with how often each occurs; a value may stand on several rows. Counts per bin find
    the one or two bins that hold the middle ranks, and only values in those are ranked. A window holds a group's bins
    (their number goes by the range of values) or the values of one bin, never a group. Null values count in ``sums`` alone
    and NaN is the greatest value. Keys are joined by equality: make the key a struct where its parts may be null.
    """
    sums = sums or {}
    near = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("__v")))
    rows = counts.withColumn("__v", F.col(value).cast("double")).withColumn("__bin", F.coalesce(F.when(F.col("__v").isNotNull(), F.floor(near * BINS)), F.lit(-(1 << 62))))

    def hit(before: Column, here: Column, rank: Column) -> Column:
        return (before <= rank) & (rank < before + here)

    group = Window.partitionBy(key)
    bins = rows.groupBy(key, "__bin").agg(F.sum(F.when(F.col("__v").isNotNull(), F.col(n)).otherwise(0)).alias("__in"), *(F.max(c).alias(c) for c in same), *(F.sum(c).alias(name) for name, c in sums.items()))
    bins = bins.withColumns({"__all": F.sum("__in").over(group), "__before": F.sum("__in").over(group.orderBy("__bin")) - F.col("__in"), **{name: F.sum(name).over(group) for name in sums}})
    bins = bins.withColumns({"__lo": F.floor((F.col("__all") - 1) / 2), "__hi": F.floor(F.col("__all") / 2)})
    bins = bins.filter(hit(F.col("__before"), F.col("__in"), F.col("__lo")) | hit(F.col("__before"), F.col("__in"), F.col("__hi")) | (F.col("__all") == 0))

    carried = ["__before", "__lo", "__hi", *same, *sums]
    middle = rows.select(key, "__bin", "__v", F.col(n).alias("__n")).join(bins.select(key, "__bin", *carried), [key, "__bin"])
    values = middle.groupBy(key, "__bin", "__v").agg(F.sum("__n").alias("__in"), *(F.max(c).alias(c) for c in carried))
    values = values.withColumn("__start", F.col("__before") + F.sum("__in").over(Window.partitionBy(key, "__bin").orderBy("__v")) - F.col("__in"))
    at = lambda rank: F.max(F.when(hit(F.col("__start"), F.col("__in"), F.col(rank)), F.col("__v")))
    ends = values.groupBy(key).agg(at("__lo").alias("__a"), at("__hi").alias("__b"), *(F.max(c).alias(c) for c in (*same, *sums)))
    return ends.select(key, F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(0.5 * F.col("__a") + 0.5 * F.col("__b")).alias("median"), *same, *sums)
