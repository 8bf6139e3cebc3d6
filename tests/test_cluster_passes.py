"""Passes of clusterings: points are dealt to all cores, sums by matrices equal sums row by row."""

import numpy as np
from pyspark.sql import functions as F

from contourlake.operators import lloyd


def test_few_points_are_dealt_to_all_parts(spark):
    rows = spark.range(500).groupBy((F.col("id") % 250).alias("g")).agg(F.sum("id").alias("s"))
    points = lloyd.read_points(rows.select(F.col("g").cast("string").alias("token"), F.array(F.col("g") / 7.0, F.col("s") / 11.0).alias("features")))
    try:
        assert points.n == 250
        assert sum(size > 0 for size in points.rows.rdd.glom().map(len).collect()) >= 4
    finally:
        points.rows.unpersist()


def test_sums_of_few_clusters():
    rng = np.random.default_rng(3)
    x = rng.integers(-8, 9, size=(3000, 3)) / 4  # products of quarters are exact, so are ties
    for k in (1, 2, 8):
        centres = rng.integers(-8, 9, size=(5, k, 3)) / 4
        centres[0, -1] = centres[0, 0]  # all rows tie: the first takes them
        at = ((x[:, None, None] - centres) ** 2).sum(axis=3).argmin(axis=2)
        found = lloyd._sums(x, centres)
        for r in range(5):
            for j in range(k):
                mine = x[at[:, r] == j]
                assert found[r, j].tolist() == [len(mine), *mine.sum(axis=0), (mine**2).sum()]
