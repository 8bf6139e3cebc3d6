"""Sums of splines from few sums a row equal the products of the splines themselves."""

import numpy as np
from pyspark.sql import functions as F

from contourlake.operators import mixed
from contourlake.operators import models as M


def test_spline_sums_equal_products(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(400), np.arange(15) / 7, [0.0, 1.0, 1.03, -0.1]])
    rows = [(float(v), float(rng.normal()) if i % 17 else None, "AB"[i % 2], str(i % 3)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, tone string, outer string")
    keys = {"tone": F.col("tone"), "outer": F.col("outer"), "inner": F.lit("")}
    for k in (5, 10):
        found = {r[:2]: r for r in M.spline_sums(df, F.col("x"), k, F.col("y"), keys).collect()}
        expected = {r[:2]: r for r in mixed.packed_sums(df, M.spline_basis(F.col("x"), k), F.col("y"), keys).collect()}
        assert found.keys() == expected.keys() and len(found) == 6
        for cell, r in expected.items():
            assert found[cell]["n"] == r["n"]
            for name in ("yy", "g", "b"):
                assert np.allclose(found[cell][name], r[name], rtol=1e-9, atol=1e-9)


def test_a_row_has_few_sums(spark):
    """The rows' own aggregation has a dozen sums, not one a product."""
    df = spark.createDataFrame([(0.5, 1.0, "A")], "x double, y double, tone string")
    plan = M.spline_sums(df, F.col("x"), 10, F.col("y"), {"tone": F.col("tone")})._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert rows.count("sum(") < 20
