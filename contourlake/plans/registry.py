"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.plans.sql import EVENT_FRAMES, frames_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded_as_sql(x: Column, digits: int) -> Column:
    """Rounding as DuckDB does it: the product with the power of ten is rounded and divided again. Spark's own rounds the decimal text, which differs in halves of a large value's last digits."""
    scale = 10.0**digits
    return F.round(x * scale) / scale


def query(name: str, sql: str | None = None, rounded: str = "", base: str | None = EVENT_FRAMES):
    """Register a query. ``rounded`` columns are rounded to 6 digits on both sides; ``base`` is the adapter the SQL starts from."""
    columns = rounded.split()
    nudge = 1.3e-8  # keeps values that are halves of the last digit from being rounded by their floating-point noise

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: rounded_as_sql(F.col(c) + nudge, 6) + F.lit(0.0) for c in columns}) if columns else df

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql:
            full = frames_sql(sql, base) if base else sql.strip()
            parts = ", ".join(f"round({c} + {nudge}, 6) + 0.0::DOUBLE AS {c}" for c in columns)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({parts}) FROM ({full})" if columns else full
        return f

    return register
