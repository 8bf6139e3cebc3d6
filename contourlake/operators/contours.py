"""Mean contours per tone and polynomials per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import legendre
from contourlake.operators.normalise import resolve_time


def mean_contour(data: DataFrame, *, token="token", f0="f0", time="time", tone="tone", n_bins=50, time_normalised="auto") -> DataFrame:
    """tone, time (bins of 0-1 time, rounded half to even) and f0_predicted (mean of known f0)."""
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    timed = resolve_time(data, time=time, token=token, time_normalised=time_normalised, out="__t01")
    bins = timed.select(F.col(tone).cast("string").alias("tone"), (F.rint(F.col("__t01") * (n_bins - 1)) / (n_bins - 1)).alias("time"), F.col(f0).alias("__f0"))
    return bins.groupBy("tone", "time").agg(F.avg("__f0").alias("f0_predicted"))


#: Squared share of a column's length below which it counts as a sum of the lower ones.
RELATIVE = 1e-11

#: x times P_m in Legendre polynomials: weights of P_(m+1) and P_(m-1).
TIMES_X = [((m + 1) / (2 * m + 1), m / (2 * m + 1)) for m in range(3)]


def _shifted(series: list[Column]) -> list[Column]:
    """Legendre coefficients of x times a series."""
    out = [F.lit(0.0)] * (len(series) + 1)
    for m, c in enumerate(series):
        up, down = TIMES_X[m]
        out[m + 1] = out[m + 1] + up * c
        if m:
            out[m - 1] = out[m - 1] + down * c
    return out


def fit_polynomial(data: DataFrame, *, f0="f0", token="token", time="time", speaker="speaker", tone="tone", degree=2, time_normalised="auto") -> DataFrame:
    """Legendre coefficients c0 .. c_degree of every token on 2t - 1.

    Each token gets its own orthogonal polynomials by the three-term recurrence, one window of sums a degree, and what the lower ones left
    of f0 is projected on the next: normal equations would square the condition of a token whose samples lie close together.
    A token with one time gets its mean as c0 and nulls; one with fewer than degree + 1 known samples, nulls. Where equal
    times leave fewer than degree + 1 independent terms, the higher ones are null and the others fitted without them.
    """
    if degree not in (1, 2, 3):
        raise ValueError("degree must be 1, 2 or 3")
    timed = resolve_time(data, time=time, token=token, time_normalised=time_normalised, out="__t01")
    known, whole, k = F.col(f0).isNotNull() & F.col("__t01").isNotNull(), Window.partitionBy(token), degree + 1
    x = F.col("__x")
    rows = timed.select(token, speaker, tone, time, F.when(known, F.col(f0).cast("double")).alias("__y"), F.when(known, 2 * F.col("__t01") - 1).alias("__x"))
    rows = rows.withColumn("__q0", F.when(x.isNotNull(), 1.0)).withColumn("__r0", F.col("__y"))
    for m in range(k):  # q: the m-th orthogonal polynomial at the samples; r: f0 less its share of the lower ones
        q, r, square = F.col(f"__q{m}"), F.col(f"__r{m}"), F.col(f"__s{m}")
        rows = rows.withColumns({f"__s{m}": F.sum(q * q).over(whole), f"__b{m}": F.sum(q * r).over(whole), f"__m{m}": F.sum(x * q * q).over(whole)})
        rows = rows.withColumn(f"__d{m}", F.try_divide(F.col(f"__b{m}"), square)).withColumn(f"__a{m}", F.try_divide(F.col(f"__m{m}"), square))
        if m < degree:
            lower = F.try_divide(square, F.col(f"__s{m - 1}")) * F.col(f"__q{m - 1}") if m else F.lit(0.0)
            rows = rows.withColumn(f"__q{m + 1}", (x - F.col(f"__a{m}")) * q - lower).withColumn(f"__r{m + 1}", r - F.col(f"__d{m}") * q)
    first = F.min_by(F.struct(F.col(speaker).alias("speaker"), F.col(tone).alias("tone")), F.col(time)).alias("meta")
    sums = [F.first(f"__{c}{m}").alias(f"{c}{m}") for m in range(k) for c in "sda"] + [F.sum(p * p).alias(f"g{m}") for m, p in enumerate(legendre(x, degree))]
    rows = rows.groupBy(token).agg(first, F.count("__q0").alias("n"), F.max(time).alias("hi"), F.min(time).alias("lo"), F.avg("__y").alias("mean"), *sums)
    rank, lead = F.lit(k), [1.0, 1.0, 1.5, 2.5]  # a term is aliased when what its column has beyond the lower ones vanishes beside its own length
    for m in range(k, 0, -1):
        rank = F.when(lead[m - 1] ** 2 * F.col(f"s{m - 1}") > RELATIVE * F.col(f"g{m - 1}"), rank).otherwise(F.lit(m - 1))
    rows = rows.withColumn("rank", rank)
    for m in range(k):  # the orthogonal polynomials in Legendre's
        if m == 0:
            series = [F.lit(1.0)]
        else:
            below = [F.col(f"l{m - 1}_{i}") for i in range(m)]
            series = [c - F.col(f"a{m - 1}") * below[i] if i < m else c for i, c in enumerate(_shifted(below))]
            if m > 1:
                ratio = F.try_divide(F.col(f"s{m - 1}"), F.col(f"s{m - 2}"))
                series = [c - ratio * F.col(f"l{m - 2}_{i}") if i < m - 1 else c for i, c in enumerate(series)]
        rows = rows.withColumns({f"l{m}_{i}": c for i, c in enumerate(series)})
    out = []
    for c in range(k):
        solved = F.lit(0.0)
        for m in range(c, k):
            solved = solved + F.when(F.col("rank") > m, F.col(f"d{m}") * F.col(f"l{m}_{c}")).otherwise(0.0)
        single = F.col("mean") if c == 0 else F.lit(None).cast("double")
        out.append(F.when(F.col("hi") == F.col("lo"), single).when((F.col("n") < k) | (F.col("rank") <= c), F.lit(None)).otherwise(solved).alias(f"c{c}"))
    return rows.select(token, F.col("meta.speaker").alias(speaker), F.col("meta.tone").alias(tone), *out)


def coefficient_table(coefficients: DataFrame, *, tone="tone") -> DataFrame:
    """Per tone: fitted and skipped tokens, and the mean of each coefficient."""
    names = [c for c in coefficients.columns if c.startswith("c") and c[1:].isdigit()]
    return coefficients.groupBy(tone).agg(F.count("c0").alias("n_fitted"), F.count_if(F.col("c0").isNull()).alias("n_skipped"), *(F.avg(c).alias(f"mean_{c}") for c in names))
