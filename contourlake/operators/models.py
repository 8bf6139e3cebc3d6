"""Growth-curve and smooth models from sums made on Spark.

All fits go through per-cell sums (tone, speaker, item): the Gram matrix of the time basis, the products
with f0 and the count. Their number does not grow with the samples of a cell. The random curves of the larger factor
are eliminated level by level on Spark (see ``mixed``); the driver solves the tones' curves and the smaller factor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.operators import mixed

#: Forms of random smooths.
RANDOM_SMOOTHS = ("none", "speaker", "speaker_tone", "speaker_by_tone", "ref_diff")


def poly_column(x: Column, coefficients) -> Column:
    """A polynomial with ascending coefficients, by Horner's rule."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(list(coefficients[:-1])):
        out = out * x + float(c)
    return out


def time_moments(data: DataFrame, time: str, degree: int) -> DataFrame:
    """One row: the sums of the powers of time up to 2 * degree, m0 .. m(2 degree)."""
    return data.agg(*(F.sum(F.pow(F.col(time), F.lit(i))).alias(f"m{i}") for i in range(2 * degree + 1)))


def orthogonal_polynomials(data: DataFrame, time: str, degree: int) -> np.ndarray:
    """Coefficients (row j: degree j, ascending) of polynomials orthonormal over the rows' times, from one pass of moments."""
    if data.filter(F.col(time).isNull()).limit(1).count():
        raise ValueError("time has missing values")
    m = np.array(time_moments(data, time, degree).first(), float)
    gram = np.array([[m[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.inv(np.linalg.cholesky(gram))


def cell_sums(data: DataFrame, basis: list[Column], y: str, keys: list[str]) -> DataFrame:
    """Per cell: n, yy, b<i> (basis times y) and g<i>_<j> (basis times basis)."""
    k = len(basis)
    rows = data.filter(F.col(y).isNotNull())
    sums = [F.sum(basis[i] * basis[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(basis[i] * F.col(y)).alias(f"b{i}") for i in range(k)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *sums)


@dataclass
class GrowthCurve:
    """Fixed effects per tone (tones x (degree + 1), on the orthogonal basis), their covariance, variances, the random terms' covariance matrices and the basis."""

    tones: list[str]
    effects: np.ndarray
    covariance: np.ndarray
    variances: dict[str, float]
    basis: np.ndarray
    degree: int
    covariances: dict[str, np.ndarray] = field(default_factory=dict)
    rounds: int = 0


def _factor_keys(data: DataFrame, tone: str, outer: str | None, inner: str | None) -> dict[str, Column]:
    text = lambda c: F.lit("").cast("string") if c is None else F.col(c).cast("string")
    return {"tone": F.col(tone).cast("string"), "outer": text(outer), "inner": text(inner)}


def _larger_first(data: DataFrame, sizes: dict[str, int]) -> list[str]:
    """The factors, that with most unknowns first."""
    if len(sizes) < 2:
        return list(sizes)
    counts = data.agg(*(F.approx_count_distinct(c).alias(c) for c in sizes)).first()
    return sorted(sizes, key=lambda c: -(counts[c] * sizes[c]))


def fit_growth_curve(data: DataFrame, *, f0="f0", time="time01", tone="tone", speaker="speaker", item="item", degree=2, random=("speaker",), rounds=60) -> GrowthCurve:
    """f0 on orthogonal polynomials of time within tones, random curves by speaker and/or item with full covariance matrices, by REML.

    ``random`` names the factors, or maps each to ``slopes`` (intercept and all slopes, which a name alone means) or ``intercept``; an empty one
    gives the fixed effects alone. Rows with a missing f0, tone, speaker or item are left out.
    """
    terms = dict(random) if isinstance(random, dict) else dict.fromkeys(random, "slopes")
    if unknown := {*terms} - {"speaker", "item"} | {*terms.values()} - {"slopes", "intercept"}:
        raise ValueError(f"unknown random terms: {sorted(unknown)}")
    columns = {"speaker": speaker, "item": item}
    data = data.dropna(subset=[f0, tone, *(columns[t] for t in terms)])
    coefficients, k = orthogonal_polynomials(data, time, degree), degree + 1
    basis = [F.lit(1.0)] + [poly_column(F.col(time), coefficients[j]) for j in range(1, k)]
    scale = np.array([1.0] + [1 / coefficients[0, 0]] * degree)  # functions of the size of 1 inside, so that variances start near their places
    parts = {t: mixed.Part(t, np.diag(scale) if kind == "slopes" else np.eye(k)[:1], []) for t, kind in terms.items()}
    order = _larger_first(data, {columns[t]: len(p.basis) for t, p in parts.items()})
    order = sorted(parts, key=lambda t: order.index(columns[t]))
    outer, inner = [*order, None][0] if order else None, order[1] if len(order) > 1 else None
    keys = _factor_keys(data, tone, columns.get(outer), columns.get(inner))
    cells = mixed.packed_sums(data, basis, F.col(f0), keys).persist(StorageLevel.MEMORY_AND_DISK)  # tones, levels and fit read it: the samples are summed once
    tones = sorted(r[0] for r in cells.select("tone").distinct().collect())
    for p in parts.values():
        p.copies = [0] * len(tones)
    found = mixed.fit(cells, tones=tones, fixed=np.diag(scale), places=[[i * k] for i in range(len(tones))], core_width=len(tones) * k, smooths=[], outer=[parts[outer]] if outer else [], inner=parts.get(inner), rounds=rounds)
    p, back = len(tones) * k, np.tile(scale, len(tones))
    covariances = {}
    for name, part in parts.items():
        own = scale[: len(part.basis)]
        covariances[name] = part.covariance * np.outer(own, own)
    variances = {"residual": found.noise} | {f"{name}_{i}": float(c[i, i]) for name, c in covariances.items() for i in range(len(c))}
    return GrowthCurve(tones, (found.core[:p] * back).reshape(-1, k), found.covariance[:p, :p] * np.outer(back, back), variances, coefficients, degree, covariances, found.rounds)


def predict_growth_curve(spark, model: GrowthCurve, n=100) -> DataFrame:
    """tone, time, f0_predicted on an even grid, fixed effects only."""
    grid = spark.range(n).select((F.col("id") / float(max(n - 1, 1))).alias("time"))
    basis = [F.lit(1.0)] + [poly_column(F.col("time"), model.basis[j]) for j in range(1, model.degree + 1)]
    tones = spark.createDataFrame([(t, *map(float, e)) for t, e in zip(model.tones, model.effects)], "tone string, " + ", ".join(f"e{i} double" for i in range(model.degree + 1)))
    value = F.lit(0.0)
    for i, b in enumerate(basis):
        value = value + F.col(f"e{i}") * b
    return tones.crossJoin(grid).select("tone", "time", value.alias("f0_predicted"))


def effects_table(spark, model: GrowthCurve) -> DataFrame:
    """tone, term, estimate, se."""
    k = model.degree + 1
    se = np.sqrt(np.maximum(np.diag(model.covariance), 0)).reshape(-1, k)
    return spark.createDataFrame([(t, i, float(model.effects[j, i]), float(se[j, i])) for j, t in enumerate(model.tones) for i in range(k)], "tone string, term int, estimate double, se double")


def contrasts(spark, model: GrowthCurve) -> DataFrame:
    """Differences of every pair of tones per term with standard errors."""
    k, c = model.degree + 1, model.covariance
    rows = []
    for i, a in enumerate(model.tones):
        for j in range(i + 1, len(model.tones)):
            for t in range(k):
                x, y = i * k + t, j * k + t
                rows.append((a, model.tones[j], t, float(model.effects[i, t] - model.effects[j, t]), float(np.sqrt(max(c[x, x] + c[y, y] - 2 * c[x, y], 0)))))
    return spark.createDataFrame(rows, "tone_a string, tone_b string, term int, difference double, se double")


def spline_basis(x: Column, k: int) -> list[Column]:
    """k cubic B-splines on even knots over 0-1."""
    h = 1.0 / (k - 3)
    out = []
    for j in range(k):
        u = x / h - (j - 3)
        w = lambda s: u - s
        out.append(
            F.when((u >= 0) & (u < 1), w(0) * w(0) * w(0) / 6)
            .when((u >= 1) & (u < 2), (-3 * w(1) * w(1) * w(1) + 3 * w(1) * w(1) + 3 * w(1) + 1) / 6)
            .when((u >= 2) & (u < 3), (3 * w(2) * w(2) * w(2) - 6 * w(2) * w(2) + 4) / 6)
            .when((u >= 3) & (u <= 4), (1 - w(3)) * (1 - w(3)) * (1 - w(3)) / 6)
            .otherwise(0.0)
        )
    return out


#: The four splines over a span of two knots, first to last, as cubics of the place in it (0-1), ascending.
SPAN = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6


def spline_sums(data: DataFrame, x: Column, k: int, y: Column, keys: dict[str, Column]) -> DataFrame:
    """What ``packed_sums`` gives for ``spline_basis(x, k)``, from few sums a row.

    Between two knots four splines are cubics of the place u, so the sums of u's powers up to the sixth, and of y times those up to the third, tell all
    products. Rows are summed by cell and span; the k (k + 1) / 2 products are put together from those sums.
    """
    place = x * (k - 3)
    rows = data.select(*(c.alias(n) for n, c in keys.items()), y.alias("__y"), F.floor(place).alias("__span"), (place - F.floor(place)).alias("__u")).filter(F.col("__y").isNotNull())
    u = F.col("__u")
    power = [F.lit(1.0), u, u * u, u * u * u]
    power += [power[3] * p for p in power[1:]]
    sums = rows.groupBy(*keys, "__span").agg(F.count("*").alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("yy"), *(F.sum(p).alias(f"__m{i}") for i, p in enumerate(power)), *(F.sum(F.col("__y") * p).alias(f"__c{i}") for i, p in enumerate(power[:4])))

    def total(parts: list[tuple[int, np.ndarray]], name: str) -> Column:
        """Sum over spans of a polynomial's coefficients times the sums of powers."""
        each = [F.when(F.col("__span") == span, sum((F.col(f"{name}{i}") * float(v) for i, v in enumerate(c) if v), F.lit(0.0))) for span, c in parts]
        return F.sum(F.coalesce(*each, F.lit(0.0)))

    g = [total([(s, np.convolve(SPAN[i - s], SPAN[j - s])) for s in range(j - 3, i + 1)], "__m") if j - i < 4 else F.sum(F.lit(0.0)) for i in range(k) for j in range(i, k)]
    b = [total([(s, SPAN[i - s]) for s in range(i - 3, i + 1)], "__c") for i in range(k)]
    wide = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("yy").alias("yy"), *(c.alias(f"g{i}") for i, c in enumerate(g)), *(c.alias(f"b{i}") for i, c in enumerate(b)))
    return wide.select(*keys, "n", "yy", F.array(*(f"g{i}" for i in range(len(g)))).alias("g"), F.array(*(f"b{i}" for i in range(len(b)))).alias("b"))


@dataclass
class Smooth:
    """Spline coefficients per tone and their covariances, a penalty per smooth (residual variance over the smooth's), residual and random variances.

    ``effects`` and ``covariance`` cover the time basis; ``mean_duration`` adds one more place, the effect of the duration smooth at the mean.
    ``random`` has a curve (on the time basis) for every speaker and tone, on Spark; ``items`` the item intercepts.
    """

    tones: list[str]
    effects: np.ndarray
    covariance: list[np.ndarray]
    penalties: dict[str, float]
    noise: float
    k: int
    rho: float = 0.0
    variances: dict[str, float] = field(default_factory=dict)
    random: DataFrame | None = None
    items: dict[str, float] = field(default_factory=dict)
    duration: np.ndarray | None = None
    duration_range: tuple[float, float] = (0.0, 1.0)
    mean_duration: float | None = None
    at_mean: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    rounds: int = 0


def _difference(k: int, order: int) -> np.ndarray:
    d = np.diff(np.eye(k), order, axis=0)
    return d.T @ d


def _random_parts(form: str, smooth_type: str, k: int, width: int, tones: list, intercepts: bool) -> list[mixed.Part]:
    """Random curves of speakers: wiggliness (first differences) and level have a variance each; an intercept has its own."""
    basis, level = np.eye(k, width), np.full((k, k), 1 / k)
    curves = lambda name, copies: mixed.Part(name, basis, copies, [(_difference(k, 1), k - 1), (level, 1)])
    count = range(len(tones))
    if form == "none":
        ones = np.zeros((1, width))
        ones[0, :k] = 1  # the splines sum to one
        return [mixed.Part("speaker", ones, [0] * len(tones), [(np.eye(1), 1)])] if intercepts else []
    if form == "speaker_tone":
        return [curves("speaker_tone", list(count))]
    by_tone = [curves(f"speaker_{tones[t]}", [0 if i == t else -1 for i in count]) for t in count]
    if form == "speaker_by_tone":
        return by_tone
    shared = curves("speaker", [0] * len(tones))
    return [shared] if form == "speaker" else [shared, *(by_tone if smooth_type == "separate" else by_tone[1:])]


def fit_smooth(data: DataFrame, *, f0="f0", time="time01", token="token", tone="tone", speaker="speaker", item=None, duration=None, k=10, smooth_type="separate", random_smooth="none", random_intercepts=True, use_ar1=False, rho: float | None = None, rounds=40) -> Smooth:
    """Penalised cubic splines of time per tone (``separate``) or as differences from the first tone, each with a penalty of its own, by REML.

    ``random_smooth``: ``speaker`` (a random curve for each speaker), ``speaker_tone`` (for each speaker and tone, one variance for all), ``speaker_by_tone``
    (the same with variances by tone), ``ref_diff`` (a curve of the speaker, and one more by tone: under ``difference`` for all tones but the first), or ``none``:
    random intercepts of speakers, if ``random_intercepts``. ``item`` names a column for random item intercepts, ``duration`` one for a penalised smooth that is zero on average.
    With ``use_ar1`` the first fit's residual correlation at lag 1 whitens each token's rows (value minus rho
    times the one before, the first frame kept) and the model is fitted once more. Rows with anything missing are left out.
    """
    if random_smooth not in RANDOM_SMOOTHS or smooth_type not in ("separate", "difference"):
        raise ValueError(f"no such smooth: {smooth_type}, {random_smooth}")
    grouped = random_smooth != "none" or random_intercepts
    needed = [f0, time, tone, *([speaker] if grouped else []), *([item] if item else []), *([duration] if duration else [])]
    known = data.dropna(subset=needed)
    basis, low, high, mean = spline_basis(F.col(time), k), 0.0, 1.0, None
    if duration:
        one = known.agg(F.min(duration), F.max(duration), F.avg(duration)).first()
        if one[0] is None or not one[0] < one[1]:
            raise ValueError("durations must differ")
        low, high, mean = map(float, one)
        basis = basis + spline_basis(_unit(F.col(duration), low, high), k)
    names = [f"__b{i}" for i in range(len(basis))]
    d = known.select(F.col(token).alias("__token"), F.col(tone).alias("__tone"), (F.col(speaker) if grouped else F.lit("")).alias("__speaker"), (F.col(item) if item else F.lit("")).alias("__item"), F.col(time).alias("__time"), F.col(f0).alias("__y"), *(b.alias(n) for b, n in zip(basis, names)))
    centre = None
    if duration:
        means = np.array(d.agg(*(F.avg(n) for n in names[k:])).first(), float)
        centre = np.linalg.svd(means[None])[2][1:].T  # coefficients whose smooth is zero on average
    if rho:
        w = Window.partitionBy("__token").orderBy("__time")
        white = lambda c: F.when(F.row_number().over(w) == 1, F.col(c)).otherwise(F.col(c) - rho * F.lag(c).over(w))
        d = d.select("__token", "__tone", "__speaker", "__item", "__time", *(white(c).alias(c) for c in ("__y", *names)))
    keys = _factor_keys(d, "__tone", "__speaker", "__item")
    cells = mixed.packed_sums(d, [F.col(c) for c in names], F.col("__y"), keys) if rho or duration else spline_sums(d, F.col("__time"), k, F.col("__y"), keys)
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)  # tones, levels and fit read it: the samples are summed once
    tones = sorted(r[0] for r in cells.select("tone").distinct().collect())
    p, width = len(tones) * k, len(names)
    places = [[i * k] if smooth_type == "separate" or i == 0 else [0, i * k] for i in range(len(tones))]
    smooths = [mixed.Smoothed(t if smooth_type == "separate" or i == 0 else f"{t} - {tones[0]}", i * k, _difference(k, 2), k - 2) for i, t in enumerate(tones)]
    extra, core_width = None, p
    if duration:
        extra = np.concatenate([np.zeros((k - 1, k)), centre.T], axis=1)
        smooths.append(mixed.Smoothed("duration", p, centre.T @ _difference(k, 2) @ centre, k - 2))
        core_width += k - 1
    ones = np.zeros((1, width))
    ones[0, :k] = 1
    inner = mixed.Part("item", ones, [0] * len(tones), [(np.eye(1), 1)]) if item else None
    outer = _random_parts(random_smooth, smooth_type, k, width, tones, random_intercepts)
    if inner and not outer:  # a lone factor is the one that is eliminated level by level
        cells = cells.withColumn("outer", F.col("inner")).withColumn("inner", F.lit(""))
        outer, inner = [inner], None
    fit = mixed.fit(cells, tones=tones, fixed=np.eye(k, width), places=places, core_width=core_width, smooths=smooths, outer=outer, inner=inner, extra=extra, rounds=rounds)
    model = _smooth_of(fit, k, places, p, centre, (low, high), mean, rho or 0.0, grouped, bool(item))
    if use_ar1 and rho is None:
        scored = score_smooth(data, model, f0=f0, time=time, tone=tone, speaker=speaker, item=item, duration=duration)
        first = residual_acf(scored, "residual", token=token, time=time, max_lag=1).filter("lag = 1").first()
        return fit_smooth(data, f0=f0, time=time, token=token, tone=tone, speaker=speaker, item=item, duration=duration, k=k, smooth_type=smooth_type, random_smooth=random_smooth, random_intercepts=random_intercepts, rho=float(np.clip(first["acf"] or 0.0, -0.95, 0.95)), rounds=rounds)
    return model


def _unit(x: Column, low: float, high: float) -> Column:
    """A value moved to 0-1; beyond the ends it counts as the end."""
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def spline_values(x: float, k: int) -> np.ndarray:
    """The k cubic B-splines of ``spline_basis`` at one place."""
    u = x * (k - 3) - (np.arange(k) - 3)
    w = lambda s: u - s
    pieces = [w(0) ** 3, -3 * w(1) ** 3 + 3 * w(1) ** 2 + 3 * w(1) + 1, 3 * w(2) ** 3 - 6 * w(2) ** 2 + 4, (1 - w(3)) ** 3]
    return np.select([(u >= 0) & (u < 1), (u >= 1) & (u < 2), (u >= 2) & (u < 3), (u >= 3) & (u <= 4)], pieces, 0.0) / 6


def _smooth_of(fit, k, places, p, centre, ends, mean, rho, grouped, with_items) -> Smooth:
    effects, spread, at_mean = [], [], []
    for own in places:
        take = np.zeros((k, len(fit.core)))
        for start in own:
            take[:, start : start + k] += np.eye(k)
        effects.append(take @ fit.core)
        spread.append(take @ fit.covariance @ take.T)
        if centre is not None:
            row = np.zeros(len(fit.core))
            row[p : p + k - 1] = spline_values((mean - ends[0]) / (ends[1] - ends[0]), k) @ centre
            both = np.vstack([take, row])
            at_mean.append((both @ fit.core, both @ fit.covariance @ both.T))
    penalties = {s.name: float(fit.noise / s.variance) for s in fit.smooths}
    variances = {f"{part.name}_{i}" if len(part.variances) > 1 else part.name: float(v) for part in [*fit.outer, *([fit.inner] if fit.inner else [])] for i, v in enumerate(part.variances)}
    lone_item = with_items and fit.inner is None
    items = {} if fit.inner is None else {x: float(v) for x, v in zip(fit.levels, fit.core[fit.design.inner_at :])}
    curves = fit.random_curves()
    if curves is not None:
        curves = curves.select(F.col("level").alias("item" if lone_item else "speaker"), "tone", F.slice("curve", 1, k).alias("curve"))
    duration = None if centre is None else centre @ fit.core[p : p + k - 1]
    return Smooth(fit.tones, np.array(effects), spread, penalties, fit.noise, k, rho, variances, curves, items, duration, ends, mean, at_mean, fit.rounds)


def predict_smooth(spark, model: Smooth, n=200, *, at_mean_duration=False) -> DataFrame:
    """tone, time, f0_predicted and se on an even grid; random terms left out. The duration smooth, which is zero on average, is left out too, or taken at the mean duration."""
    if at_mean_duration and not model.at_mean:
        raise ValueError("the model has no duration smooth")
    basis = spline_basis(F.col("time"), model.k) + ([F.lit(1.0)] if at_mean_duration else [])
    grid = spark.range(n).select((F.col("id") / float(max(n - 1, 1))).alias("time")).withColumn("b", F.array(*basis))
    found = model.at_mean if at_mean_duration else list(zip(model.effects, model.covariance))
    rows = [(t, [float(v) for v in e], [float(v) for v in c.ravel()]) for t, (e, c) in zip(model.tones, found)]
    tones = spark.createDataFrame(rows, "tone string, e array<double>, v array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    inner = F.transform("b", lambda bi, i: bi * dot(F.slice("v", i * len(basis) + 1, F.lit(len(basis))), F.col("b")))
    var = F.aggregate(inner, F.lit(0.0), lambda s, v: s + v)
    return tones.crossJoin(grid).select("tone", "time", dot(F.col("e"), F.col("b")).alias("f0_predicted"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("se"))


def score_smooth(data: DataFrame, model: Smooth, *, f0="f0", time="time01", tone="tone", speaker="speaker", item=None, duration=None) -> DataFrame:
    """Adds fitted (random terms and all) and residual to every frame; a level the model doesn't know adds nothing.

    Curves of speakers are joined by speaker and tone, however many there are; tones and items are small tables.
    """
    spark, columns = data.sparkSession, data.columns
    curves = spark.createDataFrame([(t, [float(v) for v in e]) for t, e in zip(model.tones, model.effects)], "__tone string, __e array<double>")
    data = data.join(F.broadcast(curves), F.col(tone).cast("string") == F.col("__tone"), "left")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    basis = F.array(*spline_basis(F.col(time), model.k))
    coefficients, rest = F.col("__e"), F.lit(0.0)
    if model.random is not None:
        level = "item" if "item" in model.random.columns else "speaker"
        key = {"item": item, "speaker": speaker}[level]
        own = model.random.select(F.col(level).alias("__level"), F.col("tone").alias("__of"), F.col("curve").alias("__c"))
        data = data.join(own, (F.col(key).cast("string") == F.col("__level")) & (F.col(tone).cast("string") == F.col("__of")), "left")
        coefficients = F.when(F.col("__c").isNull(), coefficients).otherwise(F.zip_with(coefficients, "__c", lambda a, b: a + b))
    if model.items:
        table = spark.createDataFrame(list(model.items.items()), "__item string, __offset double")
        data = data.join(F.broadcast(table), F.col(item).cast("string") == F.col("__item"), "left")
        rest = rest + F.coalesce("__offset", F.lit(0.0))
    if model.duration is not None:
        rest = rest + dot(F.array(*spline_basis(_unit(F.col(duration), *model.duration_range), model.k)), F.array(*(F.lit(float(v)) for v in model.duration)))
    return data.withColumn("fitted", dot(coefficients, basis) + rest).select(*columns, "fitted", (F.col(f0) - F.col("fitted")).alias("residual"))


def residual_acf(data: DataFrame, residual: str, *, token="token", time="time", rho=0.0, max_lag=40) -> DataFrame:
    """lag, acf and the band 1.96 / sqrt(n): autocorrelation within tokens, pooled, about the global mean.

    With ``rho`` the residuals are whitened first. All lags are windows over one partitioning by token.
    """
    w = Window.partitionBy(token).orderBy(time)
    d = data.filter(F.col(residual).isNotNull()).select(token, time, F.col(residual).alias("e"))
    if rho:
        d = d.withColumn("e", F.when(F.row_number().over(w) == 1, F.col("e")).otherwise(F.col("e") - rho * F.lag("e").over(w)))
    mean = d.agg(F.avg("e").alias("m"), F.count("*").alias("n"))
    d = d.crossJoin(F.broadcast(mean)).withColumn("c", F.col("e") - F.col("m"))
    lags = [(F.col("c") * F.lag("c", lag).over(w)).alias(f"l{lag}") for lag in range(1, max_lag + 1)]
    one = d.select("n", (F.col("c") * F.col("c")).alias("l0"), *lags).agg(F.first("n").alias("n"), *(F.sum(f"l{i}").alias(f"l{i}") for i in range(max_lag + 1)))
    pairs = F.array(*(F.struct(F.lit(i).alias("lag"), F.try_divide(F.coalesce(f"l{i}", F.lit(0.0)), F.col("l0")).alias("acf")) for i in range(max_lag + 1)))
    return one.select(F.explode(pairs).alias("p"), "n").select("p.lag", "p.acf", (1.96 / F.sqrt("n")).alias("band"))


def quantile_pairs(scored: DataFrame, residual="residual", n=101) -> DataFrame:
    """n pairs of normal and residual quantiles."""
    from statistics import NormalDist

    shares = [(i + 0.5) / n for i in range(n)]
    one = scored.agg(F.percentile_approx(residual, shares, 10000).alias("q"))
    normal = F.array(*(F.lit(NormalDist().inv_cdf(s)) for s in shares))
    return one.select(F.explode(F.arrays_zip(normal.alias("normal"), F.col("q").alias("residual"))).alias("p")).select("p.*")


def residual_histogram(scored: DataFrame, residual="residual", bins=30) -> DataFrame:
    """bin (1 .. bins), its lower edge and count."""
    ends = scored.agg(F.min(residual).alias("lo"), F.max(residual).alias("hi"))
    d = scored.filter(F.col(residual).isNotNull()).crossJoin(F.broadcast(ends))
    number = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col(residual) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins).cast("int") + 1)
    return d.groupBy(number.alias("bin"), (F.col("lo") + (number - 1) * (F.col("hi") - F.col("lo")) / bins).alias("edge")).count()


def binned_pairs(scored: DataFrame, x: str, y: str, bins=40) -> DataFrame:
    """How many rows lie in each cell of a grid of bins x bins over the ranges of two columns: x_bin, y_bin (1 .. bins), the cell's lower edges and count.

    The grid holds all rows, however many: one row a cell that isn't empty. Rows with a missing value are left out.
    """
    d = scored.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = d.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    d = d.crossJoin(F.broadcast(ends))
    place = lambda c: F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) * bins).cast("int") + 1)
    edge = lambda c: F.col(f"lo_{c}") + (F.col(f"{c}_bin") - 1) * (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins
    d = d.withColumn("x_bin", place("x")).withColumn("y_bin", place("y"))
    return d.groupBy("x_bin", "y_bin", edge("x").alias("x_edge"), edge("y").alias("y_edge")).agg(F.count("*").alias("count"))


def residual_vs_fitted(scored: DataFrame, bins=40) -> DataFrame:
    """The panel of residuals against fitted values as a grid of counts."""
    return binned_pairs(scored, "fitted", "residual", bins)


def observed_vs_fitted(scored: DataFrame, f0="f0", bins=40) -> DataFrame:
    """The panel of observed against fitted values as a grid of counts."""
    return binned_pairs(scored, "fitted", f0, bins)
