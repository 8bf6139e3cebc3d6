"""Contour features, clustering, choosing the number of clusters, and agreement with labels.

Features are one row per token with arrays; clustering runs on Spark, and only k-sized tables reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import cosine_rows, normal_mass
from contourlake.operators import lloyd
from contourlake.operators.mixed import summed
from contourlake.operators.resample import finite, grid_time, points_between


def token_contours(data: DataFrame, *, f0="f0", token="token", time="time", speaker="speaker", tone="tone", n_points=20, register="level") -> DataFrame:
    """token, speaker, tone and contour (n_points values at equal steps of the token's time, linear between known samples).

    Samples of equal time are averaged, those without a finite time or value left out, and so are tokens with under two distinct times. ``shape`` takes each contour's mean off.
    """
    if n_points < 4:
        raise ValueError("n_points must be at least 4")
    known = data.filter(F.col(f0).isNotNull() & ~F.isnan(F.col(f0).cast("double")) & finite(time))
    d = known.groupBy(token, F.col(time).cast("double").alias("__t")).agg(F.avg(f0).alias("__f"))
    whole = Window.partitionBy(token)
    w = whole.orderBy("__t")
    d = d.select("*", F.lead("__t").over(w).alias("__nt"), F.lead("__f").over(w).alias("__nf")).select("*", F.min("__t").over(whole).alias("__t0"), F.max("__t").over(whole).alias("__t9"))
    t, nt, t0, t9 = (F.col(c) for c in ("__t", "__nt", "__t0", "__t9"))
    position = lambda t: (t - t0) / (t9 - t0) * (n_points - 1)
    d = d.filter(nt.isNotNull()).withColumn("__p", F.explode(points_between(position(t), position(nt), n_points))).withColumn("__x", grid_time(F.col("__p"), n_points, t0, t9))
    x, f, nf = F.col("__x"), F.col("__f"), F.col("__nf")
    d = d.filter((x >= t) & ((x < nt) | (nt == t9))).select(token, F.struct(F.col("__p").alias("p"), (f + (x - t) / (nt - t) * (nf - f)).alias("v")).alias("__v"))
    rows = d.groupBy(token).agg(F.transform(F.array_sort(F.collect_list("__v")), lambda v: v["v"]).alias("contour"))
    if register == "shape":
        mean = F.aggregate("contour", F.lit(0.0), lambda s, v: s + v) / n_points
        rows = rows.withColumn("__mean", mean).withColumn("contour", F.transform("contour", lambda v: v - F.col("__mean")))
    meta = [c for c in (speaker, tone) if c]
    first = data.groupBy(F.col(token).alias("__token")).agg(F.min_by(F.struct(*meta), time).alias("m"))
    joined = rows.join(first, F.col(token).eqNullSafe(F.col("__token")), "left")
    return joined.select(F.col(token).alias("token"), *(F.col(f"m.{c}").alias(c) for c in meta), "contour")


def features(contours: DataFrame, kind="points", degree=4, n_points: int | None = None) -> DataFrame:
    """Adds features: the points, Legendre or cosine coefficients (each divided by its sd over all tokens), or first differences.

    ``n_points`` is the contours' number of points; where it isn't given, one contour is made to count them.
    """
    if kind == "points":
        return contours.withColumn("features", F.col("contour"))
    if kind == "derivative":
        return contours.withColumn("features", F.transform(F.slice("contour", F.lit(2), F.size("contour") - 1), lambda v, i: v - F.get("contour", i)))
    n = n_points
    if n is None:
        first = contours.select(F.size("contour")).first()
        n = first[0] if first else 20
    if degree + 1 > n:
        raise ValueError("degree is too high for the number of points")
    x = np.linspace(-1, 1, n)
    matrix = np.linalg.pinv(np.polynomial.legendre.legvander(x, degree)) if kind == "legendre" else np.array(cosine_rows(n, degree + 1))
    dots = [F.aggregate(F.zip_with("contour", F.array(*(F.lit(float(v)) for v in row)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in matrix]
    raw = contours.withColumn("features", F.array(*dots))
    spread = raw.agg(F.array(*(F.coalesce(F.nullif(F.stddev_samp(F.get("features", F.lit(i))), F.lit(0.0)), F.lit(1.0)) for i in range(degree + 1))).alias("sd"))
    return raw.crossJoin(F.broadcast(spread)).withColumn("features", F.zip_with("features", "sd", lambda a, b: a / b)).drop("sd")


def with_vectors(feat: DataFrame) -> DataFrame:
    return feat.withColumn("__v", array_to_vector("features"))


def kmeans(feat: DataFrame, k: int, *, starts=25, max_iter=50, seed=1) -> DataFrame:
    """Adds cluster (1..k): the best of several seeded starts by total cost, all starts side by side."""
    return kmeans_of_each(feat, [k], starts=starts, max_iter=max_iter, seed=seed).withColumn("cluster", F.col("clusters")[F.lit(k)]).drop("clusters")


def kmeans_of_each(feat: DataFrame, ks, *, starts=25, max_iter=50, seed=1) -> DataFrame:
    """Adds clusters: a map from every k to the cluster of the best start, all k and starts side by side."""
    points = lloyd.read_points(feat, seed)
    try:
        centres, _ = lloyd.best_runs(points, list(ks), starts=starts, max_iter=max_iter)
    finally:
        points.rows.unpersist()
    return lloyd.with_clusters(feat, points, centres)


def gaussian_mixture(feat: DataFrame, k: int, *, starts=25, iterations=60, seed=1, forms=lloyd.FORMS) -> DataFrame:
    """Adds cluster and uncertainty (1 - the largest posterior) of a mixture of spherical or diagonal covariances, the form of the largest BIC.

    All forms are fitted side by side, an iteration of all is one aggregation; the components' means and variances come back as literals of k x p numbers.
    """
    points = lloyd.read_points(feat, seed)
    try:
        centres, _ = lloyd.best_runs(points, [k], starts=starts)
        best = lloyd.best_form(lloyd.mixtures(points, centres, forms=forms, iterations=iterations), k)
    finally:
        points.rows.unpersist()
    return with_posterior(feat, best.weight, best.mean + points.mean, best.var)


def with_posterior(feat: DataFrame, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> DataFrame:
    """Adds cluster and uncertainty under a mixture with these weights, means and variances (components x dims)."""
    out = feat.withColumn("__r", F.slice(_posterior(weight, mean, var), 1, len(weight)))
    top = F.array_max("__r")
    return out.withColumn("cluster", F.array_position("__r", top).cast("int")).withColumn("uncertainty", 1 - top).drop("__r")


def mixture_table(feat: DataFrame, k_range=range(2, 9), *, starts=25, iterations=60, seed=1, forms=lloyd.FORMS) -> DataFrame:
    """k, form and bic (twice the log likelihood less the number of parameters times log n; the larger the better, null where a component collapsed)."""
    points = lloyd.read_points(feat, seed)
    try:
        centres, _ = lloyd.best_runs(points, list(k_range), starts=starts)
        models = lloyd.mixtures(points, centres, forms=forms, iterations=iterations)
    finally:
        points.rows.unpersist()
    return feat.sparkSession.createDataFrame([(k, form, m.bic) for (k, form), m in models.items()], "k int, form string, bic double")


def _posterior(weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
    """Responsibilities of the components, and the log likelihood as one more element."""
    logs = []
    for w, m, v in zip(weight, mean, var):
        pairs = F.zip_with(F.zip_with("features", F.array(*(F.lit(float(x)) for x in m)), lambda a, b: (a - b) * (a - b)), F.array(*(F.lit(float(1 / x)) for x in v)), lambda d, i: d * i)
        base = math.log(max(w, 1e-300)) - 0.5 * (np.log(2 * np.pi * v).sum())
        logs.append(F.lit(float(base)) - 0.5 * F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))

    def share(z):
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        return F.concat(F.transform(e, lambda x: x / total), F.array(F.array_max(z) + F.log(total)))

    return F.element_at(F.transform(F.array(F.array(*logs)), share), 1)


def hierarchical(feat: DataFrame, k: int, *, method="ward", micro=2000, seed=1) -> DataFrame:
    """Adds cluster: k-means micro-clusters merged by Ward's or average linkage on their sizes, centres and scatter.

    Average linkage is the mean squared distance over all pairs of tokens of two groups.
    The driver merges at most ``micro`` centres, however many tokens there are, by chains of nearest neighbours.
    """
    points = lloyd.read_points(feat, seed, pool=2 * micro)
    try:
        count = min(micro, max(k, points.n // 4), len(np.unique(points.pool, axis=0)))
        centres = lloyd.best_runs(points, [count], starts=1)[0][count]
        sums = lloyd.pass_of(points, {(0, count): centres[None]})[0, count][0]
    finally:
        points.rows.unpersist()
    full = sums[:, 0] > 0
    centres, sums = centres[full], sums[full]
    n, mean = sums[:, 0], sums[:, 1:-1] / sums[:, :1]
    merges = lloyd.merge_order(n, mean, np.maximum(sums[:, -1] / n - (mean**2).sum(axis=1), 0), method)
    return _labelled(feat, centres + points.mean, lloyd.cut_merges(len(n), merges, k) + 1)


def _labelled(feat: DataFrame, centres: np.ndarray, labels: np.ndarray) -> DataFrame:
    """Adds cluster: the label of the nearest centre, null for rows without finite features."""
    at = feat.columns.index("features")

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            x = [None if v is None or None in v else v for v in lists.to_pylist()]
            ok = np.array([v is not None and bool(np.isfinite(v).all()) for v in x])
            found = np.zeros(len(x), np.int32)
            if ok.any():
                found[ok] = labels[lloyd.nearest(np.array([v for v, o in zip(x, ok) if o], float), centres[None])[:, 0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32(), mask=~ok)], names=[*batch.schema.names, "cluster"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feat.schema)
    return feat.mapInArrow(run, f"{fields}, cluster int")


def cluster_means(assigned: DataFrame, *, cluster="cluster") -> DataFrame:
    """cluster, position (from 1), value (mean contour) and size."""
    e = assigned.select(F.col(cluster).alias("cluster"), F.posexplode("contour"))
    return e.groupBy("cluster", (F.col("pos") + 1).alias("position")).agg(F.avg("col").alias("value"), F.count("*").alias("size"))


def relabel_by_height(assigned: DataFrame, *, cluster="cluster") -> DataFrame:
    """Clusters renumbered from low to high by the mean of their mean contour."""
    height = cluster_means(assigned, cluster=cluster).groupBy("cluster").agg(F.avg("value").alias("h"))
    places = {r["cluster"]: i + 1 for i, r in enumerate(height.orderBy("h", "cluster").collect())}
    new = F.lit(None).cast("int")
    for old, place in places.items():
        new = F.when(F.col(cluster) == old, place).otherwise(new)
    return assigned.withColumn(cluster, new)


def compare_solutions(assigned: DataFrame, *, clusters="clusters") -> DataFrame:
    """k, cluster, position, value (mean contour) and size for every entry of a map from k to the cluster; clusters numbered from low to high by their mean."""
    each = assigned.select("contour", F.explode(clusters).alias("k", "__c")).filter(F.col("__c").isNotNull())
    means = each.select("k", "__c", F.posexplode("contour")).groupBy("k", "__c", (F.col("pos") + 1).alias("position")).agg(F.avg("col").alias("value"), F.count("*").alias("size"))
    height = means.groupBy("k", "__c").agg(F.avg("value").alias("h"))
    places = height.select("k", "__c", F.row_number().over(Window.partitionBy("k").orderBy("h", "__c")).alias("cluster"))  # k rows for each k
    return means.join(places, ["k", "__c"]).select("k", "cluster", "position", "value", "size")


def playback_contours(assigned: DataFrame, *, base: float | None = None) -> DataFrame:
    """Mean contour of every cluster in Hz: as it is, or deviations in semitones around ``base``."""
    m = cluster_means(assigned)
    return m if base is None else m.withColumn("value", base * F.pow(F.lit(2.0), F.col("value") / 12))


def contingency(assigned: DataFrame, *, cluster="cluster", label="tone") -> DataFrame:
    """Counts of cluster and label, pairs with a missing side left out."""
    return assigned.filter(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).count()


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row: ari, the adjusted Rand index of a contingency table; 0 where it is undefined."""
    pairs = lambda n: n * (n - 1) / 2
    cells = table.agg(F.sum(pairs(F.col("count"))).alias("ij"), F.sum("count").alias("n"))
    rows = table.groupBy("cluster").agg(F.sum("count").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("a"))
    cols = table.groupBy("label").agg(F.sum("count").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("b"))
    one = cells.crossJoin(rows).crossJoin(cols)
    expected = F.try_divide(F.col("a") * F.col("b"), pairs(F.col("n")))
    return one.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(0.0)).alias("ari"))


def description_length(assigned: DataFrame, *, cluster="cluster", eps=1.0, bending=1.0, by=()) -> DataFrame:
    """One row: model, partition and residual cost of a clustering in nats, and their bent sum; one for each value of the columns ``by``.

    Every number is coded by the probability of its eps-interval: cluster means under the global normal of
    their dimension, tokens under their cluster's.
    """
    by = list(by)
    e = assigned.select(*by, F.col(cluster).alias("c"), F.posexplode("contour"))
    stats = e.groupBy(*by, "c", "pos").agg(F.avg("col").alias("m"), F.stddev_samp("col").alias("s"), F.count("*").alias("n"))
    whole = e.groupBy(*by, "pos").agg(F.avg("col").alias("gm"), F.stddev_samp("col").alias("gs"))
    usable = lambda s: F.when(F.col(s) > 0, F.col(s)).otherwise(eps)

    def nats(x, m, s):
        low = F.floor(F.col(x) / eps) * eps
        p = normal_mass(low, low + eps, F.col(m), usable(s))
        return -F.log(F.when(p > 0, p).otherwise(float(np.finfo(float).tiny)))

    residual = e.join(F.broadcast(stats), [*by, "c", "pos"]).groupBy(*by).agg(F.sum(nats("col", "m", "s")).alias("residual"))
    model = stats.join(whole, [*by, "pos"]).groupBy(*by).agg(F.sum(nats("m", "gm", "gs")).alias("model"))
    part = partition_cost(assigned, cluster=cluster, by=by)
    one = residual.join(model, by).join(part, by) if by else residual.crossJoin(model).crossJoin(part)
    return one.select(*by, "model", "partition", "residual", (F.col("model") / bending + F.col("partition") + F.col("residual") / bending).alias("mdl"))


def partition_cost(assigned: DataFrame, *, cluster="cluster", by=()) -> DataFrame:
    """One row: n log n minus the sum over clusters; one for each value of the columns ``by``."""
    sizes = assigned.groupBy(*by, F.col(cluster).alias("c")).count()
    return sizes.groupBy(*by).agg((F.sum("count") * F.log(F.sum("count")) - F.sum(F.col("count") * F.log("count"))).alias("partition"))


def silhouette(assigned: DataFrame, *, cluster="cluster") -> DataFrame:
    """One row: mean silhouette on squared distances, from cluster sums alone (linear in tokens)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    assigned = assigned.withColumn("__norm", dot(F.col("features"), F.col("features")))
    e = assigned.select(F.col(cluster).alias("c"), F.posexplode("features"))
    centres: dict = {}
    for r in e.groupBy("c", "pos").agg(F.sum("col").alias("s")).orderBy("c", "pos").collect():  # k x p numbers
        centres.setdefault(r["c"], []).append(float(r["s"]))
    sums = assigned.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), F.sum("__norm").alias("q")).collect()
    distance = lambda r: F.greatest(F.lit(0.0), F.col("__norm") * r["n"] + r["q"] - 2 * dot(F.col("features"), F.array(*(F.lit(v) for v in centres[r["c"]]))))
    own, other, alone = F.lit(0.0), F.lit(None).cast("double"), F.lit(False)
    for r in sums:
        mine = F.col(cluster) == r["c"]
        own = F.when(mine, distance(r) / max(r["n"] - 1, 1)).otherwise(own)
        other = F.least(other, F.when(~mine, distance(r) / r["n"]))
        alone = alone | mine if r["n"] == 1 else alone
    s = F.when(alone, 0.0).otherwise(F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0)))
    return assigned.withColumn("__s", s).drop("__norm").agg(F.avg("__s").alias("silhouette"))


#: Points that are compared with all rows when the silhouette is taken on plain distances: by default and at most.
SILHOUETTE_POINTS, MOST_POINTS = 2000, 20_000


def silhouette_euclidean(assigned: DataFrame, points: DataFrame | None = None, *, cluster="cluster", sample=SILHOUETTE_POINTS, seed=1) -> DataFrame:
    """One row: mean silhouette on plain distances over some points, their number and the mean's standard error.

    Plain distances have no closed sums, so ``points`` (or the ``sample`` rows of smallest hash; all rows, where there are
    no more) are broadcast and compared with every row: tasks add up each point's distances to each cluster in blocks, and only those sums are shuffled.
    ``points`` have the columns of ``assigned`` and stand among its rows; over MOST_POINTS raise an error. Rows without a cluster or with features
    that are null or not finite take no part; a point alone in its cluster counts 0, and so does one whose distances are all 0.
    The standard error is null for fewer than two points, the mean without any point or with one cluster alone.
    """
    finite = F.col(cluster).isNotNull() & F.col("features").isNotNull() & F.forall("features", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    plain = lambda df: df.filter(finite).select(F.col(cluster).alias("c"), F.transform("features", lambda v: v.cast("double")).alias("features"))
    spark, rows = assigned.sparkSession, plain(assigned)
    chosen = plain(points).limit(MOST_POINTS + 1) if points is not None else rows.orderBy(F.xxhash64("c", "features", F.lit(seed)), "c", "features").limit(sample)
    taken = chosen.toArrow()
    if taken.num_rows > MOST_POINTS:
        raise ValueError(f"at most {MOST_POINTS} points can be compared with all rows")
    schema = "silhouette double, n_points long, std_error double"
    counts = dict(rows.groupBy("c").count().collect())  # one row a cluster
    if not taken.num_rows or len(counts) < 2:
        return spark.createDataFrame([(None, taken.num_rows, None)], schema)
    labels = sorted(counts)
    code, n = {c: i for i, c in enumerate(labels)}, np.array([counts[c] for c in labels], float)
    x, mine = np.array(taken["features"].to_pylist(), float), np.array([code[c] for c in taken["c"].to_pylist()])
    sent, k, p = spark.sparkContext.broadcast(x), len(labels), x.shape[1]
    step = max(1, lloyd.CELLS // 1024)

    def run(batches):
        sums = np.zeros((len(sent.value), k))
        for batch in batches:
            at = np.array([code[c] for c in batch.column(0).to_pylist()], np.int64)
            v = batch.column(1).flatten().to_numpy().reshape(-1, p)
            for i in range(0, len(v), 1024):
                for j in range(0, len(sums), step):
                    square = np.zeros((len(v[i : i + 1024]), len(sums[j : j + step])))
                    for d in range(p):
                        square += (v[i : i + 1024, d, None] - sent.value[None, j : j + step, d]) ** 2
                    distances = np.sqrt(square)
                    for c in np.unique(at[i : i + 1024]):
                        sums[j : j + step, c] += distances[at[i : i + 1024] == c].sum(axis=0)
        for j in range(0, len(sums), 256):
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([sums[j : j + 256].ravel().tolist()], pa.list_(pa.float64()))], names=["key", "v"])

    found = summed(rows.mapInArrow(run, lloyd.KEYED), 2)
    sent.unpersist()
    total = np.concatenate([found[j].reshape(-1, k) for j in sorted(found)])
    each = np.arange(len(x))
    own, mean = total[each, mine] / np.maximum(n[mine] - 1, 1), total / n
    mean[each, mine] = np.inf
    other = mean.min(axis=1)
    top = np.maximum(own, other)
    s = np.where((n[mine] <= 1) | (top <= 0), 0.0, (other - own) / np.where(top > 0, top, 1))
    return spark.createDataFrame([(float(s.mean()), len(s), float(s.std(ddof=1) / math.sqrt(len(s))) if len(s) > 1 else None)], schema)


def within_cost(assigned: DataFrame, *, cluster="cluster") -> DataFrame:
    """One row: total squared distance to the cluster centres (wss)."""
    e = assigned.select(F.col(cluster).alias("c"), F.posexplode("features"))
    per = e.groupBy("c", "pos").agg((F.var_pop("col") * F.count("*")).alias("w"))
    return per.agg(F.sum("w").alias("wss"))


def choose_k(feat: DataFrame, k_range=range(2, 9), *, starts=25, gap_references=0, eps=1.0, bending=1.0, seed=1, forms=lloyd.FORMS) -> DataFrame:
    """k, wss, silhouette, gap, gap_se, mdl and bic (of the mixture's best form) for every k.

    Runs of all k, of all starts and of the data and all reference tables go side by side, one pass over the points an iteration. Reference tables
    (for the gap) are uniform in the box of the points' principal axes and get as many starts as the data; the gap compares the logarithms of
    squared distances to the centres, which are sums over points, where the usual one adds up the distances of all pairs.
    """
    spark, ks = feat.sparkSession, sorted({int(k) for k in k_range if k >= 2})
    points = lloyd.read_points(feat, seed)
    try:
        ks = [k for k in ks if k < points.n]
        if not ks:
            raise ValueError("no k of the range is below the number of points")
        centres, cost = lloyd.best_runs(points, ks, starts=starts, references=gap_references)
        silhouette_of = lloyd.silhouettes(points, centres)
        models = lloyd.mixtures(points, centres, forms=forms)
    finally:
        points.rows.unpersist()
    each = lloyd.with_clusters(feat, points, centres).select("contour" if "contour" in feat.columns else F.col("features").alias("contour"), F.explode("clusters").alias("k", "cluster")).filter(F.col("cluster").isNotNull())
    mdl = description_length(each, eps=eps, bending=bending, by=["k"]).select("k", "mdl")
    rows = []
    for k in ks:
        logs = np.log(np.maximum([cost[b, k] for b in range(gap_references + 1)], 1e-300))
        gap = float(logs[1:].mean() - logs[0]) if gap_references else None
        se = float(logs[1:].std(ddof=1) * math.sqrt(1 + 1 / gap_references)) if gap_references > 1 else None
        rows.append((k, cost[0, k], silhouette_of[k], gap, se, lloyd.best_form(models, k).bic))
    table = spark.createDataFrame(rows, "k int, wss double, silhouette double, gap double, gap_se double, bic double")
    return table.join(mdl, "k", "left").select("k", "wss", "silhouette", "gap", "gap_se", "mdl", "bic")


def suggestions(diagnostics: DataFrame) -> DataFrame:
    """One row: k by silhouette, by mdl, by gap and by the mixture's bic, and the automatic choice in the order mixture, silhouette, gap, 3.

    By gap it is the first k that comes within one standard error of the next one's gap, or the last k; else the k of the largest gap.
    """
    d = diagnostics
    for c in ("gap", "gap_se", "bic"):
        d = d.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None)) if c in d.columns else F.lit(None).cast("double"))
    w = Window.orderBy("k")  # a table of a few rows
    later = F.lead(F.col("gap") - F.coalesce("gap_se", F.lit(0.0))).over(w)
    d = d.withColumn("__first", F.col("gap").isNotNull() & (F.lead("k").over(w).isNull() | F.coalesce(F.col("gap") >= later, F.lit(False))))
    one = d.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k_silhouette"), F.min_by("k", F.struct("mdl", "k")).alias("k_mdl"), F.coalesce(F.min(F.when(F.col("__first"), F.col("k"))), F.max_by(F.when(F.col("gap").isNotNull(), F.col("k")), F.struct("gap", -F.col("k")))).alias("k_gap"), F.max_by(F.when(F.col("bic").isNotNull(), F.col("k")), F.struct("bic", -F.col("k"))).alias("k_gmm"))
    return one.withColumn("k_auto", F.coalesce("k_gmm", "k_silhouette", "k_gap", F.lit(3)))


def membership_confidence(assigned: DataFrame) -> DataFrame:
    """One row: tokens with an uncertainty over 0.4, their share and the mean uncertainty."""
    return assigned.agg(F.count_if(F.col("uncertainty") > 0.4).alias("n_uncertain"), (F.count_if(F.col("uncertainty") > 0.4) / F.count("*")).alias("share"), F.avg("uncertainty").alias("mean_uncertainty"))


def project(feat: DataFrame, dims=2) -> DataFrame:
    """Adds pc1.. of a centred principal component projection and their shares of the variance in percent."""
    v = with_vectors(feat)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(v).transform(v)
    model = PCA(k=dims, inputCol="__c", outputCol="__p").fit(centred)
    shares = model.explainedVariance.toArray()
    out = model.transform(centred).withColumn("__p", vector_to_array("__p"))
    return out.select(*feat.columns, *(F.get("__p", F.lit(i)).alias(f"pc{i + 1}") for i in range(dims)), *(F.lit(float(100 * s)).alias(f"pct{i + 1}") for i, s in enumerate(shares)))


def labels_on_frames(data: DataFrame, assigned: DataFrame, names: dict[int, str] | None = None, *, token="token") -> DataFrame:
    """Adds cluster and its chosen name to frames; tokens without features get null."""
    a = assigned.select(F.col("token").alias("__token"), "cluster")
    name = F.lit(None).cast("string")
    for c, text in (names or {}).items():
        name = F.when(F.col("cluster") == c, text).otherwise(name)
    return data.join(a, F.col(token).eqNullSafe(F.col("__token")), "left").drop("__token").withColumn("cluster_name", name)
