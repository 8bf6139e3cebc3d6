"""Many clusterings side by side: k-means for all numbers of clusters, starts and reference tables, and mixtures of all forms.

An iteration of all runs together is one pass over the points: each task sums its rows by (table, run, cluster), the
sums of the tasks are added by one exchange, and only they come to the driver: (clusters of all runs) x (dimensions + 2) numbers, whatever
the number of points. A run that no longer moves leaves the passes. Reference points are never stored: a point of
reference table b is made of the hash of a row and b, the same in every pass and on every executor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contourlake.operators.mixed import summed

#: Most numbers in a table of distances at once.
CELLS = 4_000_000
#: Rows that first centres are picked from: those of smallest hash, so the same rows each time.
POOL = 2000
#: A run has settled when its centres move less than this share of the points' spread.
SETTLED = 1e-9
#: Covariance forms of mixtures: one variance, one a component, one a dimension, one for each of both.
FORMS = ("EII", "VII", "EEI", "VVI")
FLOOR = 1e-6


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, table: int, dims: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1), rows x dims, from row keys and the number of a reference table."""
    salt = _mixed_bits(np.array([(seed * 1_000_003 + table * 4096 + d + 1) & 0xFFFFFFFFFFFFFFFF for d in range(dims)], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (_mixed_bits(keys.view(np.uint64)[:, None] + salt) >> np.uint64(11)) / float(1 << 53)


@dataclass
class Points:
    """Points of a table on Spark (key, features) and what a box of reference points needs."""

    rows: DataFrame
    n: int
    mean: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spread: float
    seed: int
    pool_keys: np.ndarray
    pool: np.ndarray

    def table(self, keys: np.ndarray, x: np.ndarray, b: int) -> np.ndarray:
        """The centred points themselves (table 0), or uniform ones in the box of their principal axes."""
        if b == 0:
            return x - self.mean
        return (self.low + uniform(keys, b, len(self.mean), self.seed) * (self.high - self.low)) @ self.axes.T


def read_points(feat: DataFrame, seed: int = 1, pool: int = POOL) -> Points:
    """Points of a table with ``features`` (rows without them, or with values that aren't finite, take no part). Unpersist ``rows`` when done."""
    finite = F.col("features").isNotNull() & F.forall("features", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    named = ["token"] if "token" in feat.columns else []
    rows = feat.filter(finite).select(F.xxhash64(*named, "features").alias("key"), F.transform("features", lambda v: v.cast("double")).alias("features"))
    rows = rows.repartition(_parts(feat.sparkSession), "key").persist(StorageLevel.MEMORY_AND_DISK)
    first = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(pool).toArrow()
    if not first.num_rows:
        raise ValueError("no points to cluster")
    keys, x = first["key"].to_numpy(), np.array(first["features"].to_pylist(), float)
    p = x.shape[1]

    def run(batches):
        sums = np.zeros(1 + p + p * p)
        for _, x in _arrays(batches, p):
            sums += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield _row(0, sums)

    sums = summed(rows.mapInArrow(run, KEYED), 0)[0]
    n, mean = int(sums[0]), sums[1 : 1 + p] / sums[0]
    scatter = sums[1 + p :].reshape(p, p) - n * np.outer(mean, mean)
    axes = np.linalg.eigh(scatter)[1]

    def ends(batches):
        low, high = np.full(p, np.inf), np.full(p, -np.inf)
        for _, x in _arrays(batches, p):
            if len(x):
                turned = (x - mean) @ axes
                low, high = np.minimum(low, turned.min(axis=0)), np.maximum(high, turned.max(axis=0))
        if np.isfinite(low).all():
            yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int64()), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    box = rows.mapInArrow(ends, "d bigint, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").toArrow()
    return Points(rows, n, mean, axes, box["low"].to_numpy(), box["high"].to_numpy(), float(np.trace(scatter) / n), seed, keys, x)


def _parts(spark) -> int:
    """Parts that points are dealt to: they are few bytes but much work, so their number must not go by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


KEYED = "key bigint, v array<double>"


#: A task has at least so many products to work out; smaller passes use fewer tasks.
TASK_WORK = 100_000_000


def _pass(points: Points, work: int, run) -> dict[int, np.ndarray]:
    """One pass over the points, of so many products a point, and the sums of what its tasks give."""
    tasks = max(1, math.ceil(points.n * work / TASK_WORK))
    return summed(points.rows.coalesce(tasks).mapInArrow(run, KEYED), tasks)


def _row(key: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["key", "v"])


def _arrays(batches, p: int):
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("features"))
        yield batch.column(0).to_numpy(), lists.flatten().to_numpy().reshape(-1, p)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For every row and run (runs x k x p) the nearest centre; ties to the first."""
    runs, k, p = centres.shape
    flat = centres.reshape(-1, p)
    d = (flat**2).sum(axis=1) - 2 * x @ flat.T
    return d.reshape(len(x), runs, k).argmin(axis=2)


#: Up to so many clusters the rows of each are added up by a product of matrices.
FEW_CLUSTERS = 16
#: Distances that are worked out at once there, so that they stay in the processor's cache.
CACHED = 200_000


def _sums_of_few(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The same sums for few clusters: for each cluster a table of ones (runs x rows) times the rows; ties to the first."""
    runs, k, p = centres.shape
    flat = np.swapaxes(centres, 0, 1).reshape(-1, p)
    left = np.concatenate([(flat**2).sum(axis=1)[:, None], -2 * flat], axis=1)
    wide = np.concatenate([np.ones((len(x), 1)), x, (x**2).sum(axis=1)[:, None]], axis=1)
    out = np.zeros((k, runs, p + 2))
    step = max(64, CACHED // (runs * k))
    for i in range(0, len(x), step):
        part = wide[i : i + step]
        d = (left @ part[:, :-1].T).reshape(k, runs, -1)
        least = d.min(axis=0)
        taken = np.zeros(least.shape, bool)
        for j in range(k):
            mine = (d[j] == least) & ~taken
            taken |= mine
            out[j] += mine.astype(float) @ part
    return np.swapaxes(out, 0, 1)


def _sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Count, sum and sum of squares of the rows nearest to each centre: runs x k x (p + 2)."""
    runs, k, p = centres.shape
    if k <= FEW_CLUSTERS:
        return _sums_of_few(x, centres)
    out = np.zeros((runs * k, p + 2))
    step = max(1, CELLS // (runs * k))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        at = (nearest(part, centres) + k * np.arange(runs)).ravel()
        out[:, 0] += np.bincount(at, minlength=runs * k)
        for d in range(p):
            out[:, 1 + d] += np.bincount(at, np.repeat(part[:, d], runs), runs * k)
        out[:, -1] += np.bincount(at, np.repeat((part**2).sum(axis=1), runs), runs * k)
    return out.reshape(runs, k, p + 2)


def pass_of(points: Points, active: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """One pass: for each (table, k) the sums of all its runs, given their centres (runs x k x p)."""
    sent = points.rows.sparkSession.sparkContext.broadcast(active)
    shape = Points(None, points.n, points.mean, points.axes, points.low, points.high, points.spread, points.seed, None, None)
    p = len(points.mean)
    code = {key: i for i, key in enumerate(active)}

    def run(batches):
        sums = {key: np.zeros((*c.shape[:2], p + 2)) for key, c in sent.value.items()}
        for keys, x in _arrays(batches, p):
            made: tuple[int, np.ndarray | None] = (-1, None)
            for (b, k), centres in sent.value.items():
                if made[0] != b:
                    made = (b, shape.table(keys, x, b))
                sums[b, k] += _sums(made[1], centres)
        for key, v in sums.items():
            yield _row(code[key], v.ravel())

    found = _pass(points, p * sum(c.shape[0] * c.shape[1] for c in active.values()), run)
    sent.unpersist()
    return {key: found[i].reshape(*active[key].shape[:2], p + 2) for key, i in code.items()}


def costs(sums: np.ndarray) -> np.ndarray:
    """Squared distances of each run's points to the means of their clusters."""
    n = np.maximum(sums[..., 0], 1)
    return (sums[..., -1] - (sums[..., 1:-1] ** 2).sum(axis=-1) / n).sum(axis=-1)


def first_centres(points: Points, table: int, k: int, starts: int) -> np.ndarray:
    """Centres to start from: for each start, k different rows of the pool (of the reference table, the points made of their keys)."""
    x = np.unique(points.table(points.pool_keys, points.pool, table), axis=0)
    if len(x) < k:
        raise ValueError(f"{k} clusters of {len(x)} different points")
    rng = np.random.default_rng([points.seed, table, k])
    return np.stack([x[rng.choice(len(x), k, replace=False)] for _ in range(starts)])


def lloyd(points: Points, centres: dict[tuple[int, int], np.ndarray], max_iter: int = 50) -> tuple[dict[tuple[int, int], np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """Lloyd's iterations of all runs: centres (about the mean of the points) and costs by (table, k). A centre without points stays where it is."""
    centres = {key: c.copy() for key, c in sorted(centres.items())}
    cost = {key: np.full(len(c), np.inf) for key, c in centres.items()}
    moving = {key: np.arange(len(c)) for key, c in centres.items()}
    for _ in range(max_iter):
        active = {key: centres[key][at] for key, at in moving.items() if len(at)}
        if not active:
            break
        for key, sums in pass_of(points, active).items():
            at, n = moving[key], sums[..., :1]
            new = np.where(n > 0, sums[..., 1:-1] / np.maximum(n, 1), active[key])
            cost[key][at] = costs(sums)
            moved = ((new - active[key]) ** 2).sum(axis=2).max(axis=1)
            centres[key][at] = new
            moving[key] = at[moved > SETTLED * points.spread]
    return centres, cost


def best_runs(points: Points, ks, *, starts: int, references: int = 0, max_iter: int = 50) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], float]]:
    """The centres of the cheapest run of the data for each k, and the least cost of each (table, k); tables 1 .. ``references`` are reference tables."""
    first = {(b, k): first_centres(points, b, k, starts) for b in range(references + 1) for k in ks}
    centres, cost = lloyd(points, first, max_iter)
    return {k: centres[0, k][cost[0, k].argmin()] for k in ks}, {key: float(c.min()) for key, c in cost.items()}


def with_clusters(feat: DataFrame, points: Points, centres: dict[int, np.ndarray], column: str = "clusters") -> DataFrame:
    """Adds a map from k to the cluster (from 1) of each row, null for rows that take no part: the nearest of the centres, as an expression."""
    mean = points.mean

    def distance(c):
        return F.aggregate(F.zip_with("features", F.array(*(F.lit(float(v)) for v in c + mean)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    def one(c):
        ranked = F.transform(F.array(*(distance(x) for x in c)), lambda d, i: F.struct(d.alias("d"), (i + 1).alias("i")))
        return F.array_min(ranked)["i"]

    usable = F.col("features").isNotNull() & F.forall("features", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    pairs = [x for k, c in centres.items() for x in (F.lit(k), F.when(usable, one(c)))]
    return feat.withColumn(column, F.create_map(*pairs))


def silhouettes(points: Points, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette on squared distances for each k: one pass for the clusters' sums and one for the rows."""
    sums = {k: v[0] for (_, k), v in pass_of(points, {(0, k): c[None] for k, c in centres.items()}).items()}
    mean, p = points.mean, len(points.mean)

    def run(batches):
        total = {k: 0.0 for k in centres}
        for _, x in _arrays(batches, p):
            x = x - mean
            norm = (x**2).sum(axis=1)
            for k, c in centres.items():
                n, s, q = sums[k][:, 0], sums[k][:, 1:-1], sums[k][:, -1]
                d = np.maximum(norm[:, None] * n + q - 2 * x @ s.T, 0)
                at, rows = nearest(x, c[None])[:, 0], np.arange(len(x))
                own = d[rows, at] / np.maximum(n[at] - 1, 1)
                other = np.where(n > 0, d / np.maximum(n, 1), np.inf)
                other[rows, at] = np.inf
                other = other.min(axis=1)
                top = np.maximum(own, other)
                total[k] += np.where((n[at] <= 1) | (top <= 0) | ~np.isfinite(top), 0.0, (other - own) / np.where(top > 0, top, 1)).sum()
        yield _row(0, np.array(list(total.values())))

    found = _pass(points, p * sum(len(c) for c in centres.values()), run)[0]
    return {k: float(v) / points.n for k, v in zip(centres, found)}


@dataclass
class Mixture:
    """Weights, means and variances (components x dims) of a Gaussian mixture, its form and BIC (None where a component collapsed)."""

    form: str
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    bic: float | None = None


def _variances(form: str, n: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Variances of a form from the components' counts and scatter (components x dims)."""
    k, p = scatter.shape
    if form == "EII":
        v = np.full((k, p), scatter.sum() / (n.sum() * p))
    elif form == "VII":
        v = np.repeat(scatter.sum(axis=1, keepdims=True) / (n[:, None] * p), p, axis=1)
    elif form == "EEI":
        v = np.repeat(scatter.sum(axis=0, keepdims=True) / n.sum(), k, axis=0)
    else:
        v = scatter / n[:, None]
    return v


def parameters(form: str, k: int, p: int) -> int:
    """Free parameters of a mixture: weights, means and variances."""
    return k - 1 + k * p + {"EII": 1, "VII": k, "EEI": p, "VVI": k * p}[form]


def responsibilities(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Posterior share of each component (rows x components) and each row's log likelihood."""
    inverse = 1 / m.var
    logs = np.log(np.maximum(m.weight, 1e-300)) - 0.5 * np.log(2 * np.pi * m.var).sum(axis=1)
    z = logs - 0.5 * (x**2 @ inverse.T - 2 * x @ (m.mean * inverse).T + (m.mean**2 * inverse).sum(axis=1))
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def mixtures(points: Points, centres: dict[int, np.ndarray], *, forms=FORMS, iterations: int = 60, tolerance: float = 1e-5) -> dict[tuple[int, str], Mixture]:
    """Expectation-maximisation for every k and form side by side, from the k-means clusters; one pass an iteration. Means are about the points' mean."""
    p, n = len(points.mean), points.n
    start = {k: v[0] for (_, k), v in pass_of(points, {(0, k): c[None] for k, c in centres.items()}).items()}
    floor = FLOOR * max(points.spread / p, 1e-300)
    models: dict[tuple[int, str], Mixture] = {}
    for k, s in start.items():
        for form in forms:
            models[k, form] = _maximised(form, s, p, floor)
    last: dict[tuple[int, str], float] = {}
    moving = list(models)
    mean = points.mean
    for i in range(iterations + 1):
        sent = points.rows.sparkSession.sparkContext.broadcast([(key, models[key]) for key in moving])

        def run(batches, sent=sent):
            sums = [np.zeros((len(m.weight), 2 * p + 2)) for _, m in sent.value]
            for _, x in _arrays(batches, p):
                x = x - mean
                for s, (_, m) in zip(sums, sent.value):
                    step = max(1, CELLS // len(m.weight))
                    for j in range(0, len(x), step):
                        r, likelihood = responsibilities(x[j : j + step], m)
                        s[:, 0] += r.sum(axis=0)
                        s[:, 1 : 1 + p] += r.T @ x[j : j + step]
                        s[:, 1 + p : -1] += r.T @ x[j : j + step] ** 2
                        s[0, -1] += likelihood.sum()
            for i, s in enumerate(sums):
                yield _row(i, s.ravel())

        found = _pass(points, 4 * p * sum(k for k, _ in moving), run)
        sent.unpersist()
        still = []
        for j, key in enumerate(moving):
            s = found[j].reshape(-1, 2 * p + 2)
            likelihood, model = float(s[0, -1]), models[key]
            collapsed = bool((model.var <= floor * 1.000001).any() or (model.weight * n < 1e-3).any())
            bic = 2 * likelihood - parameters(key[1], key[0], p) * math.log(n)
            model.bic = None if collapsed or not math.isfinite(bic) else bic
            settled = key in last and abs(likelihood - last[key]) <= tolerance * max(abs(likelihood), 1)
            last[key] = likelihood
            if not settled and i < iterations:
                scatter = s[:, 1 + p : -1] - s[:, 1 : 1 + p] ** 2 / np.maximum(s[:, :1], 1e-300)
                models[key] = _from_sums(key[1], s[:, 0], s[:, 1 : 1 + p], scatter, floor)
                still.append(key)
        moving = still
        if not moving:
            break
    return models


def _from_sums(form: str, n: np.ndarray, first: np.ndarray, scatter: np.ndarray, floor: float) -> Mixture:
    n = np.maximum(n, 1e-9)
    return Mixture(form, n / n.sum(), first / n[:, None], np.maximum(_variances(form, n, np.maximum(scatter, 0)), floor))


def _maximised(form: str, s: np.ndarray, p: int, floor: float) -> Mixture:
    """A first mixture from k-means sums: the clusters' scatter is dealt to the dimensions evenly."""
    n, first = s[:, 0], s[:, 1:-1]
    within = np.maximum(s[:, -1] - (first**2).sum(axis=1) / np.maximum(n, 1), 0)
    return _from_sums(form, n, first, np.repeat(within[:, None] / p, p, axis=1), floor)


def best_form(models: dict[tuple[int, str], Mixture], k: int) -> Mixture:
    """The mixture of k components whose form has the largest BIC; where all collapsed, that with the fewest parameters."""
    own = [m for (q, _), m in models.items() if q == k]
    return max(own, key=lambda m: (m.bic is not None, m.bic if m.bic is not None else -FORMS.index(m.form)))


def merge_order(sizes: np.ndarray, centres: np.ndarray, scatter: np.ndarray, method: str) -> list[tuple[float, int, int]]:
    """All merges of a hierarchy over groups (size, centre, mean scatter) by chains of nearest neighbours: (height, group, group) by height.

    Ward's cost or the mean squared distance of pairs (``average``): for both a merge is never nearer to others than its parts, so
    chains find the same merges as a search of all pairs, in quadratic time. Groups are told by the smallest number among their members.
    """
    n, c, s = sizes.astype(float).copy(), centres.astype(float).copy(), scatter.astype(float).copy()
    alive = np.ones(len(n), bool)
    merges, chain = [], []

    def distances(i: int) -> np.ndarray:
        d = ((c - c[i]) ** 2).sum(axis=1)
        d = d * n * n[i] / (n + n[i]) if method == "ward" else d + s + s[i]
        return np.where(alive, d, np.inf)

    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        d = distances(i)
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            chain = chain[:-2]
            a, b = min(i, j), max(i, j)
            merges.append((float(d[j]), a, b))
            total = n[a] + n[b]
            gap = float(((c[a] - c[b]) ** 2).sum())
            s[a] = (n[a] * s[a] + n[b] * s[b]) / total + n[a] * n[b] / total**2 * gap
            c[a] = (n[a] * c[a] + n[b] * c[b]) / total
            n[a], alive[b] = total, False
        else:
            chain.append(j)
    return sorted(merges)


def cut_merges(count: int, merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """The group (from 0, by smallest member) of each of ``count`` first groups when the lowest merges leave k."""
    owner = np.arange(count)

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for _, a, b in merges[: max(count - k, 0)]:
        x, y = sorted((root(a), root(b)))
        owner[y] = x
    roots = [root(i) for i in range(count)]
    place = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([place[r] for r in roots])
