"""Mixed models of curves: fixed and penalised curves of tones, random curves of speakers or items, variances by REML.

The model of a sample is a product of its basis (functions of time, and of a covariate if there is one) with coefficients. It
goes through sums per cell (tone, outer level, inner level), made by one Spark aggregation. The factor
with most unknowns is the outer one: each of its levels is a block of its own, which is eliminated where it lies (its Schur
complement in the rest is summed over Spark, levels of one shape side by side), so nothing as large as the number of its levels is ever
put in a matrix or sent to the driver. What is left, the core (curves of tones, covariate, the other factor), is solved on the driver and holds ``MAX_CORE`` unknowns at most.

Each round has two passes over the blocks: one sums the Schur complements, the other the posterior moments (mean and full covariance) of the
random coefficients, given the core's solution. Variances are updated from those moments by the fixed point of Harville and Schall (squares over
effective degrees of freedom; for covariance matrices its symmetric form), which has the solution of expectation-maximisation in fewer rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most unknowns of the core, which the driver solves densely.
MAX_CORE = 3000
#: Rows of the core's matrix that are summed by one group.
ROWS = 64


@dataclass
class Part:
    """Random curves of a factor: ``basis`` makes each of its functions of the sample basis (functions x sample basis).

    ``copies`` tells for each tone which copy of the coefficients it uses (-1: none); copies share their variances.
    Without ``penalties`` the functions have a full covariance matrix, else a variance for every penalty (a matrix and its rank; they don't overlap).
    """

    name: str
    basis: np.ndarray
    copies: list[int]
    penalties: list[tuple[np.ndarray, int]] = field(default_factory=list)
    covariance: np.ndarray | None = None
    variances: np.ndarray | None = None

    def start(self, value: float) -> None:
        r = len(self.basis)
        self.covariance, self.variances = np.eye(r) * value, np.full(len(self.penalties), value)

    def precision(self) -> np.ndarray:
        if not self.penalties:
            return np.linalg.inv(self.covariance)
        return sum(p / s for (p, _), s in zip(self.penalties, self.variances))

    def update(self, products: np.ndarray, spread: np.ndarray, count: float, least: float) -> float:
        """New variances from the sums of products of posterior means and of posterior covariances; the largest change of the logarithm of a variance that matters."""
        if not count:
            return 0.0
        if self.penalties:
            moves = [fixed_point(np.sum(p * products), np.sum(p * spread), count * rank, s, least) for (p, rank), s in zip(self.penalties, self.variances)]
            self.variances = np.array([v for v, _ in moves])
            return max(change for _, change in moves)
        lower = np.linalg.cholesky(self.covariance)
        turned = lambda m: np.linalg.solve(lower, np.linalg.solve(lower, m).T)
        free, axes = np.linalg.eigh(count * np.eye(len(self.basis)) - turned(spread))  # effective degrees of freedom, in the prior's own scale
        root = axes / np.sqrt(np.maximum(free, 1e-8 * count)) @ axes.T
        step = root @ turned(products) @ root
        self.covariance = lower @ step @ lower.T + least * np.eye(len(self.basis))
        self.covariance = (self.covariance + self.covariance.T) / 2
        return float(np.abs(step - np.eye(len(step)))[np.ix_(*[np.diag(step) > 0] * 2)].max()) if free.sum() > MATTERS * count * len(free) else 0.0


#: Variances with a smaller share of their degrees of freedom in use are as good as none; they need not settle.
MATTERS = 0.01


def fixed_point(square: float, spread: float, rank: float, variance: float, least: float) -> tuple[float, float]:
    """The next variance of ``rank`` coefficients with a sum of squares and a trace of posterior covariance: squares over effective degrees of freedom; and the change of its logarithm, 0 where it doesn't matter."""
    free = rank - spread / variance
    new = float(np.clip(square / max(free, 1e-8 * rank), least, variance * 1e4))
    return new, abs(float(np.log(new / variance))) if free > MATTERS * rank else 0.0


@dataclass
class Smoothed:
    """A penalised curve in the core: where its coefficients begin, the penalty, its rank and the variance."""

    name: str
    start: int
    penalty: np.ndarray
    rank: int
    variance: float = 1.0


@dataclass
class Design:
    """What the core holds: for each tone the places of its curves, the covariate's place, and the inner factor's part and first place."""

    fixed: np.ndarray
    places: list[list[int]]
    extra: np.ndarray | None
    extra_at: int
    inner: Part | None
    inner_at: int
    width: int


@dataclass
class Fit:
    """Solution and covariance of the core, variances, and what makes the outer factor's curves."""

    core: np.ndarray
    covariance: np.ndarray
    noise: float
    outer: list[Part]
    inner: Part | None
    smooths: list[Smoothed]
    blocks: DataFrame | None
    outer_name: str
    design: Design
    tones: list
    levels: list
    rounds: int

    def random_curves(self) -> DataFrame | None:
        """Outer level, tone and the coefficients (on the sample basis) of the level's own curve; computed where the blocks lie."""
        if self.blocks is None:
            return None
        tones, parts, noise, core = [str(t) for t in self.tones], self.outer, self.noise, self.core

        def run(batches):
            for levels, block in _blocks(batches):
                u, at = _posterior(block, parts, noise)[1](core), _places(block, parts)
                curves = np.zeros((len(levels), len(tones), parts[0].basis.shape[1]))
                for t in range(len(tones)):
                    for p, part in enumerate(parts):
                        if (c := part.copies[t]) >= 0 and (p, c) in at:
                            curves[:, t] += u[:, at[p, c]] @ part.basis
                keys, names = np.repeat(levels, len(tones)), tones * len(levels)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), _lists(curves.reshape(len(keys), -1))], names=["level", "tone", "curve"])

        return self.blocks.mapInArrow(run, "level string, tone string, curve array<double>")


def packed_sums(data: DataFrame, basis: list[Column], y: Column, keys: dict[str, Column]) -> DataFrame:
    """Per cell the upper triangle of the basis' products (``g``), its products with y (``b``), the count and the sum of squares."""
    k = len(basis)
    named = data.select(*(c.alias(n) for n, c in keys.items()), y.alias("__y"), *(c.alias(f"__x{i}") for i, c in enumerate(basis)))
    x = [F.col(f"__x{i}") for i in range(k)]
    rows = named.filter(F.col("__y").isNotNull())
    g = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    b = [F.sum(x[i] * F.col("__y")).alias(f"b{i}") for i in range(k)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("yy"), *g, *b)
    return sums.select(*keys, "n", "yy", F.array(*(f"g{i}_{j}" for i in range(k) for j in range(i, k))).alias("g"), F.array(*(f"b{i}" for i in range(k))).alias("b"))


def unpacked(g: np.ndarray, k: int) -> np.ndarray:
    """Full matrices from upper triangles (last axis)."""
    out = np.zeros((*g.shape[:-1], k, k))
    i, j = np.triu_indices(k)
    out[..., i, j] = g
    out[..., j, i] = g
    return out


def _core_design(design: Design, tone: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the core that a cell has a share in, and its design (places x sample basis)."""
    k = len(design.fixed)
    at = [np.arange(p, p + k) for p in design.places[tone]]
    rows = [design.fixed] * len(at)
    if design.extra is not None:
        at.append(np.arange(design.extra_at, design.extra_at + len(design.extra)))
        rows.append(design.extra)
    if design.inner is not None:
        r = len(design.inner.basis)
        at.append(design.inner_at + inner * r + np.arange(r))
        rows.append(design.inner.basis)
    return np.concatenate(at), np.concatenate(rows)


BLOCK = pa.schema([("level", pa.string()), ("kinds", pa.list_(pa.int64())), ("own", pa.list_(pa.float64())), ("at", pa.list_(pa.int64())), ("cross", pa.list_(pa.float64())), ("b", pa.list_(pa.float64()))])
BLOCK_FIELDS = "level string, kinds array<bigint>, own array<double>, at array<bigint>, cross array<double>, b array<double>"


def _assemble(tones, inner, grams, sides, parts: list[Part], design: Design):
    """A level's own matrix, its products with the core's places it touches, and its right side, from its cells."""
    kinds = sorted({(p, part.copies[t]) for t in set(tones) for p, part in enumerate(parts) if part.copies[t] >= 0})
    start, width = {}, 0
    for p, c in kinds:
        start[p, c] = width
        width += len(parts[p].basis)
    core = [_core_design(design, t, i) for t, i in zip(tones, inner)]
    touched = np.unique(np.concatenate([at for at, _ in core]))
    own, cross, b = np.zeros((width, width)), np.zeros((width, len(touched))), np.zeros(width)
    for t, gram, rhs, (at, rows) in zip(tones, grams, sides, core):
        used = [(start[p, part.copies[t]], part.basis) for p, part in enumerate(parts) if part.copies[t] >= 0]
        z = np.concatenate([basis for _, basis in used])
        i = np.concatenate([s + np.arange(len(basis)) for s, basis in used])
        zg = z @ gram
        own[np.ix_(i, i)] += zg @ z.T
        cross[np.ix_(i, np.searchsorted(touched, at))] += zg @ rows.T
        b[i] += z @ rhs
    return [p * KIND + c for p, c in kinds], own.ravel(), touched, cross.ravel(), b


#: A part and a copy in one number.
KIND = 1_000_000


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as lists."""
    offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)) if rows.size else pa.array([0] * (len(rows) + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of a column of lists."""
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])


def _blocks(batches):
    """Levels of one shape (same curves, same places in the core) side by side: their names and stacked matrices."""
    for batch in batches:
        levels = batch.column(0).to_pylist()
        values = {n: _ragged(batch.column(i)) for i, n in enumerate(BLOCK.names) if i}
        shapes: dict[tuple[bytes, bytes], list[int]] = {}
        cut = lambda n, i: values[n][0][values[n][1][i] : values[n][1][i + 1]]
        for i in range(len(levels)):
            shapes.setdefault((cut("kinds", i).tobytes(), cut("at", i).tobytes()), []).append(i)
        for rows in shapes.values():
            for some in (rows[j : j + 2000] for j in range(0, len(rows), 2000)):
                b = np.stack([cut("b", i) for i in some])
                own = np.stack([cut("own", i) for i in some]).reshape(len(some), b.shape[1], b.shape[1])
                cross = np.stack([cut("cross", i) for i in some]).reshape(len(some), b.shape[1], -1)
                yield [levels[i] for i in some], {"kinds": cut("kinds", some[0]), "at": cut("at", some[0]), "own": own, "cross": cross, "b": b}


def _places(block: dict, parts: list[Part]) -> dict[tuple[int, int], slice]:
    out, width = {}, 0
    for code in block["kinds"].tolist():
        p, c = divmod(code, KIND)
        out[p, c] = slice(width, width + len(parts[p].basis))
        width = out[p, c].stop
    return out


def _posterior(block: dict, parts: list[Part], noise: float):
    """Covariances of the blocks given the core, their means as a function of the core, and their products with it."""
    own, cross = block["own"] / noise, block["cross"] / noise
    for (p, _), at in _places(block, parts).items():
        own[:, at, at] += parts[p].precision()
    covariance = np.linalg.inv(own)
    return covariance, lambda core: np.einsum("nij,nj->ni", covariance, block["b"] / noise - cross @ core[block["at"]]), cross


def summed(rows: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """Sum of the arrays of each key, by one exchange (none where the rows lie in one part, which has summed them); a key's arrays have one length."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = value.values.to_numpy()
                sums[key] = sums[key] + v if key in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["key", "v"])

    found = (rows if parts == 1 else rows.repartition("key").mapInArrow(run, "key bigint, v array<double>")).toArrow()
    return {k: v.values.to_numpy() for k, v in zip(found["key"].to_pylist(), found["v"])}


def _schur(blocks: DataFrame, tasks: int, parts: list[Part], noise: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the blocks take from the core's matrix and right side."""

    def run(batches):
        taken = np.zeros((width, width + 1))
        for _, block in _blocks(batches):
            covariance, _, cross = _posterior(block, parts, noise)
            half = np.swapaxes(cross, 1, 2) @ covariance
            at = block["at"]
            taken[np.ix_(at, at)] += np.einsum("nij,njk->ik", half, cross, optimize=True)
            taken[at, -1] += np.einsum("nij,nj->i", half, block["b"]) / noise
        keys = [i for i in range(0, width, ROWS) if taken[i : i + ROWS].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([taken[i : i + ROWS].ravel().tolist() for i in keys], pa.list_(pa.float64()))], names=["key", "v"])

    out = np.zeros((width, width + 1))
    for i, v in summed(blocks.coalesce(tasks).mapInArrow(run, "key bigint, v array<double>"), tasks).items():
        out[i : i + ROWS] = v.reshape(-1, width + 1)
    return out[:, :-1], out[:, -1]


def _moments(blocks: DataFrame, tasks: int, parts: list[Part], noise: float, core: np.ndarray, covariance: np.ndarray):
    """For each part the sums of products of means and of covariances and the number of curves; and the means' sum of products with the right sides."""
    sent = blocks.sparkSession.sparkContext.broadcast((core, covariance))
    sizes = [len(p.basis) for p in parts]

    def run(batches):
        c, spread_of = sent.value
        sums = [[np.zeros((r, r)), np.zeros((r, r)), 0.0] for r in sizes]
        dot = 0.0
        for _, block in _blocks(batches):
            own, mean, cross = _posterior(block, parts, noise)
            u, half = mean(c), own @ cross
            spread = own.sum(axis=0) + np.einsum("nij,jk,nlk->il", half, spread_of[np.ix_(block["at"], block["at"])], half, optimize=True)
            dot += np.sum(u * block["b"])
            for (p, _), at in _places(block, parts).items():
                sums[p][0] += u[:, at].T @ u[:, at]
                sums[p][1] += spread[at, at]
                sums[p][2] += len(u)
        flat = np.concatenate([np.concatenate([a.ravel(), b.ravel(), [n]]) for a, b, n in sums] + [[dot]])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["key", "v"])

    flat = summed(blocks.coalesce(tasks).mapInArrow(run, "key bigint, v array<double>"), tasks)[0]
    sent.unpersist()
    out, i = [], 0
    for r in sizes:
        out.append((flat[i : i + r * r].reshape(r, r), flat[i + r * r : i + 2 * r * r].reshape(r, r), flat[i + 2 * r * r]))
        i += 2 * r * r + 1
    return out, flat[-1]


def fit(cells: DataFrame, *, tones: list, fixed: np.ndarray, places: list[list[int]], core_width: int, smooths: list[Smoothed], outer: list[Part], inner: Part | None, extra: np.ndarray | None = None, rounds: int = 60, tolerance: float = 1e-3) -> Fit:
    """Fit from cells (tone, outer, inner, n, yy, g, b): tone and the factors as text, null only where a factor isn't used.

    ``core_width`` counts the places of tones and covariate; the inner factor's come behind. ``extra`` makes the covariate's functions of the sample basis; they stand at the end of those places.
    """
    spark = cells.sparkSession
    number = {str(t): i for i, t in enumerate(tones)}
    width = core_width
    inner_levels: list[str] = []
    if inner is not None:
        found = cells.select("inner").distinct().limit((MAX_CORE - width) // len(inner.basis) + 1).toArrow()["inner"].to_pylist()
        width += len(found) * len(inner.basis)
        inner_levels = sorted(found)
    if width > MAX_CORE:
        raise ValueError(f"{width} unknowns at least besides the largest factor; the driver solves at most {MAX_CORE}")
    design = Design(fixed, places, extra, core_width - (0 if extra is None else len(extra)), inner, core_width, width)
    size = fixed.shape[1]
    tone_of = spark.createDataFrame([(t, i) for t, i in number.items()], "tone string, tone_at int")
    inner_of = spark.createDataFrame([(x, i) for i, x in enumerate(inner_levels)], "inner string, inner_at int")
    cells = cells.join(F.broadcast(tone_of), "tone")
    cells = cells.join(F.broadcast(inner_of), "inner") if inner is not None else cells.withColumn("inner_at", F.lit(0))
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    k = len(fixed[0])
    triangle = k * (k + 1) // 2
    merged = cells.groupBy("tone_at", "inner_at").agg(F.sum("n").alias("n"), F.sum("yy").alias("yy"), *(F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(triangle)), *(F.sum(F.get("b", F.lit(i))).alias(f"b{i}") for i in range(k)))
    rows = merged.toArrow().to_pandas()  # at most tones x inner levels, so bounded like the core
    a, rhs, n, yy = np.zeros((width, width)), np.zeros(width), float(rows["n"].sum()), float(rows["yy"].sum())
    if not n:
        raise ValueError("no samples to fit")
    grams, sides = unpacked(rows[[f"g{i}" for i in range(triangle)]].to_numpy(float), size), rows[[f"b{i}" for i in range(k)]].to_numpy(float)
    for t, i, g, b in zip(rows["tone_at"].tolist(), rows["inner_at"].tolist(), grams, sides):
        at, x = _core_design(design, t, i)
        a[np.ix_(at, at)] += x @ g @ x.T
        rhs[at] += x @ b
    own = slice(0, core_width)
    noise = max((yy - rhs[own] @ np.linalg.lstsq(a[own, own], rhs[own], rcond=None)[0]) / n, 1e-12 * max(yy / n, 1e-12))
    least = 1e-9 * noise
    for part in [*outer, *([inner] if inner else [])]:
        part.start(noise / 10)
    for s in smooths:
        s.variance = noise
    blocks = _block_table(cells, outer, design, size).persist(StorageLevel.MEMORY_AND_DISK) if outer else None
    tasks = _tasks(cells, outer, width) if outer else 1
    ridge = 1e-10 * max(np.trace(a) / max(width, 1), 1e-12) if outer or inner is not None or smooths else 0.0
    done = 0
    try:
        for done in range(1, rounds + 1):
            core, covariance = _solve(a, rhs, noise, blocks, tasks, outer, inner, smooths, design, inner_levels, ridge)
            moments, dot = _moments(blocks, tasks, outer, noise, core, covariance) if blocks is not None else ([], 0.0)
            if not outer and inner is None and not smooths:
                noise = max((yy - core @ rhs) / max(n - width, 1), 1e-300)
                break
            # effective degrees of freedom, and the penalties' share of the residual sum of squares
            unknowns, held, load = float(width), 0.0, 0.0
            for part, (products, spread, count) in zip(outer, moments):
                q = part.precision()
                unknowns += count * len(part.basis)
                held += np.sum(q * spread)
                load += np.sum(q * products)
            change = 0.0
            for s in smooths:
                at = slice(s.start, s.start + len(s.penalty))
                square, spread = core[at] @ s.penalty @ core[at], np.sum(s.penalty * covariance[at, at])
                held, load = held + spread / s.variance, load + square / s.variance
                s.variance, moved = fixed_point(square, spread, s.rank, s.variance, least)
                change = max(change, moved)
            if inner is not None:
                r = len(inner.basis)
                u = core[core_width:].reshape(-1, r)
                products, spread = u.T @ u, sum(covariance[i : i + r, i : i + r] for i in range(core_width, width, r))
                q = inner.precision()
                held, load = held + np.sum(q * spread), load + np.sum(q * products)
                change = max(change, inner.update(products, spread, len(inner_levels), least))
            for part, (products, spread, count) in zip(outer, moments):
                change = max(change, part.update(products, spread, count, least))
            new = max((yy - core @ rhs - dot - noise * load) / max(n - unknowns + held, 1.0), least)
            change, noise = max(change, abs(np.log(new / noise))), new
            if change < tolerance:
                break
        if outer or inner is not None or smooths:
            core, covariance = _solve(a, rhs, noise, blocks, tasks, outer, inner, smooths, design, inner_levels, ridge)
        else:
            covariance = np.linalg.pinv(a) * noise
    finally:
        if blocks is not None:
            blocks.unpersist()
        cells.unpersist()
    return Fit(core, covariance, float(noise), outer, inner, smooths, blocks, "outer", design, list(tones), inner_levels, done)


def _solve(a, rhs, noise, blocks, tasks, outer, inner, smooths, design, inner_levels, ridge):
    """Mean and covariance of the core with the blocks eliminated."""
    m, right = a / noise + ridge / noise * np.eye(design.width), rhs / noise
    for s in smooths:
        at = slice(s.start, s.start + len(s.penalty))
        m[at, at] += s.penalty / s.variance
    if inner is not None:
        q, r = inner.precision(), len(inner.basis)
        for i in range(len(inner_levels)):
            at = slice(design.inner_at + i * r, design.inner_at + (i + 1) * r)
            m[at, at] += q
    if blocks is not None:
        taken, side = _schur(blocks, tasks, outer, noise, design.width)
        m, right = m - taken, right - side
    m = (m + m.T) / 2
    covariance = np.linalg.pinv(m, hermitian=True) if not outer and inner is None and not smooths else np.linalg.inv(m)
    return covariance @ right, covariance


#: A task of a pass over the blocks has at least so many products to work out; every level counts for LEVEL_WORK more.
TASK_WORK, LEVEL_WORK = 500_000_000, 20_000


def _tasks(cells: DataFrame, outer: list[Part], width: int) -> int:
    """How many tasks a pass over the blocks is worth."""
    levels = cells.agg(F.approx_count_distinct("outer")).first()[0]
    r = sum(len(p.basis) * len({c for c in p.copies if c >= 0}) for p in outer)
    return max(1, math.ceil(levels * (r**3 + r * width**2 + LEVEL_WORK) / TASK_WORK))


def _block_table(cells: DataFrame, outer: list[Part], design: Design, size: int) -> DataFrame:
    """One row a level of the outer factor. A level has at most tones x inner levels cells, which the core's size bounds."""
    cell = F.struct(F.col("tone_at").alias("tone"), F.col("inner_at").alias("inner"), "g", "b")
    grouped = cells.groupBy("outer").agg(F.collect_list(cell).alias("cells"))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in BLOCK]
            cells = batch.column(1)
            ends, flat = np.concatenate([[0], np.cumsum(pc.list_value_length(cells).to_numpy())]), cells.flatten()
            tones, inner, g, b = flat.flatten()
            tones, inner = tones.to_numpy().tolist(), inner.to_numpy().tolist()
            grams, sides = unpacked(g.flatten().to_numpy().reshape(len(tones), -1), size), b.flatten().to_numpy().reshape(len(tones), -1)
            for level, i, j in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                for column, v in zip(out, (level, *_assemble(tones[i:j], inner[i:j], grams[i:j], sides[i:j], outer, design))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, BLOCK)], schema=BLOCK)

    return grouped.mapInArrow(run, BLOCK_FIELDS)
