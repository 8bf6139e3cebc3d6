"""Corrections: an edit table replayed on frames, the difference to the original, and the edit log."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import fixed, token_key

ACTIONS = ("halve", "double", "delete", "set", "pick", "smooth_mean", "smooth_median", "interpolate_linear", "interpolate_parabola", "interpolate_spline")


def smooth(data: DataFrame, *, token="token", time="time", f0="f0", width=3, kind="median", out="f0_smooth") -> DataFrame:
    """Adds the mean or median of the known values among the ``width`` frames around each frame, fewer at the ends."""
    half = width // 2
    w = Window.partitionBy(token).orderBy(time).rowsBetween(-half, half)
    if kind == "mean":
        return data.withColumn(out, F.avg(f0).over(w))
    s = F.sort_array(F.collect_list(f0).over(w))
    d = data.withColumn("__s", s).withColumn("__n", F.size("__s"))
    low, high = F.get("__s", F.floor((F.col("__n") - 1) / 2).cast("int")), F.get("__s", F.floor(F.col("__n") / 2).cast("int"))
    return d.withColumn(out, F.when(F.col("__n") > 0, (low + high) / 2)).drop("__s", "__n")


def scale_frames(data: DataFrame, edits: DataFrame, *, token="token", time="time", f0="f0") -> DataFrame:
    """Simple edits ([seq,] token, frame_indices, action, value): halve, double, delete or set the frames at the 1-based indices.

    Several edits of one frame follow one another by seq (else by action and value); an index listed twice in one edit
    counts once; a null value sets nothing. The number of frames stays.
    """
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    each = edits.select(F.col("token").alias("__token"), F.explode(F.array_distinct("frame_indices")).alias("__i"), F.struct(seq.alias("seq"), "action", F.col("value").cast("double").alias("value")).alias("e"))
    picks = each.groupBy("__token", "__i").agg(F.array_sort(F.collect_list("e")).alias("__edits"))
    d = data.withColumn("__rn", F.row_number().over(Window.partitionBy(token).orderBy(time)))
    j = d.join(picks, F.col(token).eqNullSafe(F.col("__token")) & (F.col("__rn") == F.col("__i")), "left")
    one = lambda v, e: F.when(e["action"] == "halve", v / 2).when(e["action"] == "double", v * 2).when(e["action"] == "delete", F.lit(None)).when((e["action"] == "set") & (e["value"] > 0), e["value"]).otherwise(v)
    new = F.when(F.col("__edits").isNull(), F.col(f0).cast("double")).otherwise(F.aggregate("__edits", F.col(f0).cast("double"), one))
    return j.withColumn(f0, new).select(*data.columns)


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic through the points whose end pieces continue the cubics of the outermost four points."""
    n = len(x)
    h, m = np.diff(x), np.zeros((n, n))
    rhs = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    for row, ends in ((0, slice(0, 4)), (n - 1, slice(n - 4, n))):
        p = np.polyfit(x[ends] - x[row], y[ends], 3)
        m[row, row], rhs[row] = 1, 2 * p[1]
    s = np.linalg.solve(m, rhs)
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * s[k] + (b**3 - b) * s[k + 1]) * h[k] ** 2 / 6


def interpolated(t: np.ndarray, f: np.ndarray, chosen: np.ndarray, action: str, anchors: int) -> np.ndarray:
    """New values of the chosen frames from the nearest ``anchors`` voiced frames not chosen (-1: from all of them); nothing where there are fewer than two.

    Linear is the line between two anchors, held at its ends, and a least-squares line through more.
    """
    free = ~chosen & np.isfinite(f) & (f > 0)
    need = {"interpolate_linear": 2, "interpolate_parabola": 3, "interpolate_spline": 4}[action]
    out = f.copy()
    for i in np.flatnonzero(chosen):
        near = np.flatnonzero(free)
        near = np.sort(near[np.argsort(np.abs(t[near] - t[i]), kind="stable")][: None if anchors == -1 else max(anchors, need)])
        if len(near) < 2:
            out[i] = np.nan
        elif action == "interpolate_spline" and len(near) >= 4:
            out[i] = _spline(t[near], f[near], t[i : i + 1])[0]
        elif action == "interpolate_parabola" and len(near) >= 3:
            out[i] = np.polyval(np.polyfit(t[near] - t[i], f[near], 2), 0)
        elif len(near) > 2:
            out[i] = np.polyval(np.polyfit(t[near] - t[i], f[near], 1), 0)
        else:
            out[i] = np.interp(t[i], t[near], f[near])
    return out


def edited(t: np.ndarray, f: np.ndarray, edits) -> np.ndarray:
    """One token's f0 after its edits (frame_indices, action, value), in order; NaN stands for missing.

    A missing value counts as 0: it sets nothing, picks the unvoiced candidate, and asks for the fewest neighbours.
    """
    f = f.copy()
    for indices, action, value in edits:
        value = 0.0 if value is None or np.isnan(value) else value
        at = np.array(indices, int) - 1
        at = at[(at >= 0) & (at < len(f))]
        chosen = np.zeros(len(f), bool)
        chosen[at] = True
        if action in ("halve", "double"):
            f[chosen] *= 0.5 if action == "halve" else 2
        elif action == "delete":
            f[chosen] = np.nan
        elif action == "set":
            f[chosen] = value if value > 0 else f[chosen]
        elif action == "pick":
            same = np.abs(f - value) <= 0.05
            f[chosen & ~same] = value if value > 0 else np.nan
        elif action.startswith("smooth"):
            half, before = int(value) // 2, f.copy()
            fold = np.nanmedian if action == "smooth_median" else np.nanmean
            for i in np.flatnonzero(chosen):
                part = before[max(0, i - half) : i + half + 1]
                f[i] = fold(part) if np.isfinite(part).any() else np.nan
        elif action.startswith("interpolate"):
            f = interpolated(t, f, chosen, action, int(value))
    return f


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _of_line(near: Column, at: Column, parabola: Column) -> Column:
    """Least-squares line (or parabola, where asked for and three anchors differ) through anchors (t, f), at one time; time is centred and scaled first."""

    def solved(m):
        n, s1, s2, s3, s4, y0, y1, y2 = (m[k] for k in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2"))
        line = F.coalesce(y0 / n + F.try_divide(n * y1 - s1 * y0, n * s2 - s1 * s1) * (m["x"] - s1 / n), y0 / n)
        d = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        a0 = y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)
        a1 = n * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - y1 * s2)
        a2 = n * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)
        curve = F.when(F.abs(d) > 1e-12 * n, (a0 + a1 * m["x"] + a2 * m["x"] * m["x"]) / d)
        return F.when(parabola, F.coalesce(curve, line)).otherwise(line)

    def scaled(c):
        def sums(scale):
            zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2")))

            def add(m, p):
                w = (p["t"] - c) / scale
                parts = {"n": F.lit(1.0), "s1": w, "s2": w * w, "s3": w * w * w, "s4": w * w * w * w, "y0": p["f"], "y1": w * p["f"], "y2": w * w * p["f"]}
                return F.struct(*((m[k] + v).alias(k) for k, v in parts.items()))

            return _let(F.aggregate(near, zero, add), lambda m: solved(_with(m, (at - c) / scale)))

        return _let(F.coalesce(F.nullif(F.array_max(F.transform(near, lambda p: F.abs(p["t"] - c))), F.lit(0.0)), F.lit(1.0)), sums)

    return _let(F.aggregate(near, F.lit(0.0), lambda x, p: x + p["t"]) / F.size(near), scaled)


def _with(m: Column, x: Column) -> Column:
    return m.withField("x", x)


def _interpolated(t: Column, f: Column, free: Column, i: Column, action: Column, value: Column) -> Column:
    """``interpolated`` for one frame as an expression: lines and parabolas."""
    at = F.get(t, i)
    need = F.when(action == "interpolate_parabola", 3).otherwise(2)
    count = F.when(value.cast("int") == -1, F.size(free)).otherwise(F.least(F.size(free), F.greatest(value.cast("int"), need)))
    ranked = F.array_sort(F.transform(free, lambda p: F.struct(F.abs(p["t"] - at).alias("d"), p["i"].alias("i"), p["t"].alias("t"), p["f"].alias("f"))))

    def use(near):
        def between(ends):
            a, b = ends["a"], ends["b"]
            inside = a["f"] + (at - a["t"]) / (b["t"] - a["t"]) * (b["f"] - a["f"])
            return F.when(at <= a["t"], a["f"]).when(at >= b["t"], b["f"]).otherwise(inside)

        points = F.transform(near, lambda p: F.struct(p["t"].alias("t"), p["f"].alias("f")))
        two = _let(F.struct(F.array_min(points).alias("a"), F.array_max(points).alias("b")), between)
        return F.when(F.size(near) > 2, _of_line(near, at, action == "interpolate_parabola")).when(F.size(near) == 2, two)

    return _let(F.slice(ranked, F.lit(1), count), use)


def _edit(t: Column, f: Column, e: Column) -> Column:
    """An array of f0 after one edit; null stands for missing. All actions but the spline."""
    action, value = e["action"], F.coalesce(F.nanvl(e["value"], F.lit(0.0)), F.lit(0.0))
    chosen = lambda i: F.coalesce(F.array_contains(e["frame_indices"], i + 1), F.lit(False))
    change = lambda make: F.transform(f, lambda v, i: F.when(chosen(i), make(v, i)).otherwise(v))
    picked = lambda v: F.when(F.abs(v - value) <= 0.05, v).when(value > 0, value)
    simple = lambda v, _: F.when(action == "halve", v * 0.5).when(action == "double", v * 2).when(action == "delete", F.lit(None)).when((action == "set") & (value > 0), value).when(action == "pick", picked(v)).otherwise(v)
    half = F.floor(value.cast("int") / 2).cast("int")

    def smoothed(v, i):
        def fold(part):
            mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)
            ordered = F.array_sort(part)
            n = F.size(part)
            median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
            return F.when(n > 0, F.when(action == "smooth_median", median).otherwise(mean))

        first = F.greatest(i - half, F.lit(0))
        return _let(F.filter(F.slice(f, first + 1, F.greatest(i + half + 1 - first, F.lit(0))), lambda x: x.isNotNull()), fold)

    free = F.filter(F.transform(f, lambda v, i: F.struct(F.get(t, i).alias("t"), v.alias("f"), i.alias("i"))), lambda p: (p["f"] > 0) & ~chosen(p["i"]))
    lines = _let(free, lambda anchors: change(lambda v, i: _interpolated(t, f, anchors, i, action, value)))
    return F.when(action.startswith("smooth"), change(smoothed)).when(action.startswith("interpolate"), lines).otherwise(change(simple))


def replay(data: DataFrame, edits: DataFrame, *, token="token", time="time", f0="f0") -> DataFrame:
    """Frames after all edits (seq, token, frame_indices, action, value), in the order of seq within a token.

    Later edits of a token see earlier results: they are folded over the token's array of frames, as an expression. Only tokens
    with a spline among their edits go through Python, as arrays, many in a batch. Tokens without edits pass by.
    """
    kinds = edits.groupBy(F.col("token").alias("__token")).agg(F.coalesce(F.bool_or(F.col("action") == "interpolate_spline"), F.lit(False)).alias("__spline"), F.sort_array(F.collect_list(F.struct("seq", "frame_indices", "action", F.col("value").cast("double").alias("value")))).alias("__edits"))
    on = F.col(token).eqNullSafe(F.col("__token"))
    rest, mine = data.join(kinds, on, "left_anti"), data.join(kinds, on, "left_semi")
    others = [c for c in data.columns if c not in (token, time, f0)]
    frames = mine.groupBy(token).agg(F.sort_array(F.collect_list(F.struct(time, F.nanvl(F.col(f0).cast("double"), F.lit(None)).alias(f0), *others))).alias("__frames"))
    of = lambda c, name: F.transform(c, lambda x: x[name])
    pairs = frames.join(kinds, on).withColumn("__t", F.transform("__frames", lambda x: x[time].cast("double"))).withColumn("__f", of("__frames", f0))
    folded = pairs.filter(~F.col("__spline")).withColumn("__new", F.aggregate("__edits", F.col("__f"), lambda f, e: _edit(F.col("__t"), f, e)))
    done = [folded]
    if not edits.filter(F.col("action") == "interpolate_spline").isEmpty():
        done.append(pairs.filter("__spline").withColumn("__new", F.pandas_udf(_run_edits, "array<double>")("__t", "__f", of("__edits", "frame_indices"), of("__edits", "action"), of("__edits", "value"))))
    back = [d.select(token, F.explode(F.arrays_zip("__frames", "__new")).alias("x")).select(*(F.col(token) if c == token else F.col("x.__new").alias(c) if c == f0 else F.col(f"x.__frames.{c}").alias(c) for c in data.columns)) for d in done]
    return reduce(DataFrame.unionByName, back, rest)


def _run_edits(t: pd.Series, f: pd.Series, indices: pd.Series, actions: pd.Series, values: pd.Series) -> pd.Series:
    out = []
    for row in zip(t, f, indices, actions, values):
        new = edited(np.asarray(row[0], float), np.asarray(row[1], float), zip(*row[2:]))
        out.append([None if np.isnan(v) else float(v) for v in new])
    return pd.Series(out)


def compare(original: DataFrame, corrected: DataFrame, dropped: DataFrame, *, token="token", time="time", f0="f0") -> DataFrame:
    """Original frames with f0_corrected, edited (changed by more than 1e-6, or known on one side only) and token_dropped.

    Frames meet by their place in the token: by time, then by the other columns that both tables have, so equal
    and missing times neither multiply nor lose frames.
    """
    others = [c for c in original.columns if c in corrected.columns and c not in (token, time, f0)]
    place = F.row_number().over(Window.partitionBy(token).orderBy(time, *others))
    c = corrected.select(F.col(token).alias("__token"), place.alias("__j"), F.col(f0).alias("f0_corrected"))
    original, columns = original.withColumn("__i", place), original.columns
    d = dropped.select(F.col("token").alias("__dropped")).distinct()
    j = original.join(c, F.col(token).eqNullSafe(F.col("__token")) & (F.col("__i") == F.col("__j")), "left").join(d, F.col(token).eqNullSafe(F.col("__dropped")), "left")
    a, b = F.col(f0), F.col("f0_corrected")
    edited = F.coalesce(F.abs(a - b) > 1e-6, a.isNull() != b.isNull())
    return j.select(*columns, "f0_corrected", edited.alias("edited"), F.col("__dropped").isNotNull().alias("token_dropped"))


def fresh_edits(saved: DataFrame, current: DataFrame, *, token="token", time="time", tolerance=1e-8) -> DataFrame:
    """Tokens whose saved frames still agree with the current ones in number and times."""
    number = lambda d: d.select(F.col(token).alias("token"), F.row_number().over(Window.partitionBy(token).orderBy(time)).alias("i"), F.col(time).alias("t"))
    a, b = number(saved).alias("a"), number(current).alias("b")
    j = a.join(b, F.col("a.token").eqNullSafe(F.col("b.token")) & (F.col("a.i") == F.col("b.i")), "full")
    same = F.coalesce(F.abs(F.col("a.t") - F.col("b.t")) <= tolerance, F.lit(False))
    return j.groupBy(F.coalesce("a.token", "b.token").alias("token")).agg(F.bool_and(same).alias("same")).filter("same").select("token")


def log_rows(edits: DataFrame, data: DataFrame, *, token="token", time="time", date: str | None = None) -> DataFrame:
    """Edit log: seq, date (``date``, else today's), token, action, n_frames, frame_indices, frame_times_s and frame_pct as comma lists."""
    w = Window.partitionBy(token)
    d = data.withColumn("__i", F.row_number().over(w.orderBy(time))).withColumn("__n", F.count("*").over(w))
    picks = edits.select(F.col("token").alias("__token"), "seq", "action", F.explode("frame_indices").alias("__k"))
    j = picks.join(d, F.col(token).eqNullSafe(F.col("__token")) & (F.col("__i") == F.col("__k")))
    pct = F.try_divide(100.0 * (F.col("__i") - 1), F.col("__n") - 1)
    parts = F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), fixed(F.col(time), 3).alias("t"), fixed(pct, 1).alias("p"))))
    g = j.groupBy("seq", "__token", "action").agg(parts.alias("x"))
    text = lambda f: F.array_join(F.transform("x", lambda v: v[f].cast("string")), ", ")
    day = F.current_date().cast("string") if date is None else F.lit(date)
    return g.select("seq", day.alias("date"), F.col("__token").alias("token"), "action", F.size("x").alias("n_frames"), text("i").alias("frame_indices"), text("t").alias("frame_times_s"), text("p").alias("frame_pct"))


def bulk_discards(flagged: DataFrame, present: DataFrame, already: DataFrame, *, token="token") -> DataFrame:
    """Flagged tokens that are present and not discarded yet, matched by key."""
    key = lambda d: d.select(token_key(token).alias("k")).distinct()
    return present.select(token).distinct().withColumn("k", token_key(token)).join(key(flagged), "k", "left_semi").join(key(already), "k", "left_anti").select(token)


DISCARD = "Discard token"


def reconcile_log(log: DataFrame, appended: DataFrame, dropped: DataFrame, *, token="token") -> DataFrame:
    """The log with new rows, and one discard row for just the tokens that are discarded now.

    The log's own discard row wins over an appended one; of several rows of a token the first by its columns stays.
    """
    both = log.withColumn("__new", F.lit(0)).unionByName(appended.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    discards = F.col("action").eqNullSafe(DISCARD)
    columns = [c for c in both.columns if c != "__new"]
    now = both.filter(discards).join(dropped.select(token).distinct(), token, "left_semi")
    kept = now.groupBy(token).agg(F.min(F.struct("__new", *columns)).alias("one")).select("one.*").select(*columns)
    return both.filter(~discards).select(*columns).unionByName(kept)


def pick_candidates(data: DataFrame, candidates: DataFrame, picks: DataFrame, *, token="token", frame="frame", f0="f0") -> DataFrame:
    """Frames with the picked pitch candidate: candidates (token, frame, candidates: array of frequency and strength), picks (token, frame, choice from 1).

    0 Hz makes the frame unvoiced (null); a candidate within 0.05 Hz of the frame's value changes nothing, a choice that
    does not exist neither. Of several picks of a frame the last by choice counts.
    """
    c = candidates.groupBy(F.col("token").alias("__token"), F.col("frame").alias("__frame")).agg(F.max("candidates").alias("__c"))
    p = picks.groupBy(F.col("token").alias("__t"), F.col("frame").alias("__f")).agg(F.max("choice").alias("__choice"))
    chosen = c.join(p, F.col("__token").eqNullSafe(F.col("__t")) & (F.col("__frame") == F.col("__f"))).select("__token", "__frame", F.get("__c", F.col("__choice") - 1)["frequency"].alias("__hz"))
    j = data.join(chosen, F.col(token).eqNullSafe(F.col("__token")) & (F.col(frame) == F.col("__frame")), "left")
    value = F.col(f0).cast("double")
    new = F.when(F.col("__hz").isNull() | F.coalesce(F.abs(F.col("__hz") - value) <= 0.05, F.lit(False)), value).when(F.col("__hz") > 0, F.col("__hz"))
    return j.withColumn(f0, new).select(*data.columns)


def without_restored(log: DataFrame, restored: DataFrame, *, token="token") -> DataFrame:
    """The log without discard rows of restored tokens."""
    r = restored.select(F.col(token).alias("__token")).distinct()
    return log.join(r, (F.col(token) == F.col("__token")) & (F.col("action") == DISCARD), "left_anti")
