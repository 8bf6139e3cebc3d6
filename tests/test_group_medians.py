"""Exact medians of groups from counts of values, also where one group has nearly all rows."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from contourlake.operators import inspect as I
from contourlake.operators.medians import group_medians


def test_medians_equal_a_sorted_list(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.uniform(-3, 3), rng.gauss(80, 4), float(rng.randrange(4)), 1e300, -1e300])) for k in ("a", "b", "c", None) for _ in range({"a": 400, "b": 51}.get(k, 2))]
    rows += [("one", 2.5), ("ties", 7.0), ("ties", 7.0), ("ties", 7.0), ("nothing", None), ("far", None), ("far", None), ("far", 2e15), ("far", 5e15)]
    counts = spark.createDataFrame(rows, "k string, v double").groupBy(F.struct("k").alias("g"), "v").agg(F.count("*").alias("n"))
    rows_of = {k: sum(k == x for x, _ in rows) for k, _ in rows}
    made = group_medians(counts, "g", "v", "n", sums={"rows": F.col("n")}).select("g.k", "median", "rows").collect()
    found = {r["k"]: r["median"] for r in made}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert found == {"nothing": None, **{k: statistics.median(v) for k, v in want.items()}}
    assert {r["k"]: r["rows"] for r in made} == rows_of


def test_a_value_may_stand_on_several_rows(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 1), ("a", 1.0, 1), ("a", 9.0, 4)], "k string, v double, n long")
    assert group_medians(rows, "k", "v", "n").first()["median"] == statistics.median([1, 1, 1, 3, 9, 9, 9, 9])


def test_empty_table(spark):
    assert group_medians(spark.createDataFrame([], "k string, v double, n long"), "k", "v", "n").collect() == []


def test_level_flags_with_nearly_all_tokens_on_one_speaker(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        speaker, tone = ("hot", 1) if i % 10 else (rng.choice(["s1", "s2", None]), rng.choice([1, 2, None]))
        level = None if i % 97 == 3 else rng.choice([80.0, rng.gauss(80, 3), rng.gauss(80, 30)])
        rows.append((f"t{i}", speaker, tone, level))
    tokens = spark.createDataFrame(rows, "token string, speaker string, tone int, level_st double").repartition(8)
    found = {r["token"]: r for r in I.flag_level_outliers(tokens).collect()}
    groups = {}
    for _, s, t, level in rows:
        groups.setdefault((s, t), []).append(level)
    assert len(found) == len(rows)
    for token, s, t, level in rows:
        known = [x for x in groups[s, t] if x is not None]
        mid = statistics.median(known)
        dev = [abs(x - mid) for x in known]
        mad, mean = statistics.median(dev), statistics.fmean(dev)
        want = None
        if len(groups[s, t]) >= 5 and level is not None:
            want = 0.6745 * (level - mid) / mad if mad > 0 else (level - mid) / (1.253314 * mean) if mean > 0 else None
        got = found[token]
        assert got["n_tone_peers"] == len(groups[s, t])
        assert (got["level_modz"] is None) == (want is None)
        assert want is None or abs(got["level_modz"] - want) < 1e-9
        assert got["flag_level_high"] == (want is not None and want > 3.5) and got["flag_level_low"] == (want is not None and want < -3.5)
