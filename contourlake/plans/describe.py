"""Queries: normalisation, time, contours, resampling, numerals, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from contourlake.functions import scalars as X
from contourlake.operators import chao as C
from contourlake.operators import contours as K
from contourlake.operators import normalise as N
from contourlake.operators import resample as RS
from contourlake.operators import summaries as S
from contourlake.plans.inspection import ATTACHED, _attached
from contourlake.plans.registry import query
from contourlake.plans.sql import ORDER_FRAMES
from contourlake.sources.adapters import event_frames, order_frames, table

SPEAKERS = """by_tone AS (SELECT speaker, tone, avg(f0) AS m FROM frames GROUP BY 1, 2),
weighted AS (SELECT speaker, avg(m) AS wm FROM by_tone GROUP BY 1),
spk AS (SELECT f.speaker, avg(f0) AS sm, any_value(wm) AS wm, stddev_samp(f0) AS sd FROM frames f JOIN weighted w ON w.speaker IS NOT DISTINCT FROM f.speaker GROUP BY f.speaker)"""


@query("a3_speaker_mean", SPEAKERS + " SELECT speaker, sm AS simple_mean, wm AS weighted_mean, sd AS speaker_sd FROM spk", "simple_mean weighted_mean speaker_sd")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    a = N.speaker_statistics(f).select("speaker", F.col("speaker_mean").alias("simple_mean"), "speaker_sd")
    b = N.speaker_statistics(f, mean_method="weighted").select("speaker", F.col("speaker_mean").alias("weighted_mean"))
    return a.join(b, "speaker").select("speaker", "simple_mean", "weighted_mean", "speaker_sd")


@query("j1_x6_normalise_semitone", SPEAKERS + """ SELECT token, time, wm AS speaker_mean, CASE WHEN f0 / wm > 0 THEN 12 * log2(f0 / wm) END AS f0_norm FROM frames f LEFT JOIN spk ON spk.speaker IS NOT DISTINCT FROM f.speaker""", "time speaker_mean f0_norm")
def _(spark, sf_dir):
    return N.normalise_f0(event_frames(spark, sf_dir), mean_method="weighted").select("token", "time", "speaker_mean", "f0_norm")


@query("w7_normalise_zscore", SPEAKERS + " SELECT token, time, (f0 - sm) / nullif(sd, 0) AS f0_norm FROM frames f LEFT JOIN spk ON spk.speaker IS NOT DISTINCT FROM f.speaker", "time f0_norm")
def _(spark, sf_dir):
    return N.normalise_f0(event_frames(spark, sf_dir), method="zscore").select("token", "time", "f0_norm")


TIME01 = "t01 AS (SELECT *, CASE WHEN time IS NULL THEN NULL WHEN max(time) OVER w = min(time) OVER w THEN 0.5::DOUBLE ELSE (time - min(time) OVER w) / (max(time) OVER w - min(time) OVER w) END AS time01 FROM frames WINDOW w AS (PARTITION BY token))"


@query("a17_time_already_normalised", """s AS (SELECT token, min(time) AS lo, max(time) AS hi FROM frames GROUP BY token) SELECT coalesce(min(lo) >= -1e-8 AND max(hi) <= 1 + 1e-8 AND min(lo) <= 0.05 AND max(hi) >= 0.95 AND median(hi - lo) >= 0.9, false) AS normalised FROM s""")
def _(spark, sf_dir):
    return N.time_is_normalised(event_frames(spark, sf_dir))


@query("c1_resolve_time", TIME01 + " SELECT token, time, time01 FROM t01", "time time01")
def _(spark, sf_dir):
    return N.resolve_time(event_frames(spark, sf_dir)).select("token", "time", "time01")


@query("c1_resolve_time_again", TIME01 + " SELECT token, time01 AS t01, least(1.0, greatest(0.0, time01)) AS again FROM t01 WHERE time IS NOT NULL", "t01 again")
def _(spark, sf_dir):
    t = N.resolve_time(event_frames(spark, sf_dir), out="t01").filter("t01 is not null").select("token", "t01")
    return N.resolve_time(t, time="t01", out="again").select("token", "t01", "again")


@query("c2_token_time", "SELECT token, time, CASE WHEN max(time) OVER w > min(time) OVER w THEN (time - min(time) OVER w) / (max(time) OVER w - min(time) OVER w) END AS token_t01 FROM frames WINDOW w AS (PARTITION BY token)", "time token_t01")
def _(spark, sf_dir):
    return N.normalise_time_token(event_frames(spark, sf_dir)).select("token", "time", "token_t01")


@query("c3_segment_time", ATTACHED + """, g AS (SELECT *, CASE WHEN rime_1_start IS NOT NULL AND rime_1_end > rime_1_start THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (time - rime_1_start) / (rime_1_end - rime_1_start))) END AS rime_1_t01 FROM att)
SELECT token, time, rime_1_i, rime_1_t01, rime_1_i - 1 + rime_1_t01 AS rime_1_tseq FROM g""", "time rime_1_t01 rime_1_tseq")
def _(spark, sf_dir):
    return N.normalise_time_segment(_attached(spark, sf_dir), segment="rime_1").select("token", "time", "rime_1_i", "rime_1_t01", "rime_1_tseq")


MEANS = TIME01 + """, normed AS (SELECT t01.*, CASE WHEN f0 / wm > 0 THEN 12 * log2(f0 / wm) END AS f0_norm FROM t01 LEFT JOIN spk ON spk.speaker IS NOT DISTINCT FROM t01.speaker),
contours AS (SELECT tone, round_even(time01 * 49, 0) / 49 AS time, avg(f0_norm) AS f0_predicted FROM normed GROUP BY 1, 2)"""


def _contours(spark, sf_dir):
    return K.mean_contour(N.normalise_f0(event_frames(spark, sf_dir), mean_method="weighted"), f0="f0_norm")


@query("f2_mean_contour", SPEAKERS + ", " + MEANS + " SELECT * FROM contours", "time f0_predicted")
def _(spark, sf_dir):
    """Flagship: weighted semitone normalisation, 0-1 time, mean contour of every tone."""
    return _contours(spark, sf_dir).orderBy("tone", "time")


@query("a4_mean_contour_hz", TIME01 + " SELECT tone, round_even(time01 * 19, 0) / 19 AS time, avg(f0) AS f0_predicted FROM t01 GROUP BY 1, 2", "time f0_predicted", base=ORDER_FRAMES)
def _(spark, sf_dir):
    return K.mean_contour(order_frames(spark, sf_dir), n_bins=20)


def _solve_sql(degree: int) -> str:
    """Coefficients by elimination on the normal equations, written for DuckDB."""
    k = degree + 1
    basis = ["1.0::DOUBLE", "x", "(3 * x * x - 1) / 2", "(5 * x * x * x - 3 * x) / 2"][:k]
    p = ", ".join(f"{b} AS p{i}" for i, b in enumerate(basis))
    sums = ", ".join([f"sum(p{i} * p{j}) AS m{i}_{j}_0" for i in range(k) for j in range(i, k)] + [f"sum(p{i} * f0) AS m{i}_{k}_0" for i in range(k)])
    parts = [TIME01, f"pts AS (SELECT *, {p} FROM (SELECT *, 2 * time01 - 1 AS x FROM t01) WHERE f0 IS NOT NULL)", f"meta AS (SELECT token, min_by(speaker, time) AS speaker, min_by(tone, time) AS tone, min(time) AS lo, max(time) AS hi FROM t01 GROUP BY token)", f"e0 AS (SELECT token, count(*) AS n, avg(f0) AS mean, {sums} FROM pts GROUP BY token)"]
    # forward elimination step by step
    for s in range(degree):
        cols = []
        for i in range(k):
            for j in range(i, k + 1):
                a = f"m{i}_{j}_{s}"
                if i > s:
                    a = f"{a} - m{s}_{i}_{s} * m{s}_{j}_{s} / nullif(m{s}_{s}_{s}, 0)"
                cols.append(f"{a} AS m{i}_{j}_{s + 1}")
        parts.append(f"e{s + 1} AS (SELECT token, n, mean, {', '.join(cols)} FROM e{s})")
    last, prev = degree, f"e{degree}"
    for i in reversed(range(k)):
        rest = "".join(f" - m{i}_{j}_{last} * c{j}" for j in range(i + 1, k))
        parts.append(f"b{i} AS (SELECT *, (m{i}_{k}_{last}{rest}) / nullif(m{i}_{i}_{last}, 0) AS c{i} FROM {prev})")
        prev = f"b{i}"
    out = ", ".join(f"CASE WHEN hi = lo THEN {'mean' if i == 0 else 'NULL'} WHEN coalesce(n, 0) < {k} THEN NULL ELSE c{i} END AS c{i}" for i in range(k))
    return ",\n".join(parts) + f"\nSELECT meta.token, speaker, tone, {out} FROM meta LEFT JOIN b0 ON b0.token IS NOT DISTINCT FROM meta.token"


for _degree in (1, 2, 3):

    @query(f"c5_fit_polynomial_{_degree}", _solve_sql(_degree), " ".join(f"c{i}" for i in range(_degree + 1)))
    def _(spark, sf_dir, degree=_degree):
        rows = K.fit_polynomial(event_frames(spark, sf_dir), degree=degree)
        return rows


@query("a11_coefficient_table", "coef AS (WITH " + _solve_sql(2).replace("\nSELECT meta", "\nSELECT meta", 1) + ") SELECT tone, count(c0) AS n_fitted, count(*) FILTER (c0 IS NULL) AS n_skipped, avg(c0) AS mean_c0, avg(c1) AS mean_c1, avg(c2) AS mean_c2 FROM coef GROUP BY tone", "mean_c0 mean_c1 mean_c2")
def _(spark, sf_dir):
    return K.coefficient_table(K.fit_polynomial(event_frames(spark, sf_dir)))


ROBUST = """known AS (SELECT * FROM frames WHERE f0 > 0), tt AS (SELECT tone, token, max(f0) AS peak, min(f0) AS valley FROM known GROUP BY 1, 2), tm AS (SELECT tone, avg(f0) AS m FROM known GROUP BY 1),
ends AS (SELECT (SELECT tone FROM tm ORDER BY m DESC, tone LIMIT 1) AS highest_tone, (SELECT tone FROM tm ORDER BY m, tone LIMIT 1) AS lowest_tone),
rob AS (SELECT highest_tone, lowest_tone, avg(peak) FILTER (tone = highest_tone) AS mu_max, stddev_samp(peak) FILTER (tone = highest_tone) AS sigma_max, avg(valley) FILTER (tone = lowest_tone) AS mu_min, stddev_samp(valley) FILTER (tone = lowest_tone) AS sigma_min FROM tt, ends GROUP BY 1, 2),
rng AS (SELECT *, mu_max + sigma_max AS upper, CASE WHEN mu_min - sigma_min < 1 THEN 1.0::DOUBLE ELSE mu_min - sigma_min END AS lower FROM rob)"""


@query("a12_robust_range", ROBUST + " SELECT * FROM rng", "mu_max sigma_max mu_min sigma_min upper lower")
def _(spark, sf_dir):
    return C.robust_range(event_frames(spark, sf_dir))


@query("k2_highest_lowest_tone", ROBUST + " SELECT * FROM ends")
def _(spark, sf_dir):
    return C.robust_range(event_frames(spark, sf_dir)).select("highest_tone", "lowest_tone")


HZ = TIME01 + ", contours AS (SELECT tone, round_even(time01 * 49, 0) / 49 AS time, avg(f0) AS f FROM t01 GROUP BY 1, 2), " + ROBUST
SCALED = HZ + """, sc AS (
  SELECT tone, time, f, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) * 4 + 1 AS chao_ref, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) * 5 AS chao_int,
    CASE WHEN f IS NULL OR lower IS NULL THEN NULL WHEN f = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(5.0::DOUBLE, (ln(f) - ln(lower)) / (ln(upper) - ln(lower)) * 5)) END AS chao_rob FROM contours, rng
)"""


@query("x7_scaled_contours", SCALED + " SELECT * FROM sc", "time f chao_ref chao_int chao_rob")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return C.scaled_contours(K.mean_contour(f), f)


# Values at the ends and on the fine grid, by joining each grid point to the contour points around it.
NUMERALS = SCALED + """, pts AS (SELECT *, lead(time) OVER w AS t2, lead(chao_ref) OVER w AS r2, lead(chao_int) OVER w AS i2, lead(chao_rob) OVER w AS b2 FROM sc WHERE time IS NOT NULL AND f IS NOT NULL WINDOW w AS (PARTITION BY tone ORDER BY time)),
grid AS (SELECT tone, k, k / 199.0::DOUBLE AS x FROM (SELECT DISTINCT tone FROM pts), (SELECT unnest(range(0, 200)) AS k)),
val AS (
  SELECT g.tone, g.k, g.x, p.chao_ref + coalesce((g.x - p.time) / (p.t2 - p.time) * (p.r2 - p.chao_ref), 0) AS r, p.chao_int + coalesce((g.x - p.time) / (p.t2 - p.time) * (p.i2 - p.chao_int), 0) AS i,
    p.chao_rob + coalesce((g.x - p.time) / (p.t2 - p.time) * (p.b2 - p.chao_rob), 0) AS b, row_number() OVER (PARTITION BY g.tone, g.k ORDER BY p.time DESC) AS rn
  FROM grid g JOIN pts p ON p.tone = g.tone AND p.time <= g.x
), v AS (SELECT * FROM val WHERE rn = 1),
e AS (
  SELECT tone, max(r) FILTER (k = 0) AS r0, max(r) FILTER (k = 199) AS r1, min(r) FILTER (k BETWEEN 19 AND 179) AS lo, max(r) FILTER (k BETWEEN 19 AND 179) AS hi,
    arg_min(k, r) FILTER (k BETWEEN 19 AND 179) AS klo, arg_max(k, r) FILTER (k BETWEEN 19 AND 179) AS khi FROM v GROUP BY tone
), m AS (SELECT *, CASE WHEN r0 - lo > 0.5 AND r1 - lo > 0.5 THEN klo WHEN hi - r0 > 0.5 AND hi - r1 > 0.5 THEN khi END AS mid FROM e),
d AS (
  SELECT v.tone, v.x, v.k, greatest(1, least(5, round_even(v.r, 0)::INT)) AS dr, greatest(1, least(5, ceil(v.i)::INT)) AS di, greatest(1, least(5, ceil(v.b)::INT)) AS db, v.r
  FROM v JOIN m ON m.tone = v.tone AND (v.k = 0 OR v.k = 199 OR v.k = m.mid)
), num AS (SELECT tone, count(*)::INTEGER AS n_digits, string_agg(dr, '' ORDER BY k) AS refline, string_agg(di, '' ORDER BY k) AS interval, string_agg(db, '' ORDER BY k) AS robust FROM d GROUP BY tone)"""
SHAPE = """CASE WHEN length(refline) < 2 THEN 'level' WHEN refline = repeat(refline[1], length(refline)) THEN CASE refline[1] WHEN '1' THEN 'low level' WHEN '2' THEN 'mid-low level' WHEN '3' THEN 'mid level' WHEN '4' THEN 'mid-high level' WHEN '5' THEN 'high level' ELSE 'level' END
  WHEN length(refline) >= 3 AND list_min(string_split(refline[2:-2], '')) < least(refline[1], refline[-1]) THEN 'dipping'
  WHEN length(refline) >= 3 AND list_max(string_split(refline[2:-2], '')) > greatest(refline[1], refline[-1]) THEN 'peaking' WHEN refline[-1] > refline[1] THEN 'rising' ELSE 'falling' END"""


def _numerals(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return C.contour_to_chao(K.mean_contour(f), f)


@query("c6_contour_to_chao", NUMERALS + f" SELECT tone, n_digits, refline, interval, robust, {SHAPE} AS shape FROM num")
def _(spark, sf_dir):
    return _numerals(spark, sf_dir).select("tone", "n_digits", "refline", "interval", "robust", "shape")


@query("c7_publish_wide", NUMERALS + """, s AS (SELECT tone, list(x ORDER BY k) AS t, list(r ORDER BY k) AS v FROM d GROUP BY tone) SELECT tone, t[1] AS t1, t[2] AS t2, t[3] AS t3, v[1] AS v1, v[2] AS v2, v[3] AS v3 FROM s""", "t1 t2 t3 v1 v2 v3")
def _(spark, sf_dir):
    return C.publish_wide(_numerals(spark, sf_dir)).select("tone", "t1", "t2", "t3", "v1", "v2", "v3")


@query("x8_digits", """SELECT c_custkey, greatest(1, least(5, round_even(c_acctbal / 1000, 0)::INT))::VARCHAR AS ref_digit, greatest(1, least(5, ceil(c_acctbal / 1000)::INT))::VARCHAR AS int_digit FROM customer""", base=None)
def _(spark, sf_dir):
    x = F.col("c_acctbal") / 1000
    return table(spark, sf_dir, "customer").select("c_custkey", C.chao_digit(x, F.rint).alias("ref_digit"), C.chao_digit(x, F.ceil).alias("int_digit"))


@query("x4_classify_contour", f"SELECT c_custkey, refline, {SHAPE} AS shape FROM (SELECT c_custkey, concat(1 + c_custkey % 5, CASE WHEN c_custkey % 3 > 0 THEN (1 + c_custkey // 5 % 5)::VARCHAR ELSE '' END, CASE WHEN c_custkey % 3 > 1 THEN (1 + c_custkey // 25 % 5)::VARCHAR ELSE '' END) AS refline FROM customer)", base=None)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    digit = lambda n: (1 + F.floor(k / n) % 5).cast("string")
    digits = F.concat(digit(1), F.when(k % 3 > 0, digit(5)).otherwise(""), F.when(k % 3 > 1, digit(25)).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", digits.alias("refline"), X.classify_contour(digits).alias("shape"))


@query("x1_token_key", r"SELECT DISTINCT lower(trim(regexp_replace(concat(' ', event_type, '.', user_id % 100, CASE WHEN user_id % 2 = 0 THEN '.WAV ' ELSE '.tg' END), '([^.]+)\.[A-Za-z0-9]+$', '\1'))) AS key FROM events", base=None)
def _(spark, sf_dir):
    u = F.col("user_id")
    name = F.concat(F.lit(" "), "event_type", F.lit("."), (u % 100).cast("string"), F.when(u % 2 == 0, ".WAV ").otherwise(".tg"))
    return table(spark, sf_dir, "events").select(X.token_key(name).alias("key")).distinct()


@query("x3_vowel_labels", """SELECT doc_id, label, regexp_matches(label, '^[aeiouyjwà-æè-ïò-öø-ýÿ]+$', 'i') AND regexp_matches(label, '[aeiouyà-æè-ïò-öø-ýÿ]', 'i') AS vowel
FROM (SELECT doc_id, lower(regexp_extract(text, '[A-Za-zÀ-ÿ]+', 0)) AS label FROM documents) WHERE label <> ''""", base=None)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_extract("text", "[A-Za-zÀ-ÿ]+", 0)).alias("label")).filter("label <> ''")
    return d.withColumn("vowel", X.is_vowel_label("label"))


@query("x10_legendre_basis", """SELECT l_orderkey, l_linenumber, x, (3 * x * x - 1) / 2 AS p2, (5 * x * x * x - 3 * x) / 2 AS p3, (35 * x * x * x * x - 30 * x * x + 3) / 8 AS p4 FROM (SELECT l_orderkey, l_linenumber, 20 * l_discount - 1 AS x FROM lineitem)""", "x p2 p3 p4", base=None)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("x", 20 * F.col("l_discount") - 1)
    p = X.legendre(F.col("x"), 4)
    return li.select("l_orderkey", "l_linenumber", "x", p[2].alias("p2"), p[3].alias("p3"), p[4].alias("p4"))


@query("x9_scaled_text", """SELECT tone, concat(printf('%.2f', a), ' → ', printf('%.2f', b)) AS text, abs(a - 1.5) <= 0.1 OR abs(a - 2.5) <= 0.1 OR abs(a - 3.5) <= 0.1 OR abs(a - 4.5) <= 0.1 OR abs(b - 1.5) <= 0.1 OR abs(b - 2.5) <= 0.1 OR abs(b - 3.5) <= 0.1 OR abs(b - 4.5) <= 0.1 AS near
FROM (SELECT tone, count(*) % 400 / 100.0::DOUBLE + 1 AS a, count(f0) % 400 / 100.0::DOUBLE + 1 AS b FROM frames GROUP BY tone)""")
def _(spark, sf_dir):
    g = event_frames(spark, sf_dir).groupBy("tone").agg((F.count("*") % 400 / 100.0 + 1).alias("a"), (F.count("f0") % 400 / 100.0 + 1).alias("b"))
    pair = F.array("a", "b")
    return g.select("tone", X.scaled_text(pair).alias("text"), X.near_boundary(pair).alias("near"))


RESAMPLED = """r0 AS (SELECT token, time AS t, CASE WHEN f0 > 0 THEN f0 END AS f, intensity AS i, row_number() OVER w AS k, count(*) OVER (PARTITION BY token) AS m, min(time) OVER (PARTITION BY token) AS t0, max(time) OVER (PARTITION BY token) AS t9, speaker, tone, item, f0 AS raw
  FROM frames WINDOW w AS (PARTITION BY token ORDER BY time)),
r1 AS (SELECT *, lead(t) OVER w AS t2, lead(f) OVER w AS f2, lead(i) OVER w AS i2 FROM r0 WINDOW w AS (PARTITION BY token ORDER BY k)),
tok AS (SELECT token, any_value(t0) AS t0, any_value(t9) AS t9, any_value(m) AS m, any_value(speaker) AS speaker, any_value(tone) AS tone, any_value(item) AS item FROM r0 GROUP BY token),
pt AS (SELECT *, CASE WHEN p = 20 THEN t9 ELSE t0 + p * ((t9 - t0) / 20) END AS x FROM tok, (SELECT unnest(range(0, 21)) AS p) WHERE m > 1)"""
BLEND = """CASE WHEN ph < 0.5 THEN CASE WHEN f IS NULL THEN NULL WHEN f2 IS NULL THEN f ELSE f + ph * (f2 - f) END ELSE CASE WHEN f2 IS NULL THEN NULL WHEN f IS NULL THEN f2 ELSE f2 + (1 - ph) * (f - f2) END END"""
ONE = "SELECT token, 1 AS point, t AS time, 0.5::DOUBLE AS time_prop, raw AS f0, i AS intensity, speaker, tone, item FROM r0 WHERE m = 1"


@query("c4_resample_uneven", RESAMPLED + """, b AS (
  SELECT pt.token, pt.p, pt.x, pt.speaker, pt.tone, pt.item, f, f2, i, i2, (pt.x - t) / (t2 - t) AS ph, row_number() OVER (PARTITION BY pt.token, pt.p ORDER BY k DESC) AS rn FROM pt JOIN r1 ON r1.token = pt.token AND r1.t <= pt.x AND r1.k < r1.m
) SELECT token, (p + 1)::INTEGER AS point, x AS time, p / 20.0::DOUBLE AS time_prop, """ + BLEND + " AS f0, i + ph * (i2 - i) AS intensity, speaker, tone, item FROM b WHERE rn = 1 UNION ALL " + ONE, "time time_prop f0 intensity")
def _(spark, sf_dir):
    return RS.resample_equal(event_frames(spark, sf_dir))


@query("c4_resample_even", RESAMPLED + """, ix AS (SELECT *, (x - t0) / ((t9 - t0) / (m - 1)) AS idx FROM pt),
b AS (SELECT ix.token, p, x, ix.speaker, ix.tone, ix.item, a.f, c.f AS f2, idx - floor(idx) AS ph FROM ix LEFT JOIN r0 a ON a.token = ix.token AND a.k = floor(idx)::BIGINT + 1 LEFT JOIN r0 c ON c.token = ix.token AND c.k = floor(idx)::BIGINT + 2)
SELECT token, (p + 1)::INTEGER AS point, x AS time, """ + BLEND + " AS f0, speaker, tone, item FROM b UNION ALL SELECT token, 1, t, raw, speaker, tone, item FROM r0 WHERE m = 1", "time f0", base=ORDER_FRAMES)
def _(spark, sf_dir):
    return RS.resample_equal(order_frames(spark, sf_dir).drop("intensity")).drop("time_prop")


@query("u5_diagnostics_long", "SELECT tone, 'n' AS metric, count(*)::DOUBLE AS value FROM frames GROUP BY tone UNION ALL SELECT tone, 'mean', avg(f0) FROM frames GROUP BY tone", "value")
def _(spark, sf_dir):
    g = event_frames(spark, sf_dir).groupBy("tone").agg(F.count("*").cast("double").alias("n"), F.avg("f0").alias("mean"))
    return S.unpivot(g, "tone", ["n", "mean"])
