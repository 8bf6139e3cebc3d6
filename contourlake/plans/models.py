"""Queries: contour features, clusters, growth curves, smooths and residual checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.functions.scalars import ERF_SMALL, ERFC_LARGE, ERFC_MIDDLE, INVERSE_ROOT_PI
from contourlake.operators import cluster as C
from contourlake.operators import mixed as X
from contourlake.operators import models as M
from contourlake.operators import normalise as N
from contourlake.plans.describe import TIME01
from contourlake.plans.registry import query
from contourlake.sources.adapters import event_frames, table

CONTOURS = """a0 AS (SELECT token, time AS t, avg(f0) AS f FROM frames WHERE f0 IS NOT NULL GROUP BY 1, 2),
a1 AS (SELECT *, lead(t) OVER w AS t2, lead(f) OVER w AS f2, row_number() OVER w AS k, count(*) OVER (PARTITION BY token) AS m, min(t) OVER (PARTITION BY token) AS t0, max(t) OVER (PARTITION BY token) AS t9 FROM a0 WINDOW w AS (PARTITION BY token ORDER BY t)),
pp AS (SELECT token, p, CASE WHEN p = 19 THEN t9 ELSE t0 + p * ((t9 - t0) / 19) END AS x FROM (SELECT DISTINCT token, t0, t9 FROM a1 WHERE m >= 2), (SELECT unnest(range(0, 20)) AS p)),
pv AS (SELECT pp.token, p, f + (x - t) / (t2 - t) * (f2 - f) AS v, row_number() OVER (PARTITION BY pp.token, p ORDER BY k DESC) AS rn FROM pp JOIN a1 ON a1.token = pp.token AND t <= x AND k < m),
con AS (SELECT token, p + 1 AS position, v FROM pv WHERE rn = 1)"""


N_POINTS = 20


def _contours(spark, sf_dir, register="level"):
    return C.token_contours(event_frames(spark, sf_dir), register=register, n_points=N_POINTS)


def _long(df, column):
    return df.select("token", F.posexplode(column).alias("position", "v")).select("token", (F.col("position") + 1).cast("long").alias("position"), "v")


@query("c8_contours_level", CONTOURS + " SELECT token, position, v FROM con", "v")
def _(spark, sf_dir):
    return _long(_contours(spark, sf_dir), "contour")


@query("c8_contours_shape", CONTOURS + " SELECT token, position, v - avg(v) OVER (PARTITION BY token) AS v FROM con", "v")
def _(spark, sf_dir):
    return _long(_contours(spark, sf_dir, "shape"), "contour")


@query("w10_derivative", CONTOURS + ", d AS (SELECT token, position, lead(v) OVER (PARTITION BY token ORDER BY position) - v AS v FROM con) SELECT * FROM d WHERE v IS NOT NULL", "v")
def _(spark, sf_dir):
    return _long(C.features(_contours(spark, sf_dir), "derivative"), "features")


@query("x11_cosine_features", CONTOURS + """, raw AS (SELECT token, k, sum(v * cos(pi() / 20 * (position - 1 + 0.5) * k)) AS v FROM con, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2)
SELECT token, k + 1 AS position, v / coalesce(nullif(stddev_samp(v) OVER (PARTITION BY k), 0), 1) AS v FROM raw""", "v")
def _(spark, sf_dir):
    return _long(C.features(_contours(spark, sf_dir), "dct", n_points=N_POINTS), "features")


def _legendre_weights(points: int, degree: int) -> str:
    """VALUES of (k, position, w): what a point at a position adds to the least-squares coefficient of degree k."""
    basis = np.polynomial.legendre.legvander(np.linspace(-1, 1, points), degree)
    rows = np.linalg.solve(basis.T @ basis, basis.T)
    return ", ".join(f"({k}, {j + 1}, {w!r}::DOUBLE)" for k, row in enumerate(rows.tolist()) for j, w in enumerate(row))


@query("c8_legendre_features", CONTOURS + f""", weight(k, position, w) AS (VALUES {_legendre_weights(20, 4)}), raw AS (SELECT token, k, sum(v * w) AS v FROM con JOIN weight USING (position) GROUP BY 1, 2)
SELECT token, k + 1 AS position, v / coalesce(nullif(stddev_samp(v) OVER (PARTITION BY k), 0), 1) AS v FROM raw""", "v")
def _(spark, sf_dir):
    """Legendre coefficients of the contours; compared with numpy's least squares in the tests."""
    return _long(C.features(_contours(spark, sf_dir), "legendre", n_points=N_POINTS), "features")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").cast("string").alias("token"), (F.col("label") % 3 + 1).alias("cluster"), F.col("label").cast("string").alias("tone"), v.alias("contour"), v.alias("features"))


ASSIGNED = "e AS (SELECT vec_id, label % 3 + 1 AS cluster, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS position FROM embeddings)"


@query("a13_contingency", "SELECT label % 3 + 1 AS cluster, label::VARCHAR AS label, count(*) AS count FROM embeddings GROUP BY 1, 2", base=None)
def _(spark, sf_dir):
    return C.contingency(_vectors(spark, sf_dir))


@query("a13_adjusted_rand", """WITH t AS (SELECT label % 3 AS c, label AS l, count(*) AS n FROM embeddings GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ij, sum(n)::DOUBLE AS n FROM t),
a AS (SELECT sum(s * (s - 1) / 2.0::DOUBLE) AS a FROM (SELECT sum(n)::DOUBLE AS s FROM t GROUP BY c)), b AS (SELECT sum(s * (s - 1) / 2.0::DOUBLE) AS b FROM (SELECT sum(n)::DOUBLE AS s FROM t GROUP BY l))
SELECT (ij - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) AS ari FROM ij, a, b""", "ari", base=None)
def _(spark, sf_dir):
    return C.adjusted_rand(C.contingency(_vectors(spark, sf_dir)))


@query("a14_cluster_means", f"WITH {ASSIGNED} SELECT cluster, position::INTEGER AS position, avg(v) AS value, count(*) AS size FROM e GROUP BY 1, 2", "value", base=None)
def _(spark, sf_dir):
    return C.cluster_means(_vectors(spark, sf_dir))


@query("a14_relabel_by_height", f"WITH {ASSIGNED}, m AS (SELECT cluster, position, avg(v) AS value FROM e GROUP BY 1, 2), h AS (SELECT cluster, row_number() OVER (ORDER BY avg(value), cluster)::INTEGER AS place FROM m GROUP BY cluster) SELECT vec_id::VARCHAR AS token, place AS cluster FROM embeddings JOIN h ON h.cluster = label % 3 + 1", base=None)
def _(spark, sf_dir):
    return C.relabel_by_height(_vectors(spark, sf_dir)).select("token", "cluster")


@query("c12_playback_contours", f"WITH {ASSIGNED} SELECT cluster, position::INTEGER AS position, 200 * pow(2.0::DOUBLE, avg(v) / 12) AS value, count(*) AS size FROM e GROUP BY 1, 2", "value", base=None)
def _(spark, sf_dir):
    return C.playback_contours(_vectors(spark, sf_dir), base=200.0)


@query("m11_partition_cost", "WITH s AS (SELECT count(*)::DOUBLE AS n FROM embeddings GROUP BY label % 3) SELECT sum(n) * ln(sum(n)) - sum(n * ln(n)) AS partition FROM s", "partition", base=None)
def _(spark, sf_dir):
    return C.partition_cost(_vectors(spark, sf_dir))


@query("m10_within_cost", f"WITH {ASSIGNED}, m AS (SELECT cluster, position, avg(v) AS m FROM e GROUP BY 1, 2) SELECT sum((v - m) * (v - m)) AS wss FROM e JOIN m USING (cluster, position)", "wss", base=None)
def _(spark, sf_dir):
    return C.within_cost(_vectors(spark, sf_dir))


@query("m10_silhouette", """WITH v AS (SELECT vec_id, label % 3 AS c, embedding FROM embeddings), d AS (SELECT a.vec_id, a.c, b.c AS c2, sum(CASE WHEN a.vec_id <> b.vec_id THEN list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2 ELSE 0 END) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
o AS (SELECT vec_id, max(s / (n - 1)) FILTER (c = c2) AS own, min(s / n) FILTER (c <> c2) AS other FROM d GROUP BY vec_id) SELECT avg((other - own) / greatest(own, other)) AS silhouette FROM o""", "silhouette", base=None)
def _(spark, sf_dir):
    return C.silhouette(_vectors(spark, sf_dir))


@query("m10_silhouette_euclidean", """WITH v AS (SELECT vec_id, label % 3 AS c, embedding FROM embeddings), d AS (SELECT a.vec_id, a.c, b.c AS c2, sum(CASE WHEN a.vec_id <> b.vec_id THEN list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ELSE 0 END) AS s, count(*) AS n FROM v a, v b WHERE a.vec_id % 50 = 0 GROUP BY 1, 2, 3),
o AS (SELECT vec_id, max(s / (n - 1)) FILTER (c = c2) AS own, min(s / n) FILTER (c <> c2) AS other FROM d GROUP BY vec_id), e AS (SELECT (other - own) / greatest(own, other) AS s FROM o) SELECT avg(s) AS silhouette, count(*) AS n_points, stddev_samp(s) / sqrt(count(*)) AS std_error FROM e""", "silhouette std_error", base=None)
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return C.silhouette_euclidean(v, v.filter(F.col("token").cast("long") % 50 == 0))


def _ratio_sql(x: str, parts) -> str:
    out = []
    for coefficients in parts:
        value = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            value = f"({value} * {x} + {c!r}::DOUBLE)"
        out.append(value)
    return f"({out[0]}) / ({out[1]})"


#: Complementary error function of a column x by the same approximations.
ERFC_SQL = f"""CASE WHEN abs(x) <= 0.46875 THEN 1 - x * {_ratio_sql("(x * x)", ERF_SMALL)} ELSE (CASE WHEN x >= 0 THEN 0 ELSE 2 END) + sign(x) *
  (CASE WHEN abs(x) <= 4 THEN exp(-x * x) * {_ratio_sql("abs(x)", ERFC_MIDDLE)} ELSE exp(-x * x) / abs(x) * ({INVERSE_ROOT_PI}::DOUBLE - (1 / (x * x)) * {_ratio_sql("(1 / (x * x))", ERFC_LARGE)}) END) END"""
LENGTHS = f"""{ASSIGNED}, st AS (SELECT cluster, position, avg(v) AS m, stddev_samp(v) AS s FROM e GROUP BY 1, 2), gl AS (SELECT position, avg(v) AS m, stddev_samp(v) AS s FROM e GROUP BY 1),
u AS (SELECT 'residual' AS part, v, st.m, st.s FROM e JOIN st USING (cluster, position) UNION ALL SELECT 'model', st.m, gl.m, gl.s FROM st JOIN gl USING (position)),
z AS (SELECT part, unnest([1, 2]) AS side, row_number() OVER () AS i, m, CASE WHEN s > 0 THEN s ELSE 0.05 END AS s, floor(v / 0.05) * 0.05 AS low FROM u),
q AS (SELECT part, i, side, (m - (CASE WHEN side = 1 THEN low + 0.05 ELSE low END)) / (s * 1.4142135623730951::DOUBLE) AS x FROM z),
c AS (SELECT part, i, max(t) FILTER (side = 1) - max(t) FILTER (side = 2) AS p FROM (SELECT part, i, side, 0.5 * ({ERFC_SQL}) AS t FROM q) GROUP BY 1, 2),
n AS (SELECT part, sum(-ln(CASE WHEN p > 0 THEN p ELSE 2.2250738585072014e-308::DOUBLE END)) AS nats FROM c GROUP BY 1),
b AS (SELECT sum(n) * ln(sum(n)) - sum(n * ln(n)) AS partition FROM (SELECT count(*)::DOUBLE AS n FROM embeddings GROUP BY label % 3))"""


@query("m11_description_length", f"WITH {LENGTHS} SELECT max(nats) FILTER (part = 'model') AS model, any_value(partition) AS partition, max(nats) FILTER (part = 'residual') AS residual, sum(nats) / 2 + any_value(partition) AS mdl FROM n, b", "model partition residual mdl", base=None)
def _(spark, sf_dir):
    return C.description_length(_vectors(spark, sf_dir), eps=0.05, bending=2.0)


SUGGESTED = """n AS (SELECT *, lead(k) OVER (ORDER BY k) IS NULL OR coalesce(gap >= lead(gap - coalesce(gap_se, 0)) OVER (ORDER BY k), FALSE) AS first FROM d),
s AS (SELECT (SELECT k FROM d ORDER BY silhouette DESC, k LIMIT 1) AS k_silhouette, (SELECT k FROM d ORDER BY mdl, k LIMIT 1) AS k_mdl,
  coalesce((SELECT min(k) FROM n WHERE first AND gap IS NOT NULL), (SELECT k FROM d WHERE gap IS NOT NULL ORDER BY gap DESC, k LIMIT 1)) AS k_gap, (SELECT k FROM d WHERE bic IS NOT NULL ORDER BY bic DESC, k LIMIT 1) AS k_gmm)
SELECT *, coalesce(k_gmm, k_silhouette, k_gap, 3) AS k_auto FROM s"""
DIAGNOSED = "SELECT l_linenumber AS k, avg(l_discount) AS silhouette, avg(l_quantity) AS mdl, avg(l_tax) AS gap, stddev_samp(l_tax) / sqrt(count(*)) AS gap_se"


def _diagnosed(spark, sf_dir):
    """A table of diagnostics by k, made of the order lines' means."""
    error = F.stddev_samp("l_tax") / F.sqrt(F.count("*"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_discount").alias("silhouette"), F.avg("l_quantity").alias("mdl"), F.avg("l_tax").alias("gap"), error.alias("gap_se"), F.avg("l_extendedprice").alias("bic"))


@query("m13_suggested_k", f"WITH d AS ({DIAGNOSED}, CASE WHEN l_linenumber < 6 THEN avg(l_extendedprice) END AS bic FROM lineitem GROUP BY l_linenumber), {SUGGESTED}", base=None)
def _(spark, sf_dir):
    """All five suggestions, some mixtures without a BIC."""
    return C.suggestions(_diagnosed(spark, sf_dir).withColumn("bic", F.when(F.col("k") < 6, F.col("bic"))))


@query("m13_suggested_k_by_gap", f"WITH d AS ({DIAGNOSED}, NULL::DOUBLE AS bic FROM lineitem GROUP BY l_linenumber), {SUGGESTED}", base=None)
def _(spark, sf_dir):
    """No mixture at all."""
    return C.suggestions(_diagnosed(spark, sf_dir).withColumn("bic", F.lit(None).cast("double"))).withColumn("k_gmm", F.col("k_gmm").cast("int"))


@query("m7_kmeans")
def _(spark, sf_dir):
    return C.relabel_by_height(C.kmeans(C.features(_contours(spark, sf_dir, "shape")), 3)).select("token", "cluster")


@query("m8_gaussian_mixture")
def _(spark, sf_dir):
    return C.gaussian_mixture(C.features(_contours(spark, sf_dir), "legendre", n_points=N_POINTS), 3).select("token", "cluster", F.round("uncertainty", 6).alias("uncertainty"))


GIVEN = ((0.5, (0.05, -0.05), (0.02, 0.03)), (0.3, (-0.1, 0.1), (0.01, 0.04)), (0.2, (0.0, 0.2), (0.05, 0.02)))


@query("m8_given_mixture", "WITH g(c, w, m1, m2, v1, v2) AS (VALUES " + ", ".join(f"({i + 1}, {w}::DOUBLE, {m[0]}::DOUBLE, {m[1]}::DOUBLE, {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for i, (w, m, v) in enumerate(GIVEN)) + """),
d AS (SELECT vec_id, c, ln(w) - 0.5 * (ln(2 * pi() * v1) + ln(2 * pi() * v2)) - 0.5 * ((embedding[1]::DOUBLE - m1) ** 2 / v1 + (embedding[2]::DOUBLE - m2) ** 2 / v2) AS z FROM embeddings, g),
r AS (SELECT vec_id, c, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS r FROM d WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id::VARCHAR AS token, arg_max(c, r)::INTEGER AS cluster, 1 - max(r) AS uncertainty FROM r GROUP BY vec_id""", "uncertainty", base=None)
def _(spark, sf_dir):
    """Clusters and uncertainties under a mixture that is given."""
    w, m, v = (np.array([g[i] for g in GIVEN]) for i in range(3))
    feat = _vectors(spark, sf_dir).drop("cluster").withColumn("features", F.slice("features", 1, 2))
    return C.with_posterior(feat, w, m, v).select("token", "cluster", "uncertainty")


@query("m8_mixture_forms")
def _(spark, sf_dir):
    """BIC of every form and number of components; planted forms are found in the tests."""
    return C.mixture_table(C.features(_contours(spark, sf_dir), "legendre", n_points=N_POINTS)).withColumn("bic", F.round("bic", 3))


@query("a21_membership_confidence")
def _(spark, sf_dir):
    return C.membership_confidence(C.gaussian_mixture(C.features(_contours(spark, sf_dir), "legendre", n_points=N_POINTS), 3))


@query("a21_confidence_of_distances", """WITH u AS (SELECT abs(embedding[1]::DOUBLE) AS u FROM embeddings) SELECT count(*) FILTER (u > 0.4) AS n_uncertain, count(*) FILTER (u > 0.4) / count(*) AS share, avg(u) AS mean_uncertainty FROM u""", "share mean_uncertainty", base=None)
def _(spark, sf_dir):
    """The same summary of uncertainties that come with the table, not from a mixture."""
    return C.membership_confidence(_vectors(spark, sf_dir).select(F.abs(F.get("features", F.lit(0))).alias("uncertainty")))


@query("m9_hierarchical")
def _(spark, sf_dir):
    return C.hierarchical(C.features(_contours(spark, sf_dir, "shape"), "dct", n_points=N_POINTS), 3).select("token", "cluster")


@query("m10_choose_k")
def _(spark, sf_dir):
    return C.choose_k(C.features(_contours(spark, sf_dir), "legendre", n_points=N_POINTS), range(2, 9), gap_references=20)


@query("m12_pca_projection")
def _(spark, sf_dir):
    return C.project(_vectors(spark, sf_dir)).select("token", *(F.round(F.abs(c), 6).alias(c) for c in ("pc1", "pc2", "pct1", "pct2")))


@query("m14_compare_solutions")
def _(spark, sf_dir):
    each = C.kmeans_of_each(C.features(_contours(spark, sf_dir), "legendre", n_points=N_POINTS), range(2, 9))
    return C.compare_solutions(each)


@query("m14_compare_given", f"WITH {ASSIGNED}, k AS (SELECT unnest([2, 3]) AS k), a AS (SELECT k, CASE WHEN k = 2 THEN label % 2 + 1 ELSE cluster END AS c, position, v FROM e, k), m AS (SELECT k, c, position, avg(v) AS value, count(*) AS size FROM a GROUP BY ALL), h AS (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY avg(value), c) AS place FROM m GROUP BY k, c) SELECT k, place::INTEGER AS cluster, position::INTEGER AS position, value, size FROM m JOIN h USING (k, c)", "value", base=None)
def _(spark, sf_dir):
    """Mean contours by height for two groupings that are given."""
    v = _vectors(spark, sf_dir)
    given = F.create_map(F.lit(2), (F.col("tone").cast("int") % 2 + 1).cast("int"), F.lit(3), F.col("cluster").cast("int"))
    return C.compare_solutions(v.withColumn("clusters", given).drop("cluster"))


@query("j9_labels_on_frames", "SELECT token, time, CASE WHEN n > 3 THEN split_part(token, '_', 1)::INTEGER % 3 + 1 END AS cluster, CASE WHEN n > 3 AND split_part(token, '_', 1)::INTEGER % 3 = 0 THEN 'low' END AS cluster_name FROM (SELECT *, count(f0) OVER (PARTITION BY token) AS n FROM frames)", "time")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    a = f.groupBy("token").agg(F.count("f0").alias("n")).filter("n > 3").select("token", (F.split("token", "_")[0].cast("int") % 3 + 1).alias("cluster"))
    return C.labels_on_frames(f, a, {1: "low"}).select("token", "time", "cluster", "cluster_name")


def _timed(spark, sf_dir):
    return N.resolve_time(event_frames(spark, sf_dir))


@query("m1_time_moments", TIME01 + " SELECT " + ", ".join(f"sum(pow(time01, {i})) AS m{i}" for i in range(5)) + " FROM t01", "m0 m1 m2 m3 m4")
def _(spark, sf_dir):
    return M.time_moments(_timed(spark, sf_dir), "time01", 2)


@query("m1_cell_sums", TIME01 + """ SELECT tone, speaker, item, count(*) AS n, sum(f0 * f0) AS yy, count(*)::DOUBLE AS g0_0, sum(time01) AS g0_1, sum(time01 * time01) AS g1_1, sum(f0) AS b0, sum(f0 * time01) AS b1 FROM t01 WHERE f0 IS NOT NULL GROUP BY 1, 2, 3""", "yy g0_0 g0_1 g1_1 b0 b1")
def _(spark, sf_dir):
    return M.cell_sums(_timed(spark, sf_dir), [F.lit(1.0), F.col("time01")], "f0", ["tone", "speaker", "item"])


@query("m1_m2_growth_curve_fixed", TIME01 + """, s AS (SELECT tone, count(*) AS n, sum(time01) AS x, sum(time01 * time01) AS xx, sum(f0) AS y, sum(f0 * time01) AS xy FROM t01 WHERE f0 IS NOT NULL GROUP BY tone), c AS (SELECT tone, (n * xy - x * y) / (n * xx - x * x) AS b, y / n - (n * xy - x * y) / (n * xx - x * x) * x / n AS a FROM s)
SELECT tone, i / 99.0::DOUBLE AS time, a + b * i / 99.0::DOUBLE AS f0_predicted FROM c, (SELECT unnest(range(0, 100)) AS i)""", "time f0_predicted")
def _(spark, sf_dir):
    return M.predict_growth_curve(spark, M.fit_growth_curve(_timed(spark, sf_dir), degree=1, random=()))


@query("m1_m2_growth_curve")
def _(spark, sf_dir):
    """Random intercepts and slopes by speaker; compared with known effects in the tests."""
    return M.predict_growth_curve(spark, M.fit_growth_curve(_timed(spark, sf_dir), random=("speaker",)))


@query("m3_growth_curve_contrasts")
def _(spark, sf_dir):
    return M.contrasts(spark, M.fit_growth_curve(_timed(spark, sf_dir), random=("speaker",)))


@query("m3_growth_curve_effects")
def _(spark, sf_dir):
    return M.effects_table(spark, M.fit_growth_curve(_timed(spark, sf_dir), random=("speaker",)))


@query("m1_item_intercepts")
def _(spark, sf_dir):
    """Random curves of speakers with all covariances, and item intercepts; planted ones are found in the tests."""
    m = M.fit_growth_curve(_timed(spark, sf_dir), random={"speaker": "slopes", "item": "intercept"})
    rows = [(name, i, j, float(c[i, j])) for name, c in m.covariances.items() for i in range(len(c)) for j in range(len(c))]
    return spark.createDataFrame(rows, "factor string, i int, j int, covariance double")


def _spline_sql(x: str, k: int) -> list[str]:
    """The k cubic B-splines over 0-1 as SQL."""
    out = []
    for j in range(k):
        u = f"(({x}) * {k - 3} - {j - 3})"
        out.append(f"""CASE WHEN {u} >= 0 AND {u} < 1 THEN {u} ** 3 / 6 WHEN {u} >= 1 AND {u} < 2 THEN (-3 * ({u} - 1) ** 3 + 3 * ({u} - 1) ** 2 + 3 * ({u} - 1) + 1) / 6
          WHEN {u} >= 2 AND {u} < 3 THEN (3 * ({u} - 2) ** 3 - 6 * ({u} - 2) ** 2 + 4) / 6 WHEN {u} >= 3 AND {u} <= 4 THEN (4 - {u}) ** 3 / 6 ELSE 0 END""")
    return out


SUMS_K = 5


@query("m4_spline_sums", TIME01 + ", b AS (SELECT tone, speaker, item, f0, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(_spline_sql("time01", SUMS_K))) + """ FROM t01 WHERE f0 IS NOT NULL),
c AS (SELECT tone, speaker, item, count(*) AS n, sum(f0 * f0) AS yy, [""" + ", ".join(f"sum(x{i} * x{j})" for i in range(SUMS_K) for j in range(i, SUMS_K)) + "] AS g, [" + ", ".join(f"sum(x{i} * f0)" for i in range(SUMS_K)) + """] AS b FROM b GROUP BY ALL)
SELECT tone, speaker, item, n, yy, generate_subscripts(g, 1)::INTEGER AS place, unnest(g) AS g, unnest(b) AS b FROM c""", "yy g b")
def _(spark, sf_dir):
    """The sums that smooths are fitted from: products of splines with each other and with f0 per tone, speaker and item."""
    keys = {"tone": F.col("tone"), "outer": F.col("speaker"), "inner": F.col("item")}
    sums = X.packed_sums(_timed(spark, sf_dir), M.spline_basis(F.col("time01"), SUMS_K), F.col("f0"), keys)
    return sums.select("tone", F.col("outer").alias("speaker"), F.col("inner").alias("item"), "n", "yy", F.posexplode("g").alias("place", "g"), "b").select("tone", "speaker", "item", "n", "yy", (F.col("place") + 1).alias("place"), "g", F.get("b", F.col("place")).alias("b"))


@query("m4_m5_smooth_curves")
def _(spark, sf_dir):
    return M.predict_smooth(spark, M.fit_smooth(_timed(spark, sf_dir)))


@query("m4_difference_smooths_ar1")
def _(spark, sf_dir):
    return M.predict_smooth(spark, M.fit_smooth(_timed(spark, sf_dir), smooth_type="difference", use_ar1=True))


def _random(spark, sf_dir, form, smooth_type="separate"):
    return M.predict_smooth(spark, M.fit_smooth(_timed(spark, sf_dir), item="item", random_smooth=form, smooth_type=smooth_type))


@query("m4_random_speaker")
def _(spark, sf_dir):
    """Random curves of speakers and item intercepts; planted curves are found in the tests, and equal a dense solution."""
    return _random(spark, sf_dir, "speaker")


@query("m4_random_speaker_tone")
def _(spark, sf_dir):
    return _random(spark, sf_dir, "speaker_tone")


@query("m4_random_speaker_by_tone")
def _(spark, sf_dir):
    return _random(spark, sf_dir, "speaker_by_tone")


@query("m4_random_reference_difference")
def _(spark, sf_dir):
    return _random(spark, sf_dir, "ref_diff", "difference")


@query("m4_m5_duration")
def _(spark, sf_dir):
    """A duration smooth beside the tones' (a token's time span), predictions at the mean duration."""
    t = _timed(spark, sf_dir).withColumn("span", F.max("time").over(Window.partitionBy("token")) - F.min("time").over(Window.partitionBy("token")))
    return M.predict_smooth(spark, M.fit_smooth(t, duration="span", item="item"), at_mean_duration=True)


def _scored(spark, sf_dir):
    t = _timed(spark, sf_dir)
    return M.score_smooth(t, M.fit_smooth(t))


@query("m6_diagnostics")
def _(spark, sf_dir):
    return M.residual_acf(_scored(spark, sf_dir), "residual", max_lag=10)


@query("m15_quantile_pairs")
def _(spark, sf_dir):
    return M.quantile_pairs(_scored(spark, sf_dir))


@query("m15_residual_histogram")
def _(spark, sf_dir):
    return M.residual_histogram(_scored(spark, sf_dir))


@query("m15_value_histogram", """e AS (SELECT min(f0) AS lo, max(f0) AS hi FROM frames), b AS (SELECT least(30, floor((f0 - lo) / (hi - lo) * 30)::INTEGER + 1) AS bin, lo, hi FROM frames, e WHERE f0 IS NOT NULL)
SELECT bin, lo + (bin - 1) * (hi - lo) / 30 AS edge, count(*) AS count FROM b GROUP BY ALL""", "edge")
def _(spark, sf_dir):
    """The same histogram of the values themselves, which need no model."""
    return M.residual_histogram(event_frames(spark, sf_dir), "f0")


def _grid_sql(x: str, y: str) -> str:
    """Counts in a grid of 40 x 40 over the ranges of two expressions of the fitted frames ``s``."""
    place = lambda c: f"least(40, floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 40)::INTEGER + 1)"
    edge = lambda c: f"min({c}) OVER () + ({place(c)} - 1) * (max({c}) OVER () - min({c}) OVER ()) / 40"
    return f"""s AS (SELECT f0, 90 + intensity / 3 AS fitted, f0 - (90 + intensity / 3) AS residual FROM frames WHERE f0 IS NOT NULL AND intensity IS NOT NULL),
b AS (SELECT {place(x)} AS x_bin, {place(y)} AS y_bin, {edge(x)} AS x_edge, {edge(y)} AS y_edge FROM s) SELECT x_bin, y_bin, x_edge, y_edge, count(*) AS count FROM b GROUP BY ALL"""


def _given_fit(spark, sf_dir):
    """Frames with a fit that is given: a line of the intensity."""
    return event_frames(spark, sf_dir).withColumn("fitted", 90 + F.col("intensity") / 3).withColumn("residual", F.col("f0") - F.col("fitted"))


@query("m15_residual_vs_fitted", _grid_sql("fitted", "residual"), "x_edge y_edge")
def _(spark, sf_dir):
    return M.residual_vs_fitted(_given_fit(spark, sf_dir))


@query("m15_observed_vs_fitted", _grid_sql("fitted", "f0"), "x_edge y_edge")
def _(spark, sf_dir):
    return M.observed_vs_fitted(_given_fit(spark, sf_dir))


@query("m15_residual_vs_fitted_of_smooths")
def _(spark, sf_dir):
    """The same panel for the smooths themselves."""
    return M.residual_vs_fitted(_scored(spark, sf_dir)).select("x_bin", "y_bin", "count")


ACF = """d AS (SELECT token, time, f0 - avg(f0) OVER () AS c, count(*) OVER () AS n FROM frames WHERE f0 IS NOT NULL), l AS (SELECT token, time, c, n, """ + ", ".join(f"lag(c, {i}) OVER w AS c{i}" for i in range(1, 6)) + """ FROM d WINDOW w AS (PARTITION BY token ORDER BY time)),
s AS (SELECT any_value(n) AS n, [sum(c * c), """ + ", ".join(f"coalesce(sum(c * c{i}), 0)" for i in range(1, 6)) + "] AS s FROM l) SELECT (unnest(range(0, 6)))::INTEGER AS lag, unnest(s) / s[1] AS acf, 1.96 / sqrt(n) AS band FROM s"


@query("w12_residual_acf", ACF, "acf band")
def _(spark, sf_dir):
    return M.residual_acf(event_frames(spark, sf_dir), "f0", max_lag=5)


@query("w12_whitened_acf", ACF.replace("d AS (", "e AS (SELECT token, time, f0 - CASE WHEN row_number() OVER w = 1 THEN 0 ELSE 0.4 * lag(f0) OVER w END AS f0 FROM frames WHERE f0 IS NOT NULL WINDOW w AS (PARTITION BY token ORDER BY time)), d AS (", 1).replace("FROM frames WHERE f0 IS NOT NULL), l AS", "FROM e), l AS", 1), "acf band")
def _(spark, sf_dir):
    return M.residual_acf(event_frames(spark, sf_dir), "f0", rho=0.4, max_lag=5)
