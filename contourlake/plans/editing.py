"""Queries: metadata, curation, corrections and the edit log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.operators import correct as E
from contourlake.operators import curate as U
from contourlake.operators import inspect as I
from contourlake.operators import metadata as M
from contourlake.operators import region as R
from contourlake.operators import resample as RS
from contourlake.operators import summaries as S
from contourlake.operators import views as V
from contourlake.plans.describe import ONE, RESAMPLED
from contourlake.plans.inspection import ATTACHED, INSPECTED, TRIMMED, _attached, _inspected
from contourlake.plans.registry import query
from contourlake.plans.sql import DECISIONS, METADATA
from contourlake.sources.adapters import decisions, event_frames, speaker_metadata, table

KEYED = METADATA + r""", m AS (SELECT *, lower(trim(regexp_replace(key, '([^.]+)\.[A-Za-z0-9]+$', '\1'))) AS mkey FROM metadata)"""


@query("j3a_first_metadata", KEYED + ", f AS (SELECT mkey, min_by(dialect, line) AS dialect, min(line) AS line FROM m GROUP BY mkey) SELECT token, time, frames.tone, line, dialect FROM frames LEFT JOIN f ON f.mkey = lower(trim(token))", "time")
def _(spark, sf_dir):
    return M.join_first_metadata(event_frames(spark, sf_dir), speaker_metadata(spark, sf_dir), "key", order="line").select("token", "time", "tone", "line", "dialect")


@query("j3b_all_metadata", KEYED + " SELECT token, time, frames.tone, line, dialect, m.tone AS tone_meta FROM frames LEFT JOIN m ON m.mkey = lower(trim(token))", "time")
def _(spark, sf_dir):
    j = M.join_all_metadata(event_frames(spark, sf_dir), speaker_metadata(spark, sf_dir), "key")
    return j.select("token", "time", "tone", "line", "dialect", F.col("`tone.meta`").alias("tone_meta"))


@query("j4_match_report", KEYED + """, a AS (SELECT DISTINCT lower(trim(token)) AS k FROM frames), b AS (SELECT DISTINCT mkey AS k FROM m)
SELECT count(a.k) AS n_tokens, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_matched, count(*) FILTER (b.k IS NULL) AS n_without_metadata, count(*) FILTER (a.k IS NULL) AS n_without_token FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf_dir):
    return M.match_report(event_frames(spark, sf_dir), speaker_metadata(spark, sf_dir), "key")


@query("x5_split_token", "SELECT token, split_part(token, '_', 1) AS user, split_part(token, '_', 2) AS kind, NULL::VARCHAR AS column_3 FROM frames")
def _(spark, sf_dir):
    return M.split_token(event_frames(spark, sf_dir), "_", ["user", "kind", ""]).select("token", "user", "kind", "column_3")


@query("a22_part_counts", "SELECT min(len(string_split(token, '_')))::INTEGER AS min_parts, max(len(string_split(token, '_')))::INTEGER AS max_parts FROM (SELECT DISTINCT token FROM frames)")
def _(spark, sf_dir):
    return M.part_counts(event_frames(spark, sf_dir), "_")


@query("j10_first_of_token", "SELECT token, min_by(speaker, time) AS speaker, min_by(intensity, time) AS intensity FROM frames GROUP BY token")
def _(spark, sf_dir):
    return M.first_of_token(event_frames(spark, sf_dir), ["speaker", "intensity"])


@query("w11_event_starts", "SELECT token, time, row_number() OVER (PARTITION BY token ORDER BY time) = 1 AS event_start FROM frames", "time")
def _(spark, sf_dir):
    return M.event_starts(event_frames(spark, sf_dir)).select("token", "time", "event_start")


CURATED = DECISIONS + """, cur AS (SELECT f.*, coalesce(label, tone) AS tone_relabelled, coalesce(d.excluded, false) AS excluded, d.note FROM frames f LEFT JOIN decisions d ON d.token = f.token)"""


def _curated(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return U.apply_decisions(f, decisions(f))


@query("j6_apply_decisions", CURATED + " SELECT token, time, tone, tone_relabelled, excluded, note FROM cur", "time")
def _(spark, sf_dir):
    return _curated(spark, sf_dir).select("token", "time", "tone", "tone_relabelled", "excluded", "note")


@query("c10_publish_curated", CURATED + " SELECT token, time, f0, tone_relabelled AS tone, tone AS tone_original, note FROM cur WHERE NOT excluded", "time f0")
def _(spark, sf_dir):
    return U.publish(_curated(spark, sf_dir)).select("token", "time", "f0", "tone", "tone_original", "note")


@query("a15_curation_state", DECISIONS + """ SELECT d.token, min(speaker) AS speaker, min(tone) AS original_tone, CASE WHEN label IS NOT NULL AND excluded THEN 'relabel + exclude' WHEN label IS NOT NULL THEN 'relabel' WHEN excluded THEN 'exclude' ELSE 'note' END AS action, label AS new_label, excluded, note
FROM decisions d JOIN frames USING (token) GROUP BY ALL""")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return U.curation_state(f, decisions(f))


@query("c11_resume_curation", CURATED + """ SELECT token, min(CASE WHEN tone_relabelled IS DISTINCT FROM tone AND length(tone_relabelled) > 0 THEN tone_relabelled END) AS label, bool_or(excluded) AS excluded, min(nullif(nullif(note, 'NA'), '')) AS note
FROM cur GROUP BY token HAVING label IS NOT NULL OR bool_or(excluded) OR min(note) IS NOT NULL""")
def _(spark, sf_dir):
    return U.resume(_curated(spark, sf_dir))


EDITS = """edits AS (
  SELECT 1 AS seq, token, [2, 3] AS frame_indices, CASE n % 4 WHEN 0 THEN 'halve' WHEN 1 THEN 'double' WHEN 2 THEN 'delete' ELSE 'set' END AS action, CASE WHEN n % 4 = 3 THEN 150.0::DOUBLE ELSE 0.0::DOUBLE END AS value
  FROM (SELECT DISTINCT token, split_part(token, '_', 1)::INTEGER + length(token) AS n FROM frames) WHERE n % 5 < 2
), picks AS (SELECT seq, token, action, value, unnest(frame_indices) AS i FROM edits),
numbered AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS rn, count(*) OVER (PARTITION BY token) AS n FROM frames),
edited AS (
  SELECT f.* REPLACE (CASE action WHEN 'halve' THEN f0 / 2 WHEN 'double' THEN f0 * 2 WHEN 'delete' THEN NULL WHEN 'set' THEN value ELSE f0 END AS f0), f.f0 AS before FROM numbered f LEFT JOIN picks p ON p.token = f.token AND p.i = f.rn
)"""


def edit_table(frames):
    """Simple edits of frames 2 and 3 of some tokens."""
    n = F.split("token", "_")[0].cast("int") + F.length("token")
    t = frames.select("token").distinct().withColumn("n", n).filter("n % 5 < 2")
    action = F.element_at(F.array(*(F.lit(a) for a in ("halve", "double", "delete", "set"))), F.col("n") % 4 + 1)
    return t.select(F.lit(1).alias("seq"), "token", F.array(F.lit(2), F.lit(3)).alias("frame_indices"), action.alias("action"), F.when(F.col("n") % 4 == 3, 150.0).otherwise(0.0).alias("value"))


@query("e1_e2_scale_frames", EDITS + " SELECT token, time, f0 FROM edited", "time f0")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return E.scale_frames(f, edit_table(f)).select("token", "time", "f0")


@query("e1_e2_replay", EDITS + " SELECT token, time, f0 FROM edited", "time f0")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return E.replay(f, edit_table(f)).select("token", "time", "f0")


for _kind, _sql in (("mean", "avg(f0) OVER w"), ("median", "median(f0) OVER w")):

    @query(f"e4_smooth_{_kind}", f"SELECT token, time, {_sql} AS f0_smooth FROM frames WINDOW w AS (PARTITION BY token ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "time f0_smooth")
    def _(spark, sf_dir, kind=_kind):
        return E.smooth(event_frames(spark, sf_dir), width=5, kind=kind).select("token", "time", "f0_smooth")


@query("e4_replay_smooth", """n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS rn FROM frames), s AS (SELECT *, median(f0) OVER (PARTITION BY token ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM n)
SELECT token, time, CASE WHEN rn IN (2, 4) AND tone = 'click' THEN sm ELSE f0 END AS f0 FROM s""", "time f0")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    edits = f.filter("tone = 'click'").select(F.lit(1).alias("seq"), "token", F.array(F.lit(2), F.lit(4)).alias("frame_indices"), F.lit("smooth_median").alias("action"), F.lit(3.0).alias("value")).distinct()
    return E.replay(f, edits).select("token", "time", "f0")


@query("e5_interpolate_linear", """n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS rn FROM frames),
c AS (SELECT n.token, n.time, a.time AS ta, a.f0 AS fa, row_number() OVER (PARTITION BY n.token, n.time ORDER BY abs(a.time - n.time), a.time) AS k FROM n JOIN n a ON a.token = n.token AND a.rn <> 3 AND a.f0 > 0 WHERE n.rn = 3 AND n.tone = 'view'),
v AS (SELECT token, time, count(*) AS m, min(ta) AS t1, max(ta) AS t2, arg_min(fa, ta) AS f1, arg_max(fa, ta) AS f2 FROM c WHERE k <= 2 GROUP BY 1, 2)
SELECT n.token, n.time, CASE WHEN rn = 3 AND tone = 'view' THEN CASE WHEN m = 2 THEN CASE WHEN n.time <= t1 THEN f1 WHEN n.time >= t2 THEN f2 ELSE f1 + (n.time - t1) / (t2 - t1) * (f2 - f1) END END ELSE f0 END AS f0 FROM n LEFT JOIN v ON v.token = n.token AND v.time = n.time""", "time f0")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    edits = f.filter("tone = 'view'").select(F.lit(1).alias("seq"), "token", F.array(F.lit(3)).alias("frame_indices"), F.lit("interpolate_linear").alias("action"), F.lit(2.0).alias("value")).distinct()
    return E.replay(f, edits).select("token", "time", "f0")


def _interpolated(spark, sf_dir, action: str, anchors: float):
    f = event_frames(spark, sf_dir)
    edits = f.filter("tone = 'view'").select(F.lit(1).alias("seq"), "token", F.array(F.lit(3)).alias("frame_indices"), F.lit(action).alias("action"), F.lit(anchors).alias("value")).distinct()
    return E.replay(f, edits).select("token", "time", "f0")


#: The nearest anchors of the third frame, with times from it in units of the farthest one's.
ANCHORS = """n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS rn FROM frames),
c AS (SELECT n.token, n.time, a.time AS ta, a.f0 AS y, row_number() OVER (PARTITION BY n.token, n.time ORDER BY abs(a.time - n.time), a.rn) AS k FROM n JOIN n a ON a.token = n.token AND a.rn <> 3 AND a.f0 > 0 WHERE n.rn = 3 AND n.tone = 'view'),
w AS (SELECT token, time, ta, y, (ta - avg(ta) OVER g) / max(ta - time) OVER g AS x, (time - avg(ta) OVER g) / max(ta - time) OVER g AS x0 FROM (SELECT * FROM c WHERE LIMITED) WINDOW g AS (PARTITION BY token, time)),
l AS (SELECT token, time, count(*) AS m, any_value(x0) AS x0, min(ta) AS t1, max(ta) AS t2, arg_min(y, ta) AS f1, arg_max(y, ta) AS f2, regr_slope(y, x) AS slope, regr_intercept(y, x) AS start, avg(x * x) AS q2, avg(x * x * x) AS q3 FROM w GROUP BY 1, 2),
v AS (SELECT token, time, CASE WHEN m > 2 THEN VALUE WHEN m = 2 THEN CASE WHEN time <= t1 THEN f1 WHEN time >= t2 THEN f2 ELSE f1 + (time - t1) / (t2 - t1) * (f2 - f1) END END AS f FROM l)
SELECT n.token, n.time, CASE WHEN rn = 3 AND tone = 'view' THEN f ELSE f0 END AS f0 FROM n LEFT JOIN v ON v.token = n.token AND v.time = n.time"""
#: What a square adds to the line: its part that the line can't tell, z, has its own slope.
CURVED = """z AS (SELECT w.token, w.time, regr_slope(y - (start + slope * x), x * x - (q2 + q3 / q2 * x)) AS bend FROM w JOIN l ON l.token = w.token AND l.time = w.time GROUP BY 1, 2),
v AS ("""


@query("e5_interpolate_linear_window", ANCHORS.replace("LIMITED", "k <= 6").replace("VALUE", "start + slope * x0"), "time f0")
def _(spark, sf_dir):
    """A line through six anchors."""
    return _interpolated(spark, sf_dir, "interpolate_linear", 6.0)


@query("e5_interpolate_linear_all", ANCHORS.replace("LIMITED", "TRUE").replace("VALUE", "start + slope * x0"), "time f0")
def _(spark, sf_dir):
    """A line through all anchors."""
    return _interpolated(spark, sf_dir, "interpolate_linear", -1.0)


@query("e5_interpolate_parabola", ANCHORS.replace("v AS (", CURVED, 1).replace("FROM l)", "FROM l JOIN z USING (token, time))").replace("LIMITED", "k <= 5").replace("VALUE", "start + slope * x0 + coalesce(bend, 0) * (x0 * x0 - (q2 + q3 / q2 * x0))"), "time f0")
def _(spark, sf_dir):
    """A parabola through five anchors."""
    return _interpolated(spark, sf_dir, "interpolate_parabola", 5.0)


@query("e5_interpolate_spline")
def _(spark, sf_dir):
    """A spline through four anchors; compared with numpy in the tests."""
    return _interpolated(spark, sf_dir, "interpolate_spline", 4.0)


DROPPED = "dropped AS (SELECT DISTINCT token FROM frames WHERE tone = 'view' AND speaker = 'S3')"


def _dropped(f):
    return f.filter("tone = 'view' and speaker = 'S3'").select("token").distinct()


@query("j8_compare_corrected", EDITS + ", " + DROPPED + """ SELECT token, time, before AS f0, f0 AS f0_corrected, coalesce(abs(before - f0) > 1e-6, (before IS NULL) <> (f0 IS NULL)) AS edited, token IN (SELECT token FROM dropped) AS token_dropped FROM edited""", "time f0 f0_corrected")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return E.compare(f, E.scale_frames(f, edit_table(f)), _dropped(f)).select("token", "time", "f0", "f0_corrected", "edited", "token_dropped")


@query("j11_fresh_edits", "SELECT token FROM frames GROUP BY token HAVING count(*) FILTER (intensity > 135) = 0")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return E.fresh_edits(f, f.filter("intensity <= 135"))


@query("x14_edit_log", EDITS + """ SELECT p.seq, p.token, '2024-01-01' AS date, action, count(*)::INTEGER AS n_frames, string_agg(rn, ', ' ORDER BY rn) AS frame_indices, string_agg(printf('%.3f', time), ', ' ORDER BY rn) AS frame_times_s, string_agg(CASE WHEN n > 1 THEN printf('%.1f', 100.0::DOUBLE * (rn - 1) / (n - 1)) END, ', ' ORDER BY rn) AS frame_pct
FROM picks p JOIN numbered f ON f.token = p.token AND f.rn = p.i GROUP BY 1, 2, action""")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return E.log_rows(edit_table(f), f, date="2024-01-01")


@query("j7_bulk_discards", INSPECTED + ", " + DROPPED + " SELECT DISTINCT token FROM ins WHERE flagged_token AND token NOT IN (SELECT token FROM dropped)")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return E.bulk_discards(I.flagged_tokens(_inspected(spark, sf_dir)), f, _dropped(f))


@query("p8_token_picker", INSPECTED + ", " + DROPPED + """, per AS (SELECT token, any_value(speaker) AS speaker, any_value(tone) AS tone, coalesce(bool_or(flagged_token), false) AS f, coalesce(bool_or(regexp_matches(flag_notes, 'level too|jump \\(')), false) AS c FROM ins GROUP BY token)
SELECT token FROM per WHERE f AND c AND speaker IN ('S1', 'S2', 'S3') AND tone <> 'click' AND token NOT IN (SELECT token FROM dropped)""")
def _(spark, sf_dir):
    ins, f = _inspected(spark, sf_dir), event_frames(spark, sf_dir)
    classes = I.flag_classes(ins).filter("has_level or has_rate")
    tones = [r[0] for r in f.select("tone").distinct().collect() if r[0] != "click"]
    return V.pick_tokens(ins, flagged=I.flagged_tokens(ins), of_class=classes, speakers=["S1", "S2", "S3"], tones=tones, kept_without=_dropped(f))


LOG = """log AS (SELECT token, 'Discard token' AS action, NULL::VARCHAR AS details FROM (SELECT DISTINCT token FROM frames WHERE tone = 'view') UNION ALL SELECT DISTINCT token, 'Halve', 'x' FROM frames WHERE tone = 'error'),
fresh AS (SELECT DISTINCT token, 'Discard token' AS action FROM frames WHERE tone IN ('view', 'click'))"""


def _log(f):
    old = f.filter("tone = 'view'").select("token", F.lit("Discard token").alias("action"), F.lit(None).cast("string").alias("details")).distinct()
    return old.unionByName(f.filter("tone = 'error'").select("token", F.lit("Halve").alias("action"), F.lit("x").alias("details")).distinct()), f.filter("tone in ('view', 'click')").select("token", F.lit("Discard token").alias("action")).distinct()


@query("u3_reconcile_log", LOG + ", now AS (SELECT DISTINCT token FROM frames WHERE speaker IN ('S1', 'S3')) SELECT token, action, details FROM log WHERE action <> 'Discard token' UNION ALL SELECT DISTINCT token, 'Discard token', NULL FROM (SELECT token FROM log WHERE action = 'Discard token' UNION SELECT token FROM fresh) WHERE token IN (SELECT token FROM now)")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    old, new = _log(f)
    return E.reconcile_log(old, new, f.filter("speaker in ('S1', 'S3')"))


@query("u4_remove_restored", LOG + " SELECT * FROM log WHERE NOT (action = 'Discard token' AND token IN (SELECT token FROM frames WHERE speaker = 'S1'))")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return E.without_restored(_log(f)[0], f.filter("speaker = 'S1'"))


@query("u2_e6_token_sets", """a AS (SELECT DISTINCT token FROM frames WHERE tone = 'view'), b AS (SELECT DISTINCT token FROM frames WHERE speaker = 'S1')
SELECT token, 'added' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT token, 'restored' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT token, 'in_view' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    a, b = (f.filter(c).select("token").distinct() for c in ("tone = 'view'", "speaker = 'S1'"))
    named = lambda d, op: d.withColumn("op", F.lit(op))
    return named(a.union(b).distinct(), "added").unionByName(named(a.subtract(b), "restored")).unionByName(named(a.intersect(b), "in_view"))


@query("u1_union_sources", "SELECT token, time, f0, intensity FROM frames WHERE tone = 'view' UNION ALL SELECT token, time, f0, NULL FROM frames WHERE tone = 'click'", "time f0")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return f.filter("tone = 'view'").select("token", "time", "f0", "intensity").unionByName(f.filter("tone = 'click'").select("token", "time", "f0"), allowMissingColumns=True)


@query("k4_nearest_anchors", """n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS rn FROM frames), c AS (SELECT a.token, b.time, row_number() OVER (PARTITION BY a.token ORDER BY abs(a.time - b.time), b.time) AS k FROM n a JOIN n b ON a.token = b.token AND b.f0 > 0 AND b.rn <> 3 WHERE a.rn = 3)
SELECT token, count(*)::INTEGER AS n, sum(time) AS total FROM c WHERE k <= 3 GROUP BY token""", "total")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("token").orderBy("time")))
    at = F.max(F.when(F.col("rn") == 3, F.col("time"))).alias("at")
    t = f.groupBy("token").agg(at, F.collect_list(F.when((F.col("f0") > 0) & (F.col("rn") != 3), F.struct("time"))).alias("a")).filter("at is not null and size(a) > 0")
    near = S.nearest(F.col("a"), F.col("at"), 3)
    return t.select("token", F.size(near).alias("n"), F.aggregate(near, F.lit(0.0), lambda s, x: s + x["time"]).alias("total"))


@query("c9_export_pipeline", TRIMMED + """, g AS (SELECT token, count(*) FILTER (NOT coalesce(f0 > 0, false)) AS n_missing FROM trimmed GROUP BY token)
SELECT t.token, count(*) AS n_frames, any_value(n_missing) AS n_missing, any_value(speaker) AS speaker FROM trimmed t JOIN g USING (token) WHERE NOT (tone = 'view' AND speaker = 'S3') GROUP BY t.token""")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return V.export(f, dropped=_dropped(f)).groupBy("token").agg(F.count("*").alias("n_frames"), F.first("n_missing").alias("n_missing"), F.first("speaker").alias("speaker"))


@query("p7_region_losses", TRIMMED + ", " + ATTACHED + """ SELECT (SELECT count(DISTINCT token) FROM frames) AS n_whole, (SELECT count(DISTINCT token) FROM trimmed) AS n_voiced, (SELECT count(DISTINCT token) FROM att WHERE rime_1 = 'a') AS n_interval""")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    n = lambda d, c: d.agg(F.count_distinct("token").alias(c))
    return n(f, "n_whole").crossJoin(n(R.trim_to_voiced(f), "n_voiced")).crossJoin(n(R.filter_intervals(_attached(spark, sf_dir), "rime_1", "vowel"), "n_interval"))


@query("p2_s8_load_projection", """SELECT o_orderkey::VARCHAR AS token, o_totalprice / 1000 AS time, TRY_CAST(CASE WHEN o_orderkey % 10 = 3 THEN 'NA' ELSE (o_orderkey % 300)::VARCHAR END AS DOUBLE) AS f0 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""", "time", base=None)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 3, "NA").otherwise((F.col("o_orderkey") % 300).cast("string"))
    near = table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    recordings = o.join(near, "o_custkey", "left_semi").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("basename"))
    loaded = V.load_projection(o.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("t"), text.alias("hz")), recordings, token="o_orderkey", time="t", f0="hz")
    return loaded.select("token", "time", "f0")


@query("j12_pick_candidate", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN pick = 0 THEN NULL WHEN abs(pick - l_quantity) <= 0.05 THEN l_quantity ELSE pick END AS f0
FROM (SELECT *, CASE l_partkey % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 2 ELSE 0.0 END AS pick FROM lineitem)""", base=None)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    one = lambda hz: F.struct(hz.cast("double").alias("frequency"), F.lit(0.5).alias("strength"))
    q = F.col("l_quantity")
    frame = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    keyed = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").cast("string").alias("token"), frame.alias("frame"), q.alias("f0"), F.array(one(q), one(q * 2), one(F.lit(0.0))).alias("candidates"), (F.col("l_partkey") % 3 + 1).cast("int").alias("choice"))
    return E.pick_candidates(keyed.drop("candidates", "choice"), keyed.select("token", "frame", "candidates"), keyed.select("token", "frame", "choice")).select("l_orderkey", "l_linenumber", "l_partkey", "f0")


@query("c4_carried_columns", RESAMPLED.replace("p = 20", "p = 4").replace("/ 20)", "/ 4)").replace("range(0, 21)", "range(0, 5)") + """, b AS (
  SELECT pt.token, pt.p, pt.x, pt.speaker, pt.tone, pt.item, f, f2, i, i2, (pt.x - t) / (t2 - t) AS ph, row_number() OVER (PARTITION BY pt.token, pt.p ORDER BY k DESC) AS rn FROM pt JOIN r1 ON r1.token = pt.token AND r1.t <= pt.x AND r1.k < r1.m
) SELECT token, (p + 1)::INTEGER AS point, x AS time, p / 4.0::DOUBLE AS time_prop, CASE WHEN ph < 0.5 THEN f ELSE f2 END AS f0, CASE WHEN ph < 0.5 THEN i ELSE i2 END AS intensity, speaker, tone, item FROM b WHERE rn = 1 UNION ALL """ + ONE, "time time_prop f0 intensity")
def _(spark, sf_dir):
    """Which columns are constant within tokens: decided over all tokens, then resampled to five points."""
    return RS.resample_equal(event_frames(spark, sf_dir), n=5, method="nearest")
