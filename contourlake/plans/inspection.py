"""Queries: inspection, regions, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contourlake.functions import scalars as X
from contourlake.operators import inspect as I
from contourlake.operators import region as R
from contourlake.operators import summaries as S
from contourlake.plans.registry import query, rounded_as_sql
from contourlake.plans.sql import INTERVALS, ORDER_FRAMES
from contourlake.sources.adapters import event_frames, event_intervals, order_frames

TOKENS = """sounded AS (SELECT * FROM frames WHERE f0 IS NOT NULL AND f0 <> 0),
tok AS (
  SELECT token, min_by(speaker, time) AS speaker, min_by(tone, time) AS tone, max(f0) AS f0_token_max, min(f0) AS f0_token_min, avg(f0) AS f0_token_mean,
    stddev_samp(f0) AS f0_token_sd, CASE WHEN median(f0) > 0 THEN 12 * log2(median(f0)) END AS level_st FROM sounded GROUP BY token
)"""
OUTLIERS = TOKENS + """,
zed AS (
  SELECT *, (f0_token_max - avg(f0_token_max) OVER s) / nullif(stddev_samp(f0_token_max) OVER s, 0) AS z_max,
    (f0_token_min - avg(f0_token_min) OVER s) / nullif(stddev_samp(f0_token_min) OVER s, 0) AS z_min FROM tok WINDOW s AS (PARTITION BY speaker)
), out1 AS (SELECT *, coalesce(z_max > 3, false) AS flag_too_high, coalesce(z_min < -3, false) AS flag_too_low FROM zed)"""
LEVELS = OUTLIERS + """,
l1 AS (SELECT *, count(*) OVER g AS n_tone_peers, median(level_st) OVER g AS mid FROM out1 WINDOW g AS (PARTITION BY speaker, tone)),
l2 AS (SELECT *, abs(level_st - mid) AS dev FROM l1),
l3 AS (SELECT *, median(dev) OVER g AS mad, avg(dev) OVER g AS mean_dev FROM l2 WINDOW g AS (PARTITION BY speaker, tone)),
l4 AS (SELECT *, CASE WHEN n_tone_peers < 5 THEN NULL WHEN mad > 0 THEN 0.6745 * (level_st - mid) / mad WHEN mean_dev > 0 THEN (level_st - mid) / (1.253314 * mean_dev) END AS level_modz FROM l3),
lev AS (SELECT *, coalesce(level_modz > 3.5, false) AS flag_level_high, coalesce(level_modz < -3.5, false) AS flag_level_low FROM l4)"""


def jumps_sql(table: str = "frames") -> str:
    """Jumps between neighbours, then the flag carried on in both directions."""
    return f"""j0 AS (SELECT token, time, speaker, tone, intensity, CASE WHEN f0 <> 0 THEN f0 END AS f0, CASE WHEN f0 > 0 THEN 12 * log2(f0) END AS st FROM {table}),
j1 AS (
  SELECT *, CASE WHEN count(st) OVER t >= 2 THEN median(st) OVER t END AS mid, lag(st) OVER w AS pst, lag(time) OVER w AS pt, lag(f0) OVER w AS pf, lead(st) OVER w AS nst, lead(time) OVER w AS nt, lead(f0) OVER w AS nf
  FROM j0 WINDOW t AS (PARTITION BY token), w AS (PARTITION BY token ORDER BY time)
), j2 AS (
  SELECT *, abs(st - pst) / greatest((time - pt) * 1000 / 10, 1e-9) AS pr, abs(nst - st) / greatest((nt - time) * 1000 / 10, 1e-9) AS nr FROM j1
), j3 AS (
  SELECT *, CASE WHEN st IS NOT NULL AND pst IS NOT NULL AND mid IS NOT NULL AND NOT abs(pst - mid) > abs(st - mid) + 1e-9 THEN
      concat_ws('; ', CASE WHEN f0 / pf < 0.49 OR f0 / pf > 1.99 THEN 'octave jump' END, CASE WHEN st > pst AND pr > 1.263 THEN 'jump (rise)' END, CASE WHEN st < pst AND pr > 1.714 THEN 'jump (fall)' END) END AS before,
    CASE WHEN st IS NOT NULL AND nst IS NOT NULL AND mid IS NOT NULL AND abs(st - mid) > abs(nst - mid) + 1e-9 THEN
      concat_ws('; ', CASE WHEN nf / f0 < 0.49 OR nf / f0 > 1.99 THEN 'octave jump' END, CASE WHEN nst > st AND nr > 1.263 THEN 'jump (rise)' END, CASE WHEN nst < st AND nr > 1.714 THEN 'jump (fall)' END) END AS after
  FROM j2
), j4 AS (SELECT *, concat_ws('; ', nullif(before, ''), nullif(after, '')) AS note FROM j3),
j5 AS (
  SELECT *, sum((note <> '')::INT) OVER f AS fseg, last_value(CASE WHEN note <> '' THEN st END IGNORE NULLS) OVER f AS fan, sum((note <> '')::INT) OVER b AS bseg, last_value(CASE WHEN note <> '' THEN st END IGNORE NULLS) OVER b AS ban
  FROM j4 WINDOW f AS (PARTITION BY token ORDER BY time ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY token ORDER BY time DESC ROWS UNBOUNDED PRECEDING)
), j6 AS (
  SELECT *, coalesce(note = '' AND (st IS NULL OR abs(st - fan) > 1.5 * CASE WHEN pst > st THEN 1.263 WHEN pst IS NOT NULL THEN 1.714 ELSE 1.714 END), false)::INT AS fstop,
    coalesce(note = '' AND (st IS NULL OR abs(st - ban) > 1.5 * CASE WHEN nst > st THEN 1.263 WHEN nst IS NOT NULL THEN 1.714 ELSE 1.714 END), false)::INT AS bstop FROM j5
), j7 AS (
  SELECT *, note = '' AND ((fseg > 0 AND max(fstop) OVER (PARTITION BY token, fseg ORDER BY time ROWS UNBOUNDED PRECEDING) = 0) OR (bseg > 0 AND max(bstop) OVER (PARTITION BY token, bseg ORDER BY time DESC ROWS UNBOUNDED PRECEDING) = 0)) AS carried FROM j6
), jumps AS (SELECT token, time, f0, speaker, tone, intensity, note <> '' OR carried AS flagged_jump, CASE WHEN note <> '' THEN note WHEN carried THEN 'carryover' ELSE '' END AS jump_note FROM j7)"""


INSPECTED = LEVELS + ",\n" + jumps_sql() + """,
i1 AS (
  SELECT j.*, f0_token_max, f0_token_min, f0_token_mean, f0_token_sd, flag_too_high, flag_too_low, coalesce(flag_level_high, false) AS flag_level_high, coalesce(flag_level_low, false) AS flag_level_low,
    bool_or(flagged_jump) OVER (PARTITION BY j.token) AS jumped, max(CASE WHEN f0 IS NOT NULL AND j.intensity IS NOT NULL THEN j.intensity END) OVER (PARTITION BY j.token) AS loud
  FROM jumps j LEFT JOIN lev ON lev.token IS NOT DISTINCT FROM j.token
), i2 AS (
  SELECT *, flag_too_high OR flag_too_low OR flag_level_high OR flag_level_low OR jumped AS flagged_token, coalesce(f0 IS NOT NULL AND intensity < loud - 15, false) AS flag_low_intensity,
    CASE WHEN flag_too_high IS NOT NULL THEN concat_ws('; ', CASE WHEN flag_too_high THEN 'max too high' END, CASE WHEN flag_too_low THEN 'min too low' END, CASE WHEN flag_level_high THEN 'level too high' END,
      CASE WHEN flag_level_low THEN 'level too low' END, CASE WHEN jump_note <> '' THEN jump_note END) END AS base_notes FROM i1
), ins AS (
  SELECT token, time, f0, intensity, speaker, tone, f0_token_max, f0_token_min, f0_token_mean, f0_token_sd, flagged_token, flagged_jump,
    CASE WHEN flag_low_intensity AND base_notes IS NOT NULL THEN concat_ws('; ', nullif(base_notes, ''), 'low intensity') ELSE base_notes END AS flag_notes, flag_low_intensity FROM i2
)"""


def _inspected(spark, sf_dir):
    return I.inspect_f0(event_frames(spark, sf_dir), intensity="intensity")


@query("a1_token_statistics", TOKENS + " SELECT * FROM tok", "f0_token_max f0_token_min f0_token_mean f0_token_sd level_st")
def _(spark, sf_dir):
    return I.token_statistics(event_frames(spark, sf_dir))


@query("w1_flag_outliers", OUTLIERS + " SELECT token, speaker, z_max, z_min, flag_too_high, flag_too_low FROM out1", "z_max z_min")
def _(spark, sf_dir):
    return I.flag_outliers(I.token_statistics(event_frames(spark, sf_dir))).select("token", "speaker", "z_max", "z_min", "flag_too_high", "flag_too_low")


@query("w2_flag_level_outliers", LEVELS + " SELECT token, speaker, tone, n_tone_peers, level_modz, flag_level_high, flag_level_low FROM lev", "level_modz")
def _(spark, sf_dir):
    t = I.flag_level_outliers(I.token_statistics(event_frames(spark, sf_dir)))
    return t.select("token", "speaker", "tone", "n_tone_peers", "level_modz", "flag_level_high", "flag_level_low")


@query("w3_flag_low_intensity", """SELECT token, time, f0, intensity, coalesce(f0 <> 0 AND intensity < max(CASE WHEN f0 IS NOT NULL AND f0 <> 0 THEN intensity END) OVER (PARTITION BY token) - 15, false) AS flag_low_intensity FROM frames""", "time f0")
def _(spark, sf_dir):
    return I.flag_low_intensity(event_frames(spark, sf_dir)).select("token", "time", "f0", "intensity", "flag_low_intensity")


@query("w4_flag_pitch_jumps", jumps_sql() + " SELECT token, time, f0, flagged_jump, jump_note FROM jumps", "time f0")
def _(spark, sf_dir):
    return I.flag_pitch_jumps(event_frames(spark, sf_dir)).select("token", "time", "f0", "flagged_jump", "jump_note")


@query("w5_carryover_even_steps", jumps_sql() + " SELECT token, time, f0, flagged_jump, jump_note FROM jumps", "time f0", base=ORDER_FRAMES)
def _(spark, sf_dir):
    return I.flag_pitch_jumps(order_frames(spark, sf_dir)).select("token", "time", "f0", "flagged_jump", "jump_note")


@query("w6_inspect_f0", INSPECTED + " SELECT * FROM ins", "time f0 f0_token_max f0_token_min f0_token_mean f0_token_sd")
def _(spark, sf_dir):
    return _inspected(spark, sf_dir)


@query("w8_w9_frame_positions", """SELECT token, time, row_number() OVER w AS frame_index, 100.0::DOUBLE * (row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY token) - 1, 0) AS frame_pct
  FROM frames WINDOW w AS (PARTITION BY token ORDER BY time)""", "time frame_pct")
def _(spark, sf_dir):
    return S.frame_positions(event_frames(spark, sf_dir)).select("token", "time", "frame_index", "frame_pct")


@query("a8_inspection_summary", INSPECTED + """, per AS (
  SELECT token, bool_or(flagged_token) AS t, bool_or(regexp_matches(flag_notes, 'max too high|min too low')) AS e, bool_or(regexp_matches(flag_notes, 'level too')) AS l, bool_or(flagged_jump) AS j, count(*) FILTER (flagged_jump) AS nj, count(*) AS n FROM ins GROUP BY token
), one AS (SELECT count(*) AS n_tokens, sum(n)::BIGINT AS n_samples, count(*) FILTER (t) AS tokens_flagged, count(*) FILTER (e) AS by_extreme, count(*) FILTER (l) AS by_level, count(*) FILTER (j) AS by_jump, sum(nj)::BIGINT AS samples_flagged FROM per)
SELECT *, round(100.0::DOUBLE * tokens_flagged / n_tokens, 1) AS pct_tokens_flagged, round(100.0::DOUBLE * samples_flagged / n_samples, 1) AS pct_samples_flagged FROM one""")
def _(spark, sf_dir):
    return I.inspection_summary(_inspected(spark, sf_dir))


@query("a9_flagged_by_tone", INSPECTED + """, per AS (SELECT tone, token, coalesce(bool_or(flagged_token), false) AS f FROM ins GROUP BY 1, 2)
SELECT tone, count(*) FILTER (f) AS flagged, count(*) AS total FROM per GROUP BY tone""")
def _(spark, sf_dir):
    return I.flagged_by_tone(_inspected(spark, sf_dir))


@query("a9_small_groups", "SELECT speaker, tone, count(DISTINCT token) AS n_tokens FROM frames GROUP BY 1, 2 HAVING count(DISTINCT token) < 12")
def _(spark, sf_dir):
    return I.small_groups(event_frames(spark, sf_dir), min_tokens=12)


@query("a19_flag_classes", INSPECTED + " SELECT token, " + ", ".join(f"coalesce(bool_or(regexp_matches(flag_notes, '{p}')), false) AS has_{c}" for c, p in I.CLASSES.items()) + " FROM ins GROUP BY token")
def _(spark, sf_dir):
    return I.flag_classes(_inspected(spark, sf_dir))


@query("a20_flagged_frames", INSPECTED + """ SELECT token, count(*) AS n, string_agg(concat(round(time, 3)::DECIMAL(18, 3)::VARCHAR, ' ', flag_notes), '|' ORDER BY time) AS frames FROM ins WHERE flagged_jump GROUP BY token""")
def _(spark, sf_dir):
    f = I.flagged_frames(_inspected(spark, sf_dir))
    return f.select("token", F.size("frames").cast("long").alias("n"), F.array_join(F.transform("frames", lambda x: F.concat(rounded_as_sql(x["time"], 3).cast("decimal(18,3)").cast("string"), F.lit(" "), x["note"])), "|").alias("frames"))


@query("p9_flagged_tokens", INSPECTED + " SELECT DISTINCT token FROM ins WHERE flagged_token AND length(token) > 0")
def _(spark, sf_dir):
    return I.flagged_tokens(_inspected(spark, sf_dir))


@query("p10_flagged_only", INSPECTED + " SELECT token, time, f0, flag_notes FROM ins WHERE flagged_token", "time f0")
def _(spark, sf_dir):
    return _inspected(spark, sf_dir).filter("flagged_token").select("token", "time", "f0", "flag_notes")


@query("p11_offer_bulk_triage", INSPECTED + """, per AS (SELECT tone, token, coalesce(bool_or(flagged_token), false) AS f FROM ins GROUP BY 1, 2), n AS (SELECT tone, count(*) * 10 AS n_tokens, count(*) FILTER (f) AS n_flagged FROM per GROUP BY tone)
SELECT tone, n_tokens >= 1000 AND n_flagged > 0 AND n_flagged / n_tokens::DOUBLE <= 0.15 AS offered FROM n""")
def _(spark, sf_dir):
    t = I.flagged_by_tone(_inspected(spark, sf_dir))
    return t.select("tone", I.offer_bulk_triage(10 * F.col("total"), F.col("flagged")).alias("offered"))


@query("p4_voiced_predicates", "SELECT token, count(*) FILTER (f0 > 0) AS n_voiced, count(*) FILTER (f0 IS NOT NULL AND f0 <> 0) AS n_sounded FROM frames GROUP BY token")
def _(spark, sf_dir):
    return event_frames(spark, sf_dir).groupBy("token").agg(F.count_if(X.voiced("f0")).alias("n_voiced"), F.count_if(X.sounded("f0")).alias("n_sounded"))


TRIMMED = """v0 AS (SELECT *, coalesce(f0 > 0, false) AS v, row_number() OVER (PARTITION BY token ORDER BY time) AS rn FROM frames),
v1 AS (SELECT *, CASE WHEN v THEN rn - sum(v::INT) OVER (PARTITION BY token ORDER BY time ROWS UNBOUNDED PRECEDING) END AS run FROM v0),
v2 AS (SELECT *, CASE WHEN v THEN count(*) OVER (PARTITION BY token, run, v) END AS len FROM v1),
v3 AS (SELECT *, coalesce(min(CASE WHEN len >= 2 THEN rn END) OVER t, min(CASE WHEN v THEN rn END) OVER t) AS lo, coalesce(max(CASE WHEN len >= 2 THEN rn END) OVER t, max(CASE WHEN v THEN rn END) OVER t) AS hi FROM v2 WINDOW t AS (PARTITION BY token)),
trimmed AS (SELECT token, time, f0, intensity, speaker, tone, item FROM v3 WHERE rn BETWEEN lo AND hi)"""


@query("p5_trim_to_voiced", TRIMMED + " SELECT * FROM trimmed", "time f0")
def _(spark, sf_dir):
    return R.trim_to_voiced(event_frames(spark, sf_dir))


@query("a5_token_summary", """SELECT token, count(*) AS n_frames, count(*) FILTER (f0 > 0) AS n_voiced, count(*) FILTER (NOT coalesce(f0 > 0, false)) AS n_unvoiced, round(avg(f0) FILTER (f0 > 0) + 1e-9, 2) AS mean_f0, round(min(f0) FILTER (f0 > 0) + 1e-9, 2) AS min_f0,
  round(max(f0) FILTER (f0 > 0) + 1e-9, 2) AS max_f0, round(max(time) - min(time) + 1e-9, 3) AS duration_s, round(avg(intensity) + 1e-9, 1) AS mean_intensity FROM frames GROUP BY token""")
def _(spark, sf_dir):
    return S.token_summary(event_frames(spark, sf_dir))


@query("a6_voiced_share", TRIMMED + """, w AS (SELECT token, max(time) - min(time) AS duration_s FROM frames GROUP BY token), i AS (SELECT token, max(time) - min(time) AS voiced_s FROM trimmed GROUP BY token),
t AS (SELECT w.token, duration_s, coalesce(voiced_s, 0.0::DOUBLE) AS voiced_s, coalesce(voiced_s, 0.0::DOUBLE) / nullif(duration_s, 0) AS voiced_prop FROM w LEFT JOIN i ON i.token IS NOT DISTINCT FROM w.token)
SELECT t.*, coalesce(n >= 4 AND voiced_prop < 0.5 * mid, false) AS low_voiced FROM t, (SELECT median(voiced_prop) AS mid, count(voiced_prop) AS n FROM t)""", "duration_s voiced_s voiced_prop")
def _(spark, sf_dir):
    return S.voiced_share(event_frames(spark, sf_dir))


@query("a7_flag_f0_gaps", """g0 AS (SELECT *, coalesce(f0 > 0, false) AS v, min(CASE WHEN f0 > 0 THEN time END) OVER t AS a, max(CASE WHEN f0 > 0 THEN time END) OVER t AS b FROM frames WINDOW t AS (PARTITION BY token))
SELECT token, time, f0, (sum((NOT v)::INT) OVER t)::BIGINT AS n_missing, coalesce(bool_or(NOT v AND time > a AND time < b) OVER t, false) AS has_gap FROM g0 WINDOW t AS (PARTITION BY token)""", "time f0")
def _(spark, sf_dir):
    return R.flag_f0_gaps(event_frames(spark, sf_dir)).select("token", "time", "f0", "n_missing", "has_gap")


ATTACHED = INTERVALS + """, num AS (
  SELECT *, CASE WHEN length(trim(label)) > 0 THEN sum((length(trim(label)) > 0)::INT) OVER (PARTITION BY token, tier ORDER BY t1 ROWS UNBOUNDED PRECEDING) END AS i FROM intervals
), att0 AS (
  SELECT f.*, n.label, n.t1, n.t2, n.i, row_number() OVER (PARTITION BY f.token, f.time ORDER BY n.t1 DESC) AS rn FROM frames f LEFT JOIN num n ON n.token = f.token AND n.t1 <= f.time
), att AS (
  SELECT token, time, f0, CASE WHEN time <= t2 THEN label END AS rime_1, CASE WHEN time <= t2 THEN t1 END AS rime_1_start, CASE WHEN time <= t2 THEN t2 END AS rime_1_end, CASE WHEN time <= t2 THEN i END::BIGINT AS rime_1_i FROM att0 WHERE rn = 1
)"""


def _attached(spark, sf_dir):
    frames = event_frames(spark, sf_dir)
    return R.attach_intervals(frames.select("token", "time", "f0"), event_intervals(frames), ["Rime 1"])


@query("j5_attach_intervals", ATTACHED + " SELECT * FROM att", "time f0 rime_1_start rime_1_end")
def _(spark, sf_dir):
    return _attached(spark, sf_dir)


@query("w13_segment_ordinal", ATTACHED + " SELECT token, tier, t1, t2, label, i::BIGINT AS i FROM num", "t1 t2")
def _(spark, sf_dir):
    return R.number_intervals(event_intervals(event_frames(spark, sf_dir))).drop("place")


for _mode, _sql in (("vowel", "rime_1 = 'a'"), ("labels", "trim(rime_1) IN ('t', 'n')"), ("rhyme", "rime_1_i >= 2")):

    @query(f"p6_filter_intervals_{_mode}", ATTACHED + f" SELECT token, time, rime_1, rime_1_i FROM att WHERE {_sql}" + (" AND token IN (SELECT token FROM att WHERE rime_1 = 'a')" if _mode == "rhyme" else ""), "time")
    def _(spark, sf_dir, mode=_mode):
        return R.filter_intervals(_attached(spark, sf_dir), "rime_1", mode, ["t", "n"]).select("token", "time", "rime_1", "rime_1_i")


@query("a18_unlabelled_tokens", ATTACHED + " SELECT token FROM att GROUP BY token HAVING bool_and(length(trim(coalesce(rime_1, ''))) = 0)")
def _(spark, sf_dir):
    return R.unlabelled_tokens(_attached(spark, sf_dir), "rime_1")


@query("a10_discard_breakdown", TOKENS + """, d AS (SELECT coalesce(speaker, '(no metadata)') AS speaker, coalesce(CASE WHEN tone <> 'signup' THEN tone END, '(no metadata)') AS tone, f0_token_max > 180 AS d FROM tok),
c AS (SELECT speaker, tone, count(*) FILTER (d) AS discarded, count(*) AS total, grouping(speaker) AS gs, grouping(tone) AS gt FROM d GROUP BY CUBE (speaker, tone))
SELECT CASE WHEN gs = 1 THEN 'Total' ELSE speaker END AS speaker, CASE WHEN gt = 1 THEN 'Total' ELSE tone END AS tone, discarded, total, concat(discarded, '/', total, ' (', printf('%.1f', 100.0::DOUBLE * discarded / total), '%)') AS cell,
  CASE WHEN discarded = total THEN 'whole group gone' WHEN 100.0::DOUBLE * discarded / total >= 50 THEN 'half or more' ELSE '' END AS grade FROM c""")
def _(spark, sf_dir):
    t = I.token_statistics(event_frames(spark, sf_dir))
    return S.discard_breakdown(t.select("speaker", F.when(F.col("tone") != "signup", F.col("tone")).alias("tone"), (F.col("f0_token_max") > 180).alias("dropped")))


@query("k6_sorted_levels", """l AS (SELECT DISTINCT coalesce(CASE WHEN tone <> 'click' THEN tone END, '(no metadata)') AS level FROM frames) SELECT level, row_number() OVER (ORDER BY level = '(no metadata)', level)::INTEGER AS place FROM l""")
def _(spark, sf_dir):
    return S.sorted_levels(event_frames(spark, sf_dir).withColumn("tone", F.when(F.col("tone") != "click", F.col("tone"))), "tone")


@query("a16_cardinalities", "SELECT count(*) AS n_observations, count(DISTINCT speaker) AS n_speaker, count(DISTINCT token) AS n_token, count(DISTINCT item) AS n_item, count(DISTINCT tone) AS n_tone FROM frames")
def _(spark, sf_dir):
    return S.cardinalities(event_frames(spark, sf_dir), ["speaker", "token", "item", "tone"])


@query("p1_drop_discarded", "SELECT token, time, f0 FROM frames WHERE NOT coalesce(f0 > 200, false)", "time f0")
def _(spark, sf_dir):
    return S.drop_discarded(event_frames(spark, sf_dir).withColumn("token_dropped", F.col("f0") > 200)).select("token", "time", "f0")


@query("p1_discard_counts", "SELECT count(DISTINCT CASE WHEN f0 > 200 THEN token END) AS n_drop, count(DISTINCT token) AS n_tot FROM frames")
def _(spark, sf_dir):
    return S.discard_counts(event_frames(spark, sf_dir).withColumn("token_dropped", F.col("f0") > 200))


@query("x15_part_lines", ATTACHED + " SELECT token, time, concat_ws('##', token, rime_1_i::VARCHAR) AS line_group FROM att WHERE time IS NOT NULL", "time")
def _(spark, sf_dir):
    return S.part_lines(_attached(spark, sf_dir), "rime_1_i").select("token", "time", "line_group")


@query("p3_table_view", "SELECT token, round(time, 2) AS time, round(f0, 1) AS f0 FROM frames WHERE tone = 'click'")
def _(spark, sf_dir):
    return event_frames(spark, sf_dir).filter("tone = 'click'").select("token", F.round("time", 2).alias("time"), F.round("f0", 1).alias("f0"))


@query("k5_preview", "SELECT token, time, f0 FROM frames ORDER BY token, time LIMIT 50", "time f0")
def _(spark, sf_dir):
    return event_frames(spark, sf_dir).select("token", "time", "f0").orderBy("token", "time").limit(50)
