"""Queries: loading, viewing, picking, exporting; whole decisions, logs and candidates; file headers and column roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from contourlake.operators import correct as E
from contourlake.operators import curate as U
from contourlake.operators import inspect as I
from contourlake.operators import summaries as S
from contourlake.operators import views as V
from contourlake.plans.editing import DROPPED, EDITS, _dropped, edit_table
from contourlake.plans.inspection import ATTACHED, INSPECTED, TOKENS, TRIMMED, _attached, _inspected
from contourlake.plans.registry import query
from contourlake.plans.sql import METADATA
from contourlake.sources import files
from contourlake.sources.adapters import event_frames, speaker_metadata, table


@query("p2_load_projection", """SELECT o_orderkey::VARCHAR AS token, o_totalprice / 1000 AS time, TRY_CAST(CASE WHEN o_orderkey % 10 = 3 THEN 'NA' ELSE (o_orderkey % 300)::VARCHAR END AS DOUBLE) AS f0, o_custkey::DOUBLE AS intensity, o_orderstatus
FROM orders WHERE lower(trim(o_orderkey::VARCHAR)) IN (SELECT lower(trim(regexp_replace(concat(c_custkey * 3, '.wav'), '([^.]+)\\.[A-Za-z0-9]+$', '\\1'))) FROM customer)""", "time", base=None)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 3, "NA").otherwise((F.col("o_orderkey") % 300).cast("string"))
    raw = o.select(F.col("o_orderkey").alias("file"), (F.col("o_totalprice") / 1000).cast("string").alias("sec"), text.alias("hz"), F.col("o_custkey").alias("Intensity"), "o_orderstatus")
    recordings = table(spark, sf_dir, "customer").select(F.concat((F.col("c_custkey") * 3).cast("string"), F.lit(".wav")).alias("basename"))
    return V.load_projection(raw, recordings, token="file", time="sec", f0="hz", keep=("o_orderstatus",))


@query("p3_view", "SELECT token, round(time, 3) AS time, round(intensity, 3) AS intensity FROM frames")
def _(spark, sf_dir):
    return V.view(event_frames(spark, sf_dir), ["token", "time", "intensity"], 3)


@query("p3_table_summary", """SELECT 'f0' AS "column", count(f0) AS n, count(*) FILTER (f0 IS NULL) AS n_missing, count(DISTINCT f0) AS n_distinct, avg(f0) AS mean, stddev_samp(f0) AS sd FROM frames
UNION ALL SELECT 'tone', count(tone), count(*) FILTER (tone IS NULL), count(DISTINCT tone), NULL, NULL FROM frames UNION ALL SELECT 'intensity', count(intensity), count(*) FILTER (intensity IS NULL), count(DISTINCT intensity), avg(intensity), stddev_samp(intensity) FROM frames""", "mean sd")
def _(spark, sf_dir):
    return V.table_summary(event_frames(spark, sf_dir), ["f0", "tone", "intensity"]).drop("min", "max")


EDITED = "touched AS (SELECT DISTINCT token FROM edits)"


@query("p8_pick_tokens", INSPECTED + ", " + DROPPED + """, per AS (SELECT token, coalesce(bool_or(flagged_token), false) AS f, coalesce(bool_or(regexp_matches(flag_notes, 'level too|jump \\\\(')), false) AS c, bool_or(speaker IN ('S1', 'S2', 'S3', 'S4')) AS s, bool_or(tone <> 'click') AS t FROM ins GROUP BY token)
SELECT token FROM per WHERE f AND c AND s AND t AND token NOT IN (SELECT token FROM dropped) AND token NOT IN (SELECT token FROM frames WHERE split_part(token, '_', 1)::INTEGER % 4 = 0)""".replace("\\\\", "\\"))
def _(spark, sf_dir):
    """All filters at once; keys of the flagged tokens written as file names in capitals."""
    ins, f = _inspected(spark, sf_dir), event_frames(spark, sf_dir)
    as_files = lambda d: d.select(F.concat(F.lit(" "), F.upper("token"), F.lit(".WAV")).alias("token"))
    tones = [r[0] for r in f.select("tone").distinct().collect() if r[0] != "click"]
    edited = f.filter(F.split("token", "_")[0].cast("int") % 4 == 0).select("token")
    return V.pick_tokens(ins, flagged=as_files(I.flagged_tokens(ins)), of_class=I.flag_classes(ins).filter("has_level or has_rate"), speakers=["S1", "S2", "S3", "S4"], tones=tones, unedited=edited, kept_without=_dropped(f))


@query("p7_export_region", TRIMMED + ", " + ATTACHED + """ SELECT 'voiced' AS mode, (SELECT count(DISTINCT token) FROM frames) AS n_tokens, (SELECT count(DISTINCT token) FROM trimmed) AS n_kept, (SELECT count(DISTINCT token) FROM frames) - (SELECT count(DISTINCT token) FROM trimmed) AS n_lost, (SELECT count(*) FROM frames) - (SELECT count(*) FROM trimmed) AS n_frames_lost
UNION ALL SELECT 'interval', (SELECT count(DISTINCT token) FROM frames), (SELECT count(DISTINCT token) FROM att WHERE rime_1 = 'a'), (SELECT count(DISTINCT token) FROM frames) - (SELECT count(DISTINCT token) FROM att WHERE rime_1 = 'a'), (SELECT count(*) FROM frames) - (SELECT count(*) FROM att WHERE rime_1 = 'a')
UNION ALL SELECT 'whole', (SELECT count(DISTINCT token) FROM frames), (SELECT count(DISTINCT token) FROM frames), 0, 0""")
def _(spark, sf_dir):
    f, attached = event_frames(spark, sf_dir), _attached(spark, sf_dir)
    one = lambda d, mode, **o: V.region_losses(d, V.export_region(d, mode, **o)).select(F.lit(mode).alias("mode"), "*")
    return one(f, "voiced").unionByName(one(attached, "interval", tier="rime_1")).unionByName(one(f, "whole"))


@query("c9_export", EDITS + ", " + METADATA + ", " + DROPPED + """, kept AS (SELECT * FROM edited WHERE token NOT IN (SELECT token FROM dropped)),
k AS (SELECT *, coalesce(f0 > 0, false) AS v FROM kept), g AS (SELECT token, count(*) FILTER (NOT v) AS n_missing, min(time) FILTER (v) AS lo, max(time) FILTER (v) AS hi, count(*) AS m, min(time) AS t0, max(time) AS t9 FROM k GROUP BY token),
h AS (SELECT g.token, any_value(n_missing) AS n_missing, any_value(m) AS m, any_value(t0) AS t0, any_value(t9) AS t9, coalesce(bool_or(NOT v AND time > lo AND time < hi), false) AS has_gap FROM k JOIN g USING (token) GROUP BY g.token),
p AS (SELECT token, n_missing, has_gap, point, CASE WHEN m = 1 THEN t0 WHEN point = 3 THEN t9 ELSE t0 + (point - 1) * ((t9 - t0) / 2) END AS time FROM h, (VALUES (1), (2), (3)) x(point) WHERE m > 1 OR point = 1),
md AS (SELECT lower(trim(regexp_replace(key, '([^.]+)\\.[A-Za-z0-9]+$', '\\1'))) AS mkey, line, dialect FROM metadata)
SELECT p.token, point, p.time, n_missing, has_gap, line, dialect FROM p LEFT JOIN md ON mkey = lower(trim(p.token))""", "time")
def _(spark, sf_dir):
    """Corrected f0, discards out, gap flags on native frames, three points a token, metadata."""
    f = event_frames(spark, sf_dir)
    out = V.export(f, E.scale_frames(f, edit_table(f)), _dropped(f), speaker_metadata(spark, sf_dir).select("key", "line", "dialect"), mode="whole", n=3)
    return out.select("token", "point", "time", "n_missing", "has_gap", "line", "dialect")


@query("c9_export_f0", TRIMMED + """, s AS (SELECT token, arg_min(f0, time) AS first, arg_max(f0, time) AS last, count(*) AS m FROM trimmed GROUP BY token)
SELECT token, 1 AS point, first AS f0 FROM s UNION ALL SELECT token, 2, last FROM s WHERE m > 1""", "f0")
def _(spark, sf_dir):
    """The ends of the voiced region as two even points."""
    return V.export(event_frames(spark, sf_dir), mode="voiced", n=2).select("token", "point", "f0")


CANDIDATES = """cand AS (SELECT *, (l_partkey % 5)::INTEGER AS choice FROM lineitem)"""


@query("j12_e3_pick_candidates", """WITH f AS (SELECT l_orderkey::VARCHAR AS token, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS frame, l_quantity::DOUBLE AS q, (l_partkey % 5)::INTEGER AS choice FROM lineitem),
p AS (SELECT *, CASE choice WHEN 1 THEN q + 0.04 WHEN 2 THEN q * 2 WHEN 3 THEN 0.0::DOUBLE END AS pick FROM f)
SELECT token, frame, CASE WHEN pick IS NULL OR abs(pick - q) <= 0.05 THEN q WHEN pick > 0 THEN pick END AS f0 FROM p""", "f0", base=None)
def _(spark, sf_dir):
    from pyspark.sql.window import Window

    li = table(spark, sf_dir, "lineitem")
    frame = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = li.select(F.col("l_orderkey").cast("string").alias("token"), frame.alias("frame"), F.col("l_quantity").cast("double").alias("f0"), (F.col("l_partkey") % 5).cast("int").alias("choice"))
    one = lambda hz: F.struct(hz.alias("frequency"), F.lit(0.5).alias("strength"))
    candidates = rows.select("token", "frame", F.array(one(F.col("f0") + 0.04), one(F.col("f0") * 2), one(F.lit(0.0))).alias("candidates"))
    return E.pick_candidates(rows.drop("choice"), candidates, rows.filter("choice > 0").select("token", "frame", "choice"))


@query("e3_replay_pick", """n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS rn FROM frames)
SELECT token, time, CASE WHEN rn = 2 AND tone = 'view' THEN CASE WHEN coalesce(abs(f0 - 150) <= 0.05, false) THEN f0 ELSE 150 END WHEN rn = 2 AND tone = 'error' THEN CASE WHEN coalesce(f0 = 0, false) THEN f0 END ELSE f0 END AS f0 FROM n""", "time f0")
def _(spark, sf_dir):
    """Picks go through the replay: 150 Hz for views, the unvoiced candidate for errors."""
    f = event_frames(spark, sf_dir)
    value = F.when(F.col("tone") == "view", 150.0).otherwise(0.0)
    edits = f.filter("tone in ('view', 'error')").select(F.lit(1).alias("seq"), "token", F.array(F.lit(2)).alias("frame_indices"), F.lit("pick").alias("action"), value.alias("value")).distinct()
    return E.replay(f, edits).select("token", "time", "f0")


@query("e1_repeated_edits", """n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS rn FROM frames) SELECT token, time, CASE WHEN rn = 2 THEN CASE WHEN tone = 'view' THEN f0 * 2 * 2 / 2 ELSE 120 / 2 END WHEN rn = 3 AND tone = 'view' THEN f0 * 2 ELSE f0 END AS f0 FROM n""", "time f0")
def _(spark, sf_dir):
    """Several edits of one frame and indices listed twice: the number of frames stays."""
    f = event_frames(spark, sf_dir)
    tokens = f.select("token", "tone").distinct()
    e = lambda d, seq, i, action, value: d.select(F.lit(seq).alias("seq"), "token", F.array(*map(F.lit, i)).alias("frame_indices"), F.lit(action).alias("action"), F.lit(value).cast("double").alias("value"))
    views, others = tokens.filter("tone = 'view'"), tokens.filter("tone <> 'view'")
    edits = e(views, 3, (2, 2), "halve", None).unionByName(e(views, 1, (2, 3), "double", None)).unionByName(e(views, 2, (2,), "double", 0)).unionByName(e(others, 1, (2,), "set", 120)).unionByName(e(others, 2, (2,), "halve", 1))
    return E.scale_frames(f, edits).select("token", "time", "f0")


TWO_DECISIONS = """d AS (SELECT token, seq, label, excluded, note FROM (SELECT DISTINCT token, split_part(token, '_', 1)::INTEGER AS n FROM frames),
  (VALUES (1), (2)) s(seq), LATERAL (SELECT CASE WHEN seq = 1 THEN 'Z' ELSE 'A' END AS label, (n + seq) % 3 = 0 AS excluded, CASE WHEN seq = 2 THEN 'late' END AS note) WHERE n % 2 = 0 OR seq = 2)"""


def _two_decisions(f):
    """One or two decisions a token, the later of which would come first by label."""
    t = f.select("token", F.split("token", "_")[0].cast("int").alias("n")).distinct().withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).filter("n % 2 = 0 or seq = 2")
    return t.select("token", "seq", F.when(F.col("seq") == 1, "Z").otherwise("A").alias("label"), ((F.col("n") + F.col("seq")) % 3 == 0).alias("excluded"), F.when(F.col("seq") == 2, "late").alias("note"))


@query("j6_first_decision", TWO_DECISIONS + ", f1 AS (SELECT token, arg_min(struct_pack(label := label, excluded := excluded, note := note), seq) AS d FROM d GROUP BY token) SELECT f.token, time, d.label AS tone_relabelled, d.excluded AS excluded, d.note AS note FROM frames f LEFT JOIN f1 USING (token)", "time")
def _(spark, sf_dir):
    """The first decision of a token counts as a whole."""
    f = event_frames(spark, sf_dir)
    return U.apply_decisions(f, _two_decisions(f), order="seq").select("token", "time", "tone_relabelled", "excluded", "note")


@query("a15_curation_log", TWO_DECISIONS + """, one AS (SELECT token, label, excluded, note FROM d WHERE seq = 2), log AS (SELECT token, concat('2024-01-0', seq) AS date FROM d)
SELECT coalesce((SELECT max(date) FROM log WHERE log.token = one.token AND log.token NOT LIKE '%click'), '') AS date, token, (SELECT min(speaker) FROM frames f WHERE f.token = one.token) AS speaker, (SELECT min(tone) FROM frames f WHERE f.token = one.token) AS original_tone,
  CASE WHEN excluded THEN 'relabel + exclude' ELSE 'relabel' END AS action, label AS new_label, excluded, note FROM one""")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    d = _two_decisions(f)
    log = d.filter("not endswith(token, 'click')").select("token", F.concat(F.lit("2024-01-0"), F.col("seq").cast("string")).alias("date"))
    return U.curation_state(f, d.filter("seq = 2").drop("seq"), log)


@query("a15_curation_totals", TWO_DECISIONS + ", one AS (SELECT * FROM d WHERE seq = 2) SELECT count(label) AS n_relabelled, count(*) FILTER (excluded) AS n_excluded, count(note) AS n_notes, (SELECT count(DISTINCT token) FROM frames) AS n_tokens FROM one")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return U.curation_totals(f, _two_decisions(f).filter("seq = 2").drop("seq"))


ANNOTATED = """ann AS (SELECT concat(' ', token) AS token, tone, CASE split_part(token, '_', 1)::INTEGER % 4 WHEN 0 THEN tone WHEN 1 THEN ' new' WHEN 2 THEN '' END AS tone_relabelled, CASE split_part(token, '_', 1)::INTEGER % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' END AS excluded,
  CASE split_part(token, '_', 1)::INTEGER % 3 WHEN 0 THEN 'NA' WHEN 1 THEN ' hm ' END AS note FROM (SELECT DISTINCT token, tone FROM frames)),
dec AS (SELECT trim(token) AS token, CASE WHEN trim(tone_relabelled) <> '' AND trim(tone_relabelled) <> tone THEN trim(tone_relabelled) END AS label, coalesce(excluded = 'TRUE', false) AS excluded, CASE WHEN trim(note) NOT IN ('', 'NA') THEN trim(note) END AS note FROM ann),
here AS (SELECT * FROM dec WHERE token IN (SELECT token FROM frames WHERE tone <> 'view'))"""


def _annotated(f):
    n = F.split("token", "_")[0].cast("int")
    t = f.select("token", "tone").distinct()
    return t.select(F.concat(F.lit(" "), "token").alias("token"), "tone", F.when(n % 4 == 0, F.col("tone")).when(n % 4 == 1, " new").when(n % 4 == 2, "").alias("tone_relabelled"), F.when(n % 5 == 0, "TRUE").when(n % 5 == 1, "no").alias("excluded"), F.when(n % 3 == 0, "NA").when(n % 3 == 1, " hm ").alias("note"))


@query("c11_resume_present", ANNOTATED + " SELECT * FROM here WHERE label IS NOT NULL OR excluded OR note IS NOT NULL")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return U.resume(_annotated(f), f.filter("tone <> 'view'"))


@query("c11_resume_counts", ANNOTATED + " SELECT (SELECT count(*) FROM dec) AS n_annotated, count(*) AS n_matched, count(label) AS n_relabelled, count(*) FILTER (excluded) AS n_excluded, count(note) AS n_notes FROM here")
def _(spark, sf_dir):
    f = event_frames(spark, sf_dir)
    return U.resume_counts(_annotated(f), f.filter("tone <> 'view'"))


@query("a20_low_intensity_times", "loud AS (SELECT token, max(intensity) FILTER (f0 > 0) AS m FROM frames GROUP BY token) SELECT f.token, count(*) AS n, sum(time) AS total FROM frames f JOIN loud USING (token) WHERE f0 > 0 AND intensity < m - 15 GROUP BY f.token", "total")
def _(spark, sf_dir):
    low = I.low_intensity_times(I.flag_low_intensity(event_frames(spark, sf_dir)))
    return low.select("token", F.size("times").cast("long").alias("n"), F.aggregate("times", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("a10_one_margin", TOKENS + """, d AS (SELECT coalesce(CASE WHEN tone <> 'signup' THEN tone END, '(no metadata)') AS g, f0_token_max > 180 AS d FROM tok), c AS (SELECT g, count(*) FILTER (d) AS discarded, count(*) AS total FROM d GROUP BY g UNION ALL SELECT 'Total', count(*) FILTER (d), count(*) FROM d)
SELECT g AS "group", discarded, total, concat(discarded, '/', total, ' (', printf('%.1f', 100.0::DOUBLE * discarded / total), '%)') AS cell, CASE WHEN discarded = total THEN 'whole group gone' WHEN 100.0::DOUBLE * discarded / total >= 50 THEN 'half or more' ELSE '' END AS grade FROM c""")
def _(spark, sf_dir):
    t = I.token_statistics(event_frames(spark, sf_dir))
    return S.discard_breakdown(t.select(F.when(F.col("tone") != "signup", F.col("tone")).otherwise("").alias("tone"), (F.col("f0_token_max") > 180).alias("dropped")), speaker=None)


@query("s6_recording_inventory", """SELECT o_orderkey::VARCHAR AS basename, concat('/rec/', o_orderkey, '.wav') AS wav_path, CASE WHEN o_orderkey % 2 = 0 THEN concat('/rec/', o_orderkey, '.TextGrid') END AS tg_path, 8000 + o_custkey % 7 AS sr, 16::BIGINT AS bit, 1 + o_custkey % 2 AS channels,
round((1000 + o_orderkey % 997) / (8000 + o_custkey % 7)::DOUBLE, 3) AS dur FROM orders""", "dur", base=None)
def _(spark, sf_dir):
    """Sound files' first bytes made from the orders: an extra chunk, of odd size for some, stands before the format or between it and the samples."""
    o = table(spark, sf_dir, "orders")
    key, rate, channels = F.col("o_orderkey"), 8000 + F.col("o_custkey") % 7, 1 + F.col("o_custkey") % 2
    little = lambda v, n: F.concat(*(F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(n)))
    mark = lambda t: F.lit(t.encode().hex())
    size, extra = (1000 + key % 997) * channels * 2, key % 31
    fmt = F.concat(mark("fmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), F.lit("00" * 6), little(F.lit(16), 2))
    more = F.concat(mark("LIST"), little(extra, 4), F.repeat(F.lit("64"), (extra + extra % 2).cast("int")))
    head = F.concat(mark("RIFF"), F.lit("00" * 4), mark("WAVE"), F.when(key % 3 == 0, F.concat(more, fmt)).when(key % 3 == 1, F.concat(fmt, more)).otherwise(fmt), mark("data"), little(size, 4))
    sounds = o.select(F.concat(F.lit("/rec/"), key.cast("string"), F.lit(".wav")).alias("path"), (size + F.length(head) / 2).cast("long").alias("length"), F.unhex(head).alias("content"))
    tiers = o.filter(key % 2 == 0).select(F.concat(F.lit("/rec/"), key.cast("string"), F.lit(".TextGrid")).alias("path"), F.lit(10).cast("long").alias("length"), F.unhex(F.lit("00")).alias("content"))
    return files.recording_inventory(sounds.unionByName(tiers)).select("basename", "wav_path", "tg_path", "sr", "bit", "channels", "dur")


@query("s10_column_roles", "SELECT token, time, f0, speaker, tone FROM frames", "time f0")
def _(spark, sf_dir):
    """Columns of other names found by their roles."""
    f = event_frames(spark, sf_dir).select(F.col("item").alias("word"), F.col("tone").alias("Tone_category"), F.col("speaker").alias("subject_id"), F.col("f0").alias("Pitch"), F.col("time").alias("t"), F.col("token").alias("FileName"), F.lit(0.0).alias("rime_start"), F.lit(1.0).alias("rime_end"))
    if files.segment_sets(f.columns) != ["rime"]:
        raise ValueError("segment sets not found")
    return f.select(*(F.col(files.guess_role(f.columns, role)).alias(role) for role in ("token", "time", "f0", "speaker", "tone")))
