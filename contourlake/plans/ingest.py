"""Queries: files written from the tables and read back, inventories and screens."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.plans.registry import query
from contourlake.plans.sql import INTERVALS
from contourlake.sources import files as S
from contourlake.sources.adapters import event_frames, event_intervals, table


def _scratch(spark) -> str:
    """A new folder in spark.checkpoint.dir, or, in local mode alone, in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-files-", dir="/tmp")
    return f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("s1_s9_csv_round_trip", "SELECT * FROM frames", "time f0")
def _(spark, sf_dir):
    path = _scratch(spark) + "/frames.csv"
    S.write_table(event_frames(spark, sf_dir), path, fmt="csv")
    return S.read_frames(spark, path)


@query("s2_batch_csv", "SELECT token, time, f0, intensity FROM frames WHERE tone = 'click'", "time f0")
def _(spark, sf_dir):
    path = _scratch(spark) + "/batch.csv"
    S.write_table(event_frames(spark, sf_dir).filter("tone = 'click'").select("token", "time", "f0", "intensity"), path, fmt="csv")
    return S.read_batch_csv(spark, path)


@query("s9_partitioned_parquet", "SELECT speaker, count(*) AS n, count(f0) AS known FROM frames GROUP BY speaker")
def _(spark, sf_dir):
    path = _scratch(spark) + "/by-speaker.parquet"
    S.write_table(event_frames(spark, sf_dir), path, partition_by=("speaker",))
    return S.read_frames(spark, path).groupBy("speaker").agg(F.count("*").alias("n"), F.count("f0").alias("known"))


@query("s5_interval_files", INTERVALS + " SELECT * FROM intervals", "t1 t2")
def _(spark, sf_dir):
    """Annotation files made from the interval tiers as text, and taken apart again."""
    iv = event_intervals(event_frames(spark, sf_dir))
    w = F.row_number().over(Window.partitionBy("token").orderBy("t1"))
    line = F.concat(F.lit("        intervals ["), w.cast("string"), F.lit("]:\n            xmin = "), F.col("t1").cast("string"), F.lit(" \n            xmax = "), F.col("t2").cast("string"), F.lit(' \n            text = "'), "label", F.lit('" \n'))
    text = iv.withColumn("line", line).groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t1", "line"))), lambda x: x["line"]), "").alias("body"))
    head = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nitem []: \n    item [1]:\n        class = "IntervalTier" \n        name = "Rime 1" \n'
    tail = '    item [2]:\n        class = "TextTier" \n        name = "marks" \n        points [1]:\n            number = 1 \n            mark = "x" \n'
    return S.parse_intervals(text.select("token", F.concat(F.lit(head), "body", F.lit(tail)).alias("content"))).drop("place")


@query("s3_s4_pitch_files", """n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY time) AS i, split_part(token, '_', 1)::INTEGER % 2 = 0 AS even FROM frames)
SELECT token, CASE WHEN even THEN 0.02::DOUBLE + (i - 1) * 0.01 ELSE i::DOUBLE END AS time, CASE WHEN even THEN CASE WHEN f0 > 0 AND f0 < 150 THEN f0 END ELSE coalesce(f0, 0) END AS f0, CASE WHEN even THEN intensity END AS intensity, CASE WHEN even THEN 1 + (coalesce(f0, 0) < 150)::INTEGER END AS n_candidates FROM n""", "time f0")
def _(spark, sf_dir):
    """Pitch files (even users) and sparse tiers (all users) made from frames as text, and taken apart again."""
    f = event_frames(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("token").orderBy("time"))).withColumn("hz", F.coalesce("f0", F.lit(0.0)).cast("string"))
    frame = F.concat(F.lit("    frames ["), F.col("i").cast("string"), F.lit("]:\n        intensity = "), F.col("intensity").cast("string"), F.lit(" \n        candidates [1]:\n            frequency = "), "hz", F.lit(" \n            strength = 0.9 \n        candidates [2]:\n            frequency = 0 \n            strength = 0.1 \n"))
    point = F.concat(F.lit("    points ["), F.col("i").cast("string"), F.lit("]:\n        number = "), F.col("i").cast("string"), F.lit(" \n        value = "), "hz", F.lit(" \n"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("x")))), lambda v: v["x"]), "")
    even = F.split("token", "_")[0].cast("int") % 2 == 0
    pitch = f.filter(even).groupBy("token").agg(F.concat(F.lit("xmin = 0 \nxmax = 9 \ndx = 0.01 \nx1 = 0.02 \nceiling = 150 \nframes []: \n"), joined(frame)).alias("content"))
    tiers = f.groupBy("token").agg(F.concat(F.lit("xmin = 0 \npoints: size = 3 \n"), joined(point)).alias("content"))
    return S.pitch_frames(pitch, tiers).select("token", "time", "f0", "intensity", F.size("candidates").alias("n_candidates")).withColumn("n_candidates", F.when(F.col("n_candidates") >= 0, F.col("n_candidates")))


@query("s7_screen_recordings", """SELECT concat(c_custkey, '_click.wav') AS basename, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 50 / 500.0::DOUBLE END AS dur,
  CASE WHEN c_custkey % 9 = 0 THEN 'Unreadable' WHEN c_custkey % 50 / 500.0::DOUBLE < 0.04 THEN 'Too short' ELSE 'OK' END AS status FROM customer WHERE concat(c_custkey, '_click') NOT IN (SELECT token FROM frames)""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    recordings = c.select(F.concat(k.cast("string"), F.lit("_click.wav")).alias("basename"), F.when(k % 9 > 0, k % 50 / 500.0).alias("dur"))
    return S.screen_recordings(recordings, event_frames(spark, sf_dir))


@query("s8_clean_corpus", "SELECT user_id, TRY_CAST(CASE WHEN user_id % 4 = 0 THEN 'x' ELSE user_id::VARCHAR END AS INTEGER) AS position FROM events WHERE user_id % 3 > 0", base=None)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    raw = e.select("user_id", F.when(u % 3 > 0, "t").otherwise("").alias("token"), F.when(u % 4 == 0, "x").otherwise(u.cast("string")).alias("position"))
    return S.clean_corpus(raw, integers=("position",)).select("user_id", "position")
