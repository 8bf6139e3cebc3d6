"""Benchmark tables read as frames (one row per pitch sample), intervals, metadata, decisions and edits.

Each adapter has equal SQL in ``contourlake.plans.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one part where windows run over tokens: a task's memory goes by this, not by the size of the input.
ROWS_PER_PART = 1_000_000


def spread(data: DataFrame, key: str, rows: int) -> DataFrame:
    """The data dealt by the key to as many parts as the number of rows asks for; as it is, where the session's own number of parts is enough."""
    parts = -(-rows // ROWS_PER_PART)
    return data.repartition(parts, key) if parts > int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")) else data


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from the event stream: a token is a user's events of one type, at irregular times; some are unvoiced throughout."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user = F.col("user_id")
    f0 = F.when((user % 50 == 7) | (F.col("k") % 11 == 0), F.lit(None).cast("double")).when(F.col("k") % 9 == 0, 0.0).otherwise(100 + F.col("value"))
    seconds = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts)") / 1e6
    return e.select(
        F.concat_ws("_", user.cast("string"), "event_type").alias("token"), seconds.alias("time"), f0.alias("f0"), (40.0 + F.col("k")).alias("intensity"),
        F.concat(F.lit("S"), (user % 13).cast("string")).alias("speaker"), F.col("event_type").alias("tone"), (user % 40).cast("string").alias("item"),
    )


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from order lines: a token is an order, its lines stand at even steps of 10 ms. Lines are dealt by token once, for the steps that follow too."""
    w = Window.partitionBy("token").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem")
    li = spread(li.withColumn("token", F.col("l_orderkey").cast("string")), "token", li.count()).withColumn("rn", F.row_number().over(w))
    f0 = F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("double")).otherwise(80 + F.col("l_extendedprice") / 400)
    return li.select(
        "token", (F.col("rn") * 0.01).alias("time"), f0.alias("f0"), (40 + F.col("l_quantity")).alias("intensity"),
        F.concat(F.lit("S"), (F.col("l_orderkey") % 13).cast("string")).alias("speaker"), F.concat(F.lit("T"), (F.col("l_orderkey") % 5).cast("string")).alias("tone"), (F.col("l_orderkey") % 40).cast("string").alias("item"),
    )


#: Cuts of a token's time range and the label of each part; a blank label is silence.
PARTS = ((0.0, 0.1013579, ""), (0.1013579, 0.3517283, "t"), (0.3517283, 0.7012467, "a"), (0.7012467, 0.9531357, "n"), (0.9531357, 1.0, ""))


def event_intervals(frames: DataFrame) -> DataFrame:
    """An interval tier per token: its time range cut at fixed fractions, for every token that is not a view; ``place`` is an interval's number in its tier."""
    spans = frames.filter("tone <> 'view'").groupBy("token").agg(F.min("time").alias("t0"), F.max("time").alias("t9"))
    parts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("label")) for a, b, x in PARTS))
    at = lambda c: F.col("t0") + (F.col("t9") - F.col("t0")) * F.col(c)
    cut = spans.select("token", "t0", "t9", F.posexplode(parts).alias("place", "p")).select("token", "t0", "t9", "place", "p.*")
    return cut.select("token", F.lit("Rime 1").alias("tier"), at("a").alias("t1"), at("b").alias("t2"), "label", "place")


def speaker_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with a key per token: from customers, several rows for some keys."""
    c = table(spark, sf_dir, "customer")
    return c.filter("c_custkey % 3 <> 0").select(F.concat(F.lit(" "), (F.col("c_custkey") % 500).cast("string"), F.lit("_Purchase.WAV")).alias("key"), F.col("c_custkey").alias("line"), (F.col("c_nationkey") % 5).cast("string").alias("dialect"), F.lit("x").alias("tone"))


def decisions(frames: DataFrame) -> DataFrame:
    """Curation decisions: some tokens get a new label, some are excluded, some have a note."""
    n = F.split("token", "_")[0].cast("int") + 3 * F.length("token")
    t = frames.select("token").distinct()
    label = F.when(n % 7 == 0, F.concat(F.lit("L"), (n % 4).cast("string")))
    return t.filter((n % 7 == 0) | (n % 11 == 0) | (n % 13 == 0)).select("token", label.alias("label"), (n % 11 == 0).alias("excluded"), F.when(n % 13 == 0, "listen again").alias("note"))
