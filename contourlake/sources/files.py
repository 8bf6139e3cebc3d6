"""Readers of frame tables and annotation files, the recording inventory, and sinks.

Annotation files come in through ``binaryFile`` (one row per file) and are taken apart with built-in text
functions, so a folder of any number of files is one distributed scan.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.functions.scalars import token_key

FRAMES = "token string, time double, f0 double, intensity double, speaker string, tone string, item string"
PRAAT = "token string, time double, f0 double, intensity double"
NUMBER = r"([-+0-9.eE]+|--undefined--)"


def read_frames(spark: SparkSession, path: str, schema: str = FRAMES) -> DataFrame:
    """Frames from CSV with a header (``NA`` for missing), or from Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("nullValue", "NA").schema(schema).csv(path)


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """The four-column table that batch extraction writes."""
    return read_frames(spark, path, PRAAT)


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, name (without folder), token (without extension) and content of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return with_names(files).withColumn("content", F.col("content").cast("string"))


def with_names(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.withColumn("name", name).withColumn("token", F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")).withColumn("ext", F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))


def _field(text: str | Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^\s*{re.escape(name)} = {NUMBER}", 1).try_cast("double")


def parse_pitch(files: DataFrame) -> DataFrame:
    """Frames of pitch files: token, time, f0 (first candidate; unvoiced and those from the ceiling on are null), intensity and candidates (those under the ceiling, unvoiced ones too)."""
    head = files.select("token", _field("content", "x1").alias("x1"), _field("content", "dx").alias("dx"), _field("content", "ceiling").alias("ceiling"), F.split("content", r"frames \[\d+\]:").alias("parts"))
    each = head.select("token", "x1", "dx", "ceiling", F.posexplode(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))).alias("i", "part"))
    numbers = lambda name: F.transform(F.regexp_extract_all("part", F.lit(rf"{name} = {NUMBER}"), F.lit(1)), lambda x: x.try_cast("double"))
    pairs = F.zip_with(numbers("frequency"), numbers("strength"), lambda f, s: F.struct(f.alias("frequency"), s.alias("strength")))
    first = F.get(numbers("frequency"), F.lit(0))
    f0 = F.when((first > 0) & (first < F.col("ceiling")), first)
    kept = F.filter(pairs, lambda c: c["frequency"] < F.col("ceiling"))
    return each.select("token", (F.col("x1") + F.col("i") * F.col("dx")).alias("time"), f0.alias("f0"), _field("part", "intensity").alias("intensity"), kept.alias("candidates"))


def parse_pitch_tier(files: DataFrame) -> DataFrame:
    """Frames of sparse pitch tiers: token, time, f0; intensity is null, so they union with pitch files."""
    numbers = lambda name: F.regexp_extract_all("content", F.lit(rf"(?:{name}) = {NUMBER}"), F.lit(1))
    points = F.arrays_zip(numbers("number|time").alias("t"), numbers("value").alias("v"))
    each = files.select("token", F.explode(points).alias("p"))
    return each.select("token", F.col("p.t").try_cast("double").alias("time"), F.col("p.v").try_cast("double").alias("f0"), F.lit(None).cast("double").alias("intensity"))


def pitch_frames(pitch: DataFrame, tiers: DataFrame) -> DataFrame:
    """Frames of both kinds; a token that has a pitch file does not use its tier."""
    a = parse_pitch(pitch)
    b = parse_pitch_tier(tiers).join(pitch.select("token").distinct(), "token", "left_anti")
    return a.unionByName(b, allowMissingColumns=True)


def parse_intervals(files: DataFrame) -> DataFrame:
    """Interval tiers of annotation files: token, tier, t1, t2, label and place, the interval's number in its tier; point tiers are left out."""
    parts = F.split("content", r"item \[\d+\]:")
    tiers = files.select("token", F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("part")).filter(F.col("part").contains('class = "IntervalTier"'))
    text = r'"((?:[^"]|"")*+)"'
    one = rf"intervals \[\d+\]:?\s*xmin = {NUMBER}\s*xmax = {NUMBER}\s*text = {text}"
    take = lambda i: F.regexp_extract_all("part", F.lit(one), F.lit(i))
    each = tiers.select("token", F.regexp_extract("part", f"name = {text}", 1).alias("tier"), F.posexplode(F.arrays_zip(take(1).alias("a"), take(2).alias("b"), take(3).alias("x"))).alias("place", "p"))
    quotes = lambda c: F.replace(c, F.lit('""'), F.lit('"'))
    return each.select("token", quotes(F.col("tier")).alias("tier"), F.col("p.a").try_cast("double").alias("t1"), F.col("p.b").try_cast("double").alias("t2"), quotes(F.col("p.x")).alias("label"), "place")


def interval_tier_names(files: DataFrame, max_read: int = 12) -> list[str]:
    """Sorted names of the interval tiers in a sample of files."""
    few = files.orderBy("token").limit(max_read)
    return [r["tier"] for r in parse_intervals(few).select("tier").distinct().orderBy("tier").collect()]


#: Chunks of a sound file that are looked through for the format and the samples.
MOST_CHUNKS = 64


def _header_of(content: Column | str) -> Column:
    """Rate, bits, channels and bytes of samples from a sound file's bytes: its chunks are walked, whatever stands before the samples."""
    content = F.col(content) if isinstance(content, str) else content
    part = lambda at, n: F.substring(content, at, n)
    number = lambda at, n: F.conv(F.concat(*(F.hex(part(at + i, 1)) for i in reversed(range(n)))), 16, 10).cast("long")
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(13).cast("long").alias("at"), none.alias("sr"), none.alias("bit"), none.alias("channels"), none.alias("bytes"))

    def step(s, _):
        at, name = s["at"].cast("int"), part(s["at"].cast("int"), 4).cast("string")
        size = number(at + 4, 4)
        fmt, data = name == "fmt ", name == "data"
        after = F.struct(
            (s["at"] + 8 + size + size % 2).alias("at"), F.when(fmt, number(at + 12, 4)).otherwise(s["sr"]).alias("sr"), F.when(fmt, number(at + 22, 2)).otherwise(s["bit"]).alias("bit"),
            F.when(fmt, number(at + 10, 2)).otherwise(s["channels"]).alias("channels"), F.when(data, F.least(size, F.col("length") - s["at"] - 7)).otherwise(s["bytes"]).alias("bytes"),
        )
        return F.when(s["bytes"].isNotNull() | (s["at"] + 7 > F.length(content)), s).otherwise(after)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_CHUNKS)), start, step)
    return F.when((part(1, 4).cast("string") == "RIFF") & (part(9, 4).cast("string") == "WAVE"), walked)


def sound_headers(files: DataFrame) -> DataFrame:
    """path and length of sound files (``binaryFile`` without its content, which is then not read) with rate, bits, channels, bytes of samples and how many bytes were read.

    Tasks seek from chunk to chunk and read tens of bytes a file. Files must lie where Arrow can open them (local, HDFS, S3, GCS); elsewhere take
    ``recording_inventory`` of whole contents. Files that are no sound files, or can't be read, have nulls.
    """

    def run(batches):
        for batch in batches:
            paths, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [_seek_header(path, length) for path, length in zip(paths, lengths)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["path", "length", "sr", "bit", "channels", "bytes", "n_read"])

    return files.select("path", "length").mapInArrow(run, "path string, length bigint, sr bigint, bit bigint, channels bigint, bytes bigint, n_read bigint")


def _seek_header(path: str, length: int) -> tuple:
    sr = bit = channels = size = None
    n_read, at = 0, 12
    try:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            head = f.read(12)
            n_read += len(head)
            if head[:4] == b"RIFF" and head[8:] == b"WAVE":
                for _ in range(MOST_CHUNKS):
                    f.seek(at)
                    chunk = f.read(8)
                    n_read += len(chunk)
                    if len(chunk) < 8:
                        break
                    kind, long = struct.unpack("<4sI", chunk)
                    if kind == b"fmt ":
                        body = f.read(16)
                        n_read += len(body)
                        if len(body) == 16:
                            _, channels, sr, _, _, bit = struct.unpack("<HHIIHH", body)
                    if kind == b"data":
                        size = min(long, length - at - 8)
                        break
                    at += 8 + long + long % 2
    except (OSError, pa.ArrowException):
        pass
    return sr, bit, channels, size, n_read


def recording_inventory(files: DataFrame) -> DataFrame:
    """One row per recording name: a path per kind of file, and rate, bits, channels, duration and size from the sound file's header.

    ``files`` has path and length, and either content or what ``sound_headers`` found.
    """
    named = with_names(files)
    wav = F.col("ext") == "wav"
    if "sr" in files.columns:
        rows = named
    else:
        rows = named.withColumn("__h", F.when(wav, _header_of("content"))).withColumns({c: F.col(f"__h.{c}") for c in ("sr", "bit", "channels", "bytes")})
    path = lambda e: F.min(F.when(F.col("ext") == e, F.col("path")))
    g = rows.groupBy(F.col("token").alias("basename")).agg(path("wav").alias("wav_path"), path("textgrid").alias("tg_path"), path("pitch").alias("pitch_path"), path("pitchtier").alias("pitchtier_path"), F.max("sr").alias("sr"), F.max("bit").alias("bit"), F.max("channels").alias("channels"), F.max("bytes").alias("bytes"), F.max(F.when(wav, F.col("length"))).alias("size"))
    frames = F.try_divide(F.col("bytes"), F.col("channels") * F.col("bit") / 8)
    return g.select("basename", "wav_path", "tg_path", "pitch_path", "pitchtier_path", "sr", "bit", F.round(F.try_divide(frames, F.col("sr")), 3).alias("dur"), "channels", F.round(F.col("size") / 1024, 1).alias("wav_size_kb"))


def least_duration(f0_min: float = 75.0) -> float:
    """Shortest recording that pitch can be tracked in: three periods of the lowest pitch."""
    return 3 / f0_min


def screen_recordings(recordings: DataFrame, frames: DataFrame, *, name="basename", dur="dur", f0_min=75.0) -> DataFrame:
    """Recordings without frames, with a status: Unreadable, Too short or OK."""
    status = F.when(F.col(dur).isNull(), "Unreadable").when(F.col(dur) < least_duration(f0_min), "Too short").otherwise("OK")
    have = frames.select(token_key("token").alias("__k")).distinct()
    return recordings.withColumn("__k", token_key(name)).join(have, "__k", "left_anti").select(name, dur, status.alias("status"))


def clean_corpus(data: DataFrame, *, token="token", integers: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a token, integer columns cast (bad text becomes null)."""
    kept = data.filter(F.length(token) > 0)
    return kept.withColumns({c: F.col(c).try_cast("int") for c in integers}) if integers else kept


def write_table(data: DataFrame, path: str, *, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a result as Parquet, or as CSV with a header and ``NA`` for missing."""
    w = data.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.option("header", True).option("nullValue", "NA").csv(path) if fmt == "csv" else w.parquet(path)


#: Name patterns of column roles, best first.
ROLES = {
    "token": (r"^token$", r"^file", r"audio", r"name"),
    "time": (r"_tseq$", r"^time", r"^t$", r"sec"),
    "f0": (r"^f0", r"pitch", r"hz"),
    "speaker": (r"^speaker", r"^spk", r"subject"),
    "tone": (r"^tone", r"categor"),
    "item": (r"^item", r"word", r"char"),
    "intensity": (r"^intensity", r"^int", r"db"),
}


def guess_role(columns: list[str], role: str, fallback: int | None = None) -> str | None:
    """The first column that matches the role's best pattern, else the fallback by place."""
    for pattern in ROLES[role]:
        for c in columns:
            if re.search(pattern, c, re.IGNORECASE):
                return c
    return columns[fallback] if fallback is not None and fallback < len(columns) else None


def segment_sets(columns: list[str]) -> list[str]:
    """Names that have both a start and an end column."""
    return [c[:-6] for c in columns if c.endswith("_start") and c[:-6] + "_end" in columns]
