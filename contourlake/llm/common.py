"""Helpers shared by the operators: table reading, shared scratch folder, batch slicing, sampling."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A slice of texts handled at once inside a task holds about this many bytes (one longer text is its own slice).
SLICE_BYTES = 3_000_000

_OWN_DIR: dict[str, str] = {}


#: Most rows and bytes in an Arrow batch of texts: whole documents are long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def text_rows(df: DataFrame, *columns) -> DataFrame:
    """The given columns of a table, in batches small enough for whole texts.

    Spark reads the sizes of batches from the session when it plans a job, so they stay set there, never above what the session had.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _size(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df.select(*columns)


def _size(text: str) -> int:
    """A setting's number of rows or bytes; unreadable ones (with a unit) count as unlimited."""
    return int(text.rstrip("bB")) if text.rstrip("bB").lstrip("-").isdigit() else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode alone, one temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _OWN_DIR["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one of this many rows meets its statistics by broadcast: at most as many keys can.
HOT_KEYS = 10_000


def join_stats(rows: DataFrame, stats: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with the statistics of their key: one row a key, its column ``n`` (dropped) how many of the ``total`` rows have it.

    Keys with more than a share of 1 / HOT_KEYS of all rows are joined by broadcast, so that no task gets all rows
    of a frequent key; there are at most HOT_KEYS of them, whatever the data. All others are joined by a shuffle.
    """
    least = max(20, total // HOT_KEYS)
    hot, cold = stats.filter(F.col("n") > least).drop("n"), stats.filter(F.col("n") <= least).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def hash_fraction(seed: int, *columns: str) -> Column:
    """A repeatable number in [0, 1) made from the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def text_slices(batches, columns):
    """Cut Arrow batches into slices of about SLICE_BYTES of text: yields one Arrow array per column. The first column is the text."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(cols[0]), 0)), dtype=np.int64)
        start = 0
        while start < len(size):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            yield [c.slice(start, end - start) for c in cols]
            start = end


def record_batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
