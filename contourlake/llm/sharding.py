"""Sharding by jump consistent hashing: a key's shard follows from the key and the number of shards alone.

The generator of jumps is the 64-bit linear congruence of the published algorithm (Lamping and Veach, 2014):
from ``n`` to ``n + 1`` shards a key either stays or goes to the new shard, and 1 / (n + 1) of the keys go.
There is no ring and no table. Products modulo 2**64 are made of 16 and 32-bit parts, as Spark's own raise an
error when they overflow. Everything is built-in expressions.

Places within a shard (``slot``) come from a range order of the narrow rows and counts per part of it: no task
holds a shard, and a key that a third of the rows share is cut into parts by the rows' own numbers.

Edge cases: a null key counts as 0; a null or empty text has size 1 and checksum 0; equal keys share a shard, in any number;
repeated rows each get a slot; an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.llm.common import materialize, new_path

#: Fixed values of the algorithm: the factor of the congruence in two halves.
FACTOR = 2862933555777941757
HIGH, LOW = FACTOR >> 32, FACTOR & 0xFFFFFFFF
MASK32, MASK16 = (1 << 32) - 1, (1 << 16) - 1
#: Jumps folded for every key; the few keys that need more go on from there.
USUAL_JUMPS = 24


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 for numbers under 2**32."""
    return (F.shiftright(x, 16) * factor % (1 << 16) * (1 << 16) + x.bitwiseAND(MASK16) * factor) % (1 << 32)


def _next(s: Column) -> Column:
    """One step of the congruence on the halves (hi, lo) of the key, and the jump it gives from bucket ``j``."""
    upper, lower = F.shiftright(s["lo"], 16) * LOW, s["lo"].bitwiseAND(MASK16) * LOW + 1
    low = lower + upper.bitwiseAND(MASK16) * (1 << 16)
    hi = (F.shiftright(upper, 16) + F.shiftright(low, 32) + _times(s["hi"], LOW) + _times(s["lo"], HIGH)) % (1 << 32)
    return F.struct(hi.alias("hi"), low.bitwiseAND(MASK32).alias("lo"), s["j"].alias("b"), s["j"].alias("j"))


def _jump(s: Column) -> Column:
    """The bucket after ``b`` by the step's random number."""
    target = (s["b"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(s["hi"], 1) + 1).cast("double"))
    return F.struct(s["hi"].alias("hi"), s["lo"].alias("lo"), s["b"].alias("b"), F.floor(target).cast("long").alias("j"))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(state: Column, jumps: int, shards: int) -> Column:
    """At most so many more jumps; a key that has left the shards stays."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), state, lambda s, _: F.when(s["j"] >= shards, s).otherwise(_let(_next(s), _jump)))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 .. shards - 1) of a 64-bit integer key."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(MASK32).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    most = min(shards, USUAL_JUMPS)
    done = _fold(start, most, shards)
    if shards > most:  # every jump leaves at least one bucket behind, so no key needs more jumps than there are shards
        done = _let(done, lambda s: F.when(s["j"] >= shards, s).otherwise(_fold(s, shards - most, shards)))
    return done["b"].cast("int")


def key_of(df: DataFrame, *columns: str) -> Column:
    """A 64-bit key: one integer column as it is, else a hash of the columns (a null column adds nothing to it)."""
    kinds = dict(df.dtypes)
    return F.col(columns[0]).cast("long") if len(columns) == 1 and kinds[columns[0]] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(*columns)


def assign(docs: DataFrame, shards: int, *keys: str, column: str = "shard") -> DataFrame:
    """All rows and columns with their shard by key."""
    return docs.withColumn(column, jump_shard(key_of(docs, *keys), shards))


def moved(docs: DataFrame, before: int, after: int, *keys: str) -> DataFrame:
    """Only the rows that change their shard between two numbers of shards, with both: ``shard`` and ``new_shard``."""
    rows = assign(assign(docs, before, *keys), after, *keys, column="new_shard")
    return rows.filter(F.col("shard") != F.col("new_shard"))


def write_shards(docs: DataFrame, shards: int, *keys: str, path: str | None = None) -> DataFrame:
    """Whole rows written as Parquet in one folder a shard, and read back. Large shards are cut into several files by Spark's rebalancing."""
    path = path or new_path(docs.sparkSession, "shards")
    out = assign(docs, shards, *keys)
    out.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def slots(rows: DataFrame, *order: str, shard: str = "shard") -> DataFrame:
    """All rows with ``slot``: their place in their shard, 0 upwards without gaps, by the order columns, then by the order of reading.

    Rows are range-partitioned by the order; each part's rows of a shard are counted, and the counts before a part are where its slots begin.
    """
    columns = rows.columns
    numbered = materialize(rows.withColumn("__read", F.monotonically_increasing_id()), "numbered")
    ordered = numbered.repartitionByRange(*order, "__read").sortWithinPartitions(*order, "__read")
    placed = materialize(ordered.withColumn("__place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("__part", F.shiftright("__place", 33))
    counts = placed.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(shard, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(shard, "__part").orderBy("__place"))
    return placed.withColumn("__i", within).join(begins, [shard, "__part"]).select(*columns, (F.col("__before") + F.col("__i") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Manifest of the shards: doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, grown_shard (with one more shard) and slot."""
    value = F.coalesce(F.col(text), F.lit(""))
    key = key_of(docs, doc_id)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    return slots(rows, "doc_id", "text_crc32", "size")
