"""Token ids as length-delimited binary records with a separate offset index.

Data file: one record after another, each framed as

    length (u64) | masked crc32 of the length (u32) | body | masked crc32 of the body (u32)

where the body is the document's id (i64), the width of one token id in bytes (u8: 2 for vocabularies
under 65,536 ids, else 4) and the ids. All numbers are little-endian. A checksum is masked by turning it
right by 15 bits and adding 0xa282ead8, so that a checksum stored in a checked body stays harmless.

Index file: one entry of 28 bytes per record (offset u64, document id i64, ids u32, ids before it in the
file u64), so a reader can seek to records in any order.

Files hold ascending ranges of document ids; a manifest table lists the files of the attempt that Spark
committed, so files left by lost or repeated tasks are never read.

Edge cases: a null or empty text is its end id alone; rows with the same document id are ordered by the
checksum of their token ids, then by these, and an id that fills several files' share of the rows is cut
among that many files by the checksum (equal rows stay together); a null document id is written as the
smallest; empty tables give an empty manifest; extra columns are not touched.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contourlake.llm.common import materialize, new_path, record_batch, text_rows, text_slices
from contourlake.llm.tokens import DEFAULT_VOCABULARY, encoder

MASK = 0xA282EAD8
HEAD, BODY, FOOT = struct.Struct("<QI"), struct.Struct("<qB"), struct.Struct("<I")
INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("n_ids", "<u4"), ("before", "<u8")])
NO_ID = -(1 << 63)
#: Bytes that one read of neighbouring records fetches.
READ_BYTES = 4 << 20
MANIFEST = "shard long, path string, index_path string, n_records long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    """One record."""
    body = BODY.pack(doc_id, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(body))
    return length + FOOT.pack(masked(length)) + body + FOOT.pack(masked(body))


def unframe(data, offset: int) -> tuple[int, np.ndarray, int]:
    """The document id, the ids and where the next record begins; raises ValueError on a wrong checksum."""
    n, check = HEAD.unpack_from(data, offset)
    if masked(bytes(data[offset : offset + 8])) != check:
        raise ValueError(f"record at {offset}: wrong checksum of the length")
    start = offset + HEAD.size
    body = bytes(data[start : start + n])
    if len(body) != n or masked(body) != FOOT.unpack_from(data, start + n)[0]:
        raise ValueError(f"record at {offset}: wrong checksum of the body")
    doc_id, width = BODY.unpack_from(body)
    return doc_id, np.frombuffer(body, f"<u{width}", offset=BODY.size), start + n + FOOT.size


def _open(path: str):
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """One data file and its index."""

    def __init__(self, folder: str, shard: int):
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        self.shard, self.path, self.index_path = shard, name + ".rec", name + ".idx"
        store, where = _open(self.path)
        store.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(where)
        self.entries, self.offset, self.total = [], 0, 0

    def add(self, doc_id: int, ids: np.ndarray, width: int) -> None:
        record = frame(doc_id, ids, width)
        self.out.write(record)
        self.entries.append((self.offset, doc_id, len(ids), self.total))
        self.offset += len(record)
        self.total += len(ids)

    def close(self) -> tuple:
        self.out.close()
        store, where = _open(self.index_path)
        with store.open_output_stream(where) as out:
            out.write(np.array(self.entries, INDEX).tobytes())
        return self.shard, self.path, self.index_path, len(self.entries), self.total


class ShardReader:
    """Random access to the records of one file through its index."""

    def __init__(self, path: str, index_path: str):
        store, where = _open(index_path)
        with store.open_input_file(where) as f:
            self.index = np.frombuffer(f.read(), INDEX)
        store, where = _open(path)
        self.file = store.open_input_file(where)
        self.size = self.file.size()

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> tuple[int, np.ndarray]:
        start = int(self.index["offset"][i])
        end = int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.size
        doc_id, ids, _ = unframe(self.file.read_at(end - start, start), 0)
        if doc_id != int(self.index["doc_id"][i]) or len(ids) != int(self.index["n_ids"][i]):
            raise ValueError(f"record {i}: the index names another document")
        return doc_id, ids

    def runs(self, most_records: int = 256, most_bytes: int = READ_BYTES):
        """All records in order, in lists of neighbours that one read fetches: at most so many records and bytes (one longer record is its own list)."""
        ends = np.append(self.index["offset"][1:], np.uint64(self.size)).astype(np.int64)
        i = 0
        while i < len(self):
            start = int(self.index["offset"][i])
            j = min(i + most_records, max(i + 1, int(np.searchsorted(ends, start + most_bytes, side="right"))))
            data, at, found = self.file.read_at(int(ends[j - 1]) - start, start), 0, []
            for k in range(i, j):
                if start + at != int(self.index["offset"][k]):
                    raise ValueError(f"record {k}: the index names another place")
                doc_id, ids, at = unframe(data, at)
                if doc_id != int(self.index["doc_id"][k]) or len(ids) != int(self.index["n_ids"][k]):
                    raise ValueError(f"record {k}: the index names another document")
                found.append((doc_id, ids))
            yield i, found
            i = j

    def shuffled(self, seed: int):
        """All records in a repeatable random order."""
        for i in np.random.default_rng(seed).permutation(len(self)):
            yield self[int(i)]


def share_of(bounds: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The file of each id between ascending bounds; an id that is a bound several times goes to that many files, by the range of its row's 32-bit tie."""
    left, right = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    return np.where(right > left, left + 1 + (ties * (right - left) >> 32), right)


def write_records(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 2, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode all texts and write them in ascending order of the id; returns the manifest.

    Only ids are shuffled, two bytes each: texts are encoded where they are read. Range bounds come from
    the quantiles of the id column, so that no row is encoded twice.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 20 * shards)).first()[0] if shards > 1 else None
    bounds = np.array(cuts or [], np.int64)  # an id that fills several shares stands there several times
    folder = new_path(spark, "records")
    encoded_schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary())])
    manifest_schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])

    def encode(batches):
        made = encoder(vocabulary)
        width = 2 if made.library.get_vocab_size() < 1 << 16 and end_id < 1 << 16 else 4
        for texts, ids in text_slices(batches, ("text", "doc_id")):
            found = [bytes([width]) + np.append(x, np.uint32(end_id)).astype(f"<u{width}").tobytes() for x in made.encode(texts)]
            ties = np.array([zlib.crc32(x) for x in found], np.int64)
            yield record_batch(encoded_schema, [share_of(bounds, ids.to_numpy(), ties), ids, ties, found])

    def write(batches):
        writer, done = None, []
        for batch in batches:
            for shard, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        done.append(writer.close())
                    writer = ShardWriter(folder, shard)
                writer.add(d, np.frombuffer(ids, f"<u{ids[0]}", offset=1), ids[0])
        if writer is not None:
            done.append(writer.close())
        if done:
            yield record_batch(manifest_schema, zip(*done))

    encoded = rows.mapInArrow(encode, "shard long, doc_id long, tie long, ids binary")
    dealt = encoded.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", "tie", "ids")
    return materialize(dealt.mapInArrow(write, MANIFEST), "records-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """All records of a manifest with the position of their first id: doc_id, start, ids (little-endian 32-bit).

    The manifest has one row per file, so the running sum over it is small.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before)
    n = max(1, manifest.count())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for path, index_path, base in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "index_path", "base"))):
                shard = ShardReader(path, index_path)
                for i, part in shard.runs():
                    starts = base + shard.index["before"][i : i + len(part)].astype(np.int64)
                    yield record_batch(schema, [[d if d != NO_ID else None for d, _ in part], starts, [len(x) for _, x in part], [x.astype("<u4").tobytes() for _, x in part]])

    return files.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
