"""Near-duplicates: Jaccard join on word shingles with Bayesian candidate pruning.

1. Every text becomes the set of its five-word shingles (64-bit hashes) and a MinHash signature of 160
   values. Texts with equal sets (their 64-bit fingerprints agree) are one *set* from here on, so copies are never paired.
2. Sets sharing one of 32 bands of 5 values are candidates (a pair at 0.8 is missed by all bands with
   probability 3e-6). Within a bucket signatures are compared 32 values at a time, and a pair is dropped
   as soon as the posterior probability that its similarity reaches the threshold falls below the
   tolerance. What is left is emitted as a star per bucket, never as pairs.
3. Stars are joined to candidate components. Within a component all pairs are compared once more in the
   same incremental way, and the survivors are verified exactly by counting common shingles.

Buckets and components larger than a chunk are cut into chunks that are compared two by two, each
pair of chunks being a group of its own; no group grows with the data, and no link is left out.

Edge cases: a text of one to four words is one shingle; a null text or one without words has no links
and is its own class; equal rows are copies of each other; rows without an id take part like all others,
and a class in which no row has an id has none either; empty tables give empty results; extra
columns are not touched. Words are runs of characters other than white space, compared as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contourlake.llm.chunks import distinct, group_starts, make_room, spans, split_all, stable_hash
from contourlake.llm.common import join_stats, materialize, record_batch, text_rows, text_slices
from contourlake.llm.components import connected_components, contract, local_roots

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 32, 5, 32
VALUES = BANDS * ROWS
#: Most sets compared in one group: two chunks of this size.
CHUNK = 192
#: Most shingles in a chunk of a component.
CHUNK_SHINGLES = 1 << 19

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_PLACE = _rng.integers(1, 1 << 63, max(WORDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, lengths = split_all(texts)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    names, codes = distinct(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[codes]
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    whole = sum(padded[j : j + len(h)] * _PLACE[j] for j in range(WORDS))
    starts = group_starts(lengths)
    counts = np.maximum(lengths - WORDS + 1, 0)
    mixed = stable_hash(whole[spans(starts, counts)], WORDS)
    cuts = np.cumsum(counts)
    out = []
    for i, n in enumerate(lengths):
        if n >= WORDS:
            out.append(np.unique(mixed[cuts[i] - counts[i] : cuts[i]]))
        else:
            one = (h[starts[i] : starts[i] + n] * _PLACE[:n]).sum(dtype=np.uint64)[None]
            out.append(stable_hash(one, int(n))[: n and 1])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x VALUES) of non-empty sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts, out, work = group_starts(sizes), np.empty((len(sets), VALUES), np.uint32), np.empty_like(x)
    for k in range(VALUES):
        np.multiply(x, _FACTORS[k], out=work)
        np.add(work, _SHIFTS[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values: the fewest matches for which the posterior probability of reaching the threshold is not below the tolerance.

    The prior is flat; a byte of two different values agrees once in 256.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    found = {}
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[j >= threshold].sum() >= tolerance * like.sum():
                found[n] = m
                break
    return found


def surviving_pairs(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs stay after the incremental comparison."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, needed in least.items():
        same = (sigs[left[alive], n - STEP : n] == sigs[right[alive], n - STEP : n]).sum(axis=1)
        matches = matches + same
        keep = matches >= needed
        alive, matches = alive[keep], matches[keep]
    return alive


def _pairs(side: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within chunk i (i == j), or between chunks i and j."""
    if i == j:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _sketch(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    make_room()
    for texts, ids, keys in text_slices(batches, ("text", "doc_id", "row")):
        sets = shingle_sets(texts)
        some = [i for i, s in enumerate(sets) if len(s)]
        fps, sigs, bands = [None] * len(texts), [None] * len(texts), [None] * len(texts)
        if some:
            sig = signatures([sets[i] for i in some])
            key = (sig.reshape(len(some), BANDS, ROWS).astype(np.uint64) * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64)
            key = stable_hash(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3).view(np.int64)
            short = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            for k, i in enumerate(some):
                fps[i] = int(fingerprint(sets[i]))
                sigs[i], bands[i] = short[k].tobytes(), key[k]
        yield record_batch(schema, [ids, keys, fps, [len(s) for s in sets], sigs, bands])


def fingerprint(shingles: np.ndarray) -> np.int64:
    """64 bits for a sorted set."""
    return np.int64(xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63))


def groups(batches, keys: int):
    """Runs of equal values in the first ``keys`` columns of sorted batches, as (values, columns as numpy or lists)."""
    carry = None
    for batch in batches:
        block = pa.Table.from_batches([batch])
        block = pa.concat_tables([carry, block]) if carry is not None else block
        if not block.num_rows:
            continue
        cols = [block.column(k).to_numpy() for k in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *change.tolist()]
        if len(edges) > 1:
            done = block.slice(0, edges[-1])
            yield from _cut(done, edges, cols)
        carry = block.slice(edges[-1])
    if carry is not None and carry.num_rows:
        yield from _cut(carry, [0, carry.num_rows], [carry.column(k).to_numpy() for k in range(keys)])


def _cut(block: pa.Table, edges: list[int], cols: list[np.ndarray]):
    whole = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in block.columns]
    for a, b in zip(edges[:-1], edges[1:]):
        yield tuple(int(c[a]) for c in cols), [c[a:b] for c in whole]


def _stars(least):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def stars(batches):
        us, vs = [], []
        for (_, i, j), (_, _, _, side, fp, sig) in groups(batches, 3):
            sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), VALUES)
            left, right = _pairs(side, i, j)
            kept = surviving_pairs(sigs, left, right, least)
            root = local_roots(len(fp), left[kept], right[kept])
            some = root != np.arange(len(fp))
            us.append(fp[some])
            vs.append(fp[root[some]])
            if len(us) > 20_000:
                yield record_batch(schema, [np.concatenate(us), np.concatenate(vs)])
                us, vs = [], []
        if us:
            yield record_batch(schema, [np.concatenate(us), np.concatenate(vs)])

    return lambda batches: contract(stars(batches))


def _with_sets(batches):
    """Shingle sets of the texts that stand for a set."""
    make_room()
    schema = pa.schema([("component", pa.int64()), ("chunks", pa.int64()), ("fp", pa.int64()), ("copies", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])
    for texts, component, chunks, fp, copies, sig in text_slices(batches, ("text", "component", "chunks", "fp", "copies", "sig")):
        yield record_batch(schema, [component, chunks, fp, copies, sig, [s.tobytes() for s in shingle_sets(texts)]])


def common_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets: by one matrix product where the sets overlap much, else pair by pair."""
    used = np.unique(np.concatenate([left, right]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    words, at = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    if len(used) * len(words) <= 1 << 25 and len(left) > 4 * len(used):
        member = np.zeros((len(used), len(words)), np.float32)
        member[np.repeat(np.arange(len(used)), [len(sets[i]) for i in used]), at] = 1
        return np.rint(member @ member.T).astype(np.int64)[place[left], place[right]]
    return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)


def _verify(least, threshold: float):
    schema = pa.schema([("component", pa.int64()), ("chunks", pa.int64()), ("fp", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for (component, i, j), (_, _, _, side, chunks, fp, copies, sig, shingles) in groups(batches, 3):
            _, first = np.unique(fp, return_index=True)
            side, fp, copies = (x[first] for x in (side, fp, copies))
            sets = [np.frombuffer(shingles[k], np.uint64) for k in first]
            sigs = np.frombuffer(b"".join(sig[k] for k in first), np.uint8).reshape(len(first), VALUES)
            left, right = _pairs(side, i, j)
            kept = surviving_pairs(sigs, left, right, least)
            left, right = left[kept], right[kept]
            links, linked = np.zeros(len(fp), np.int64), np.zeros(0, bool)
            if len(left):
                common = common_shingles(sets, left, right)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                union = sizes[left] + sizes[right] - common
                linked = common >= threshold * union - 1e-9
                left, right = left[linked], right[linked]
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
            root = local_roots(len(fp), left, right)
            yield record_batch(schema, [np.full(len(fp), component), np.full(len(fp), chunks[0]), fp, links, fp[root]])

    return run


def _dealt(rows: DataFrame, key: str, chunks: str, *columns: str) -> DataFrame:
    """Each row in a chunk of its group, repeated for every pair of chunks it belongs to: key, i, j, side and the columns, grouped and sorted."""
    side = F.pmod(F.xxhash64("fp", F.lit(17)), F.col(chunks)).cast("int")
    each = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(chunks) - 1).cast("int"))))
    pairs = each.select(F.col(key), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", *columns)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, key, "i", "j").sortWithinPartitions(key, "i", "j")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", row: str | None = None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest doc_id of its class) and n_links (rows at least ``threshold`` alike, copies included).

    A class is a connected component of the links. Rows are told apart by ``row``, a written column of distinct
    numbers; without one the texts are written once more with a number each, so ids may be null or repeated.
    """
    least = least_matches(threshold, tolerance)
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    texts = text_rows(rows if row else materialize(rows, "rows"), "text", "doc_id", "row")
    sketch = materialize(texts.mapInArrow(_sketch, "doc_id long, row long, fp long, n long, sig binary, bands array<long>"), "sketch")
    sets = sketch.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sets = materialize(sets, "sets")
    n_sets = sets.count()

    keys = sets.select("fp", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", "n", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    crowded = join_stats(keys, shared, "key", BANDS * n_sets).join(sets.select("fp", "sig"), "fp")
    stars = _dealt(crowded, "key", "chunks", "fp", "sig").mapInArrow(_stars(least), "u long, v long")
    parts = materialize(connected_components(stars, "u", "v", contracted=True).withColumnRenamed("node", "fp"), "candidates")

    sizes = parts.join(sets.select("fp", "n"), "fp").groupBy("component").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"))
    members = join_stats(parts, sizes, "component", parts.count()).join(sets.select("fp", "row", "copies", "sig"), "fp")
    full = texts.select("text", "row").join(members, "row").select("text", "component", "chunks", "fp", "copies", "sig")
    full = full.mapInArrow(_with_sets, "component long, chunks long, fp long, copies long, sig binary, shingles binary")
    checked = _dealt(full, "component", "chunks", "chunks", "fp", "copies", "sig", "shingles")
    checked = materialize(checked.mapInArrow(_verify(least, threshold), "component long, chunks long, fp long, links long, root long"), "verified")

    linked = checked.filter("chunks = 1").select("fp", "links", F.col("root").alias("component"))
    large = checked.filter("chunks > 1")
    if not large.isEmpty():
        links = large.groupBy("fp").agg(F.sum("links").alias("links"))
        joined = connected_components(large.select("fp", "root"), "fp", "root").withColumnRenamed("node", "fp")
        linked = linked.unionByName(links.join(joined, "fp", "left").select("fp", "links", F.coalesce("component", "fp").alias("component")))
    linked = materialize(sets.select("fp", "doc", "copies").join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "linked")
    names = linked.groupBy("component").agg(F.min("doc").alias("class_id"), F.count("*").alias("n"))
    classes = join_stats(linked, names, "component", n_sets).select("fp", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sketch.select("doc_id", "fp").join(classes, "fp", "left").select("doc_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
