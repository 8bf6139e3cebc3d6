"""Periodic runs of words by string synchronising sets at dyadic scales.

For a scale t, a position is selected when the hash of its t words, compared with those of the next t
positions, is smallest at either end of that window. Selection depends on the next 2 t words alone, so equal contexts
are selected alike, and every stretch of t positions has a selected one unless it lies in a highly periodic region
(period at most t / 4), whose positions take no part. In a run of period q, t <= q < 2 t, of at least 4 q words, a
selected position among its first t and the position q later have the same context, and no position between them has:
so neighbours among equal contexts propose the period. The scales 4, 8, 16 ... cover periods from 4 on; periods 1 to 3,
and the highly periodic regions, are found by comparing words that far apart. Proposals
are widened to the whole run, checked word by word and kept if no shorter period holds, so results are exact whatever the hashes.

Spark deals the documents to tasks; within one, the words of a slice of texts are numbers in one array, handled side by
side. No shuffle, and memory is bounded by a slice (one longer text is its own slice).

Edge cases: null and empty texts have no words and no runs; a null id counts as the empty text; repeated rows are judged each; an empty
table gives an empty result; of extra columns only the ones asked for are kept.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contourlake.llm.chunks import group_starts, spans, stable_hash
from contourlake.llm.common import record_batch, text_rows, text_slices
from contourlake.llm.words import byte_classes, cut

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The first scale; shorter periods are found directly.
FIRST_SCALE = 4
WHITE = byte_classes(b" \t\n\x0b\x0c\r")
#: Words compared at a time when a proposal is widened, at first.
STEP = 64


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _reach(a: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on (backwards for a step of -1) are equal; blocks grow as long as they are."""
    n, done, size = len(a), 0, STEP
    while True:
        if step > 0:
            size = min(size, n - max(i, j) - done)
            x, y = a[i + done : i + done + size], a[j + done : j + done + size]
        else:
            size = min(size, min(i, j) + 1 - done)
            x, y = a[i - done - size + 1 : i - done + 1][::-1], a[j - done - size + 1 : j - done + 1][::-1]
        if size <= 0:
            return done
        if len(wrong := np.flatnonzero(x != y)):
            return done + int(wrong[0])
        done, size = done + size, size * 4


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours (a power of two); one value per full window."""
    w = 1
    while w < width:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    return v


def synchronising_pairs(a: np.ndarray, part: np.ndarray, scale: int, periodic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of neighbours with equal contexts, scale <= distance < 2 * scale. ``part``: hash of the ``scale`` words from each position; ``periodic``: positions that take no part."""
    n = len(a) - 2 * scale + 1  # positions with a whole context
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    largest = np.uint64(0xFFFFFFFFFFFFFFFF)
    ids = np.where(periodic[: n + scale], largest, part[: n + scale])
    least = np.minimum(_window_min(ids, scale)[:n], ids[scale : scale + n])
    at = np.flatnonzero(((least == ids[:n]) | (least == ids[scale : scale + n])) & (least != largest))
    context = stable_hash(part[at], 1) * np.uint64(3) + stable_hash(part[at + scale], 2)
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    gap = np.diff(at)
    close = (context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale)
    return at[:-1][close], gap[close]


def find_runs(a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All runs of the sequences that stand in a row in ``a`` (of the given lengths): rows (start in ``a``, length, period), by start, then period.

    ``a`` holds numbers of words, not negative.
    """
    lengths = np.asarray(lengths, np.int64)
    if not len(a):
        return np.zeros((0, 3), np.int64)
    ends = np.cumsum(lengths)
    # one number of its own after every sequence, so that no period crosses an end
    marked = np.insert(a.astype(np.int64), ends, -1 - np.arange(len(ends)))
    shift = np.repeat(np.arange(len(lengths)), lengths + 1)
    found: dict[int, list[tuple[int, int]]] = {}
    small = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(FIRST_SCALE, len(marked))):
        start, size = stretches(marked[q:] == marked[:-q])
        ok = size + q >= LEAST_PERIODS * q
        small.append(np.stack([start[ok], size[ok] + q, np.full(ok.sum(), q)], axis=1))
    rows = [_primitive(np.concatenate(small))]
    live, origin, size, scale = marked, np.arange(len(marked)), lengths, FIRST_SCALE
    part = stable_hash(live.view(np.uint64), 0)
    for w in (1, 2):
        part = _paired(part, w)
    while True:
        keep = size >= LEAST_PERIODS * scale
        if not keep.any():
            break
        if not keep.all():  # only texts long enough for the scale go on
            held = np.repeat(keep, size + 1)
            live, origin, part, size = live[held], origin[held], part[held], size[keep]
        periodic = np.zeros(len(live), bool)
        known = np.concatenate(rows)
        known = known[(known[:, 2] <= scale // 4) & (known[:, 1] >= scale)]
        if len(known):
            whole = np.zeros(len(marked) + 1, np.int64)
            np.add.at(whole, known[:, 0], 1)
            np.add.at(whole, known[:, 0] + known[:, 1] - scale + 1, -1)
            periodic = (np.cumsum(whole[:-1]) > 0)[origin]
        at, gap = synchronising_pairs(live, part, scale, periodic)
        rows.append(_widened(live, origin, at, gap, known))
        part = _paired(part, scale)
        scale *= 2
    runs = np.unique(_primitive(np.concatenate(rows)), axis=0)
    runs = runs[runs[:, 1] >= LEAST_WORDS]
    runs[:, 0] -= shift[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _paired(part: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice the width from hashes of the width; those past the end wrap and are never used."""
    return stable_hash(part, width) * np.uint64(3) + stable_hash(np.roll(part, -width), ~width)


def _widened(live, origin, at, gap, known) -> np.ndarray:
    """The whole runs behind proposals; further proposals within a run already found are passed over."""
    out = []
    order = np.lexsort((at, gap))
    period, end = -1, -1
    for i, q in zip(at[order].tolist(), gap[order].tolist()):
        if q == period and i < end:
            continue
        left, right = _reach(live, i - 1, i - 1 + q, -1) if i else 0, _reach(live, i, i + q, 1)
        start, size = i - left, left + right + q
        period, end = q, start + size - q
        if size >= LEAST_PERIODS * q:
            out.append((int(origin[start]), size, q))
    return np.array(out, np.int64).reshape(-1, 3)


def _primitive(runs: np.ndarray) -> np.ndarray:
    """Without the stretches that a run of a shorter period, which divides theirs, covers whole."""
    if not len(runs):
        return runs
    order = np.lexsort((runs[:, 2], -runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keep = np.ones(len(runs), bool)
    # a stretch with a shorter period d of a run with 4 d words lies in that run; so it starts where that run does, or later, and ends there or before
    reach: list[tuple[int, int, int]] = []
    for k, (s, n, q) in enumerate(runs.tolist()):
        reach = [r for r in reach if r[1] > s]
        if any(r[1] >= s + n and q % r[2] == 0 and r[2] < q for r in reach):
            keep[k] = False
        reach.append((s, s + n, q))
    return runs[keep]


def planted(doc_id: str | None, n: int) -> tuple[int, int]:
    """(a, p) where the words of a document repeat from: word i >= a becomes a + (i - a) % p; (n, 1) where nothing changes."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 or not n:
        return n, 1
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _changed(ids: list, lengths: np.ndarray, plant: bool) -> np.ndarray:
    """For each word, the word (in the slice) that stands in its place."""
    at = np.arange(int(lengths.sum()))
    if plant:
        for d, (begin, n) in enumerate(zip(group_starts(lengths).tolist(), lengths.tolist())):
            a, p = planted(ids[d], n)
            if a < n:
                at[begin + a : begin + n] = begin + a + np.arange(n - a) % p
    return at


def _largest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


SCHEMA = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
LISTS = pa.schema([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _slice_runs(texts: pa.Array, ids: list, plant: bool):
    """Lengths in words, words in place, runs with the text each lies in, and which words are kept."""
    words, owner, _ = cut(texts, WHITE)
    lengths = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    if not len(words):
        return lengths, words, np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    at = _changed(ids, lengths, plant)
    codes = words.dictionary_encode().indices.to_numpy()[at]
    runs = find_runs(codes, lengths)
    text = np.searchsorted(np.cumsum(lengths), runs[:, 0], side="right")
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped[:-1]) == 0
    runs = runs.copy()
    runs[:, 0] -= group_starts(lengths)[text]
    return lengths, words.take(pa.array(at)) if plant else words, runs, text, kept


def _joined(words: pa.Array, lengths: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text joined by one space."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    size = np.bincount(owner[kept], minlength=len(lengths))
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words if kept.all() else words.filter(pa.array(kept))), " ")


def _digest(texts: pa.Array, ids: list, plant: bool) -> list:
    lengths, words, runs, text, kept = _slice_runs(texts, ids, plant)
    empty, sha = hashlib.sha256(b"").hexdigest(), hashlib.sha256
    count = np.bincount(text, minlength=len(lengths)).astype(np.int64)
    best: list = [[None] * len(lengths) for _ in range(4)]
    lists = [empty] * len(lengths)
    begin = group_starts(count)
    for d in np.flatnonzero(count).tolist():
        own = list(map(tuple, runs[begin[d] : begin[d] + count[d]].tolist()))
        lists[d] = sha("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest()
        s, n, q = _largest(own)
        for column, value in zip(best, (s, n, q, 1000 * n // q)):
            column[d] = value
    collapsed = _joined(words, lengths, kept).cast(pa.binary()) if len(words) else [None] * len(lengths)
    return [count, *best, lists, [sha(c.as_buffer()).hexdigest() if c is not None else empty for c in collapsed]]


def _lists(texts: pa.Array, ids: list, plant: bool) -> list:
    lengths, words, runs, text, kept = _slice_runs(texts, ids, plant)
    count = np.bincount(text, minlength=len(lengths)).astype(np.int64)
    rows = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, rows), _joined(words, lengths, kept) if len(words) else pa.array([""] * len(lengths))]


def _mapped(docs: DataFrame, doc_id: str, text: str, fields: pa.Schema, work, spark_fields: str, plant: bool) -> DataFrame:
    rows = text_rows(docs, F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("name"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for texts, keys, names in text_slices(batches, ["text", "doc_id", "name"]):
            schema = pa.schema([pa.field("doc_id", keys.type), *fields])
            yield record_batch(schema, [keys, *work(texts, names.to_pylist() if plant else [], plant)])

    return rows.mapInArrow(run, f"doc_id {kind}, {spark_fields}")


def runs_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length and period in words, by start, then period) and collapsed: the text without what its runs repeat, words joined by one space."""
    return _mapped(docs, doc_id, text, LISTS, _lists, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", False)


def run_digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli) and the checksums of the list of runs and of the collapsed text.

    With ``plant`` every tenth document, by a checksum of its id, first has its words repeated from some word on.
    """
    fields = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, doc_id, text, SCHEMA, _digest, fields, plant)
