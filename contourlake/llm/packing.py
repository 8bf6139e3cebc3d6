"""Harmonic packing of token sequences into fixed-length training sequences.

Every document (its ids and an end id) is cut into pieces, and a piece of length ``n`` belongs to class
``k = capacity // n``: its length lies in ``(capacity/(k+1), capacity/k]``, and a bin of that class is full
with exactly ``k`` pieces. Bins are filled per class and partition, without any exchange of rows, so the
work needs no shuffle and no key can be hot.

Documents are cut so that classes fit closely: whole sequences first, then the rest in falling halves of
the capacity down to ``shortest``; what is left (under ``shortest`` ids) goes to the class of its own
length. At a partition's end the pieces of unfinished bins are laid one after another into sequences and
cut where one is full; the last sequence is cut again into powers of two, which need no padding.

Sequences are padded to the capacity, except those whose length is a power of two.

Edge cases: a null or empty text is its end id alone; repeated rows are packed each; empty tables give
no pieces; sequence ids are unique and repeatable, not consecutive; extra columns are not touched.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contourlake.llm.common import record_batch, text_rows, text_slices
from contourlake.llm.tokens import DEFAULT_VOCABULARY, encoder

CAPACITY = 2048
#: Rests shorter than this are not halved any further.
SHORTEST = 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut_lengths(total: int, capacity: int = CAPACITY, shortest: int = SHORTEST) -> list[int]:
    """Piece lengths of a document of ``total`` ids: whole sequences, falling halves, and the rest."""
    lengths = [capacity] * (total // capacity)
    rest, half = total % capacity, capacity // 2
    while half >= shortest:
        if rest >= half:
            lengths.append(half)
            rest -= half
        half //= 2
    return lengths + [rest] * (rest > 0)


class HarmonicPacker:
    """Open bins of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, partition: int, capacity: int = CAPACITY, shortest: int = SHORTEST):
        self.capacity, self.shortest = capacity, shortest
        self.open: dict[int, list] = defaultdict(list)
        self.next_id = partition << 36

    def add(self, doc_id: int, ids: np.ndarray) -> list[tuple]:
        """Cut a document and return the rows of all bins that this fills."""
        rows, start = [], 0
        for n in cut_lengths(len(ids), self.capacity, self.shortest):
            kind = self.capacity // n
            self.open[kind].append((doc_id, start, ids[start : start + n], len(ids)))
            start += n
            if len(self.open[kind]) == kind:
                rows += self._sequence(self.open.pop(kind))
        return rows

    def finish(self) -> list[tuple]:
        """Rows of the pieces that are left: laid one after another, cut at the capacity and at last at powers of two."""
        pieces = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open.clear()
        left, rows, current, room = sum(len(p[2]) for p in pieces), [], [], 0
        for doc_id, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids))
                current.append((doc_id, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    rows += self._sequence(current)
                    current = []
        return rows

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        offset, rows = 0, []
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1
        return rows


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 1, capacity: int = CAPACITY, shortest: int = SHORTEST) -> DataFrame:
    """One row per piece: its document, where it begins there, its ids (little-endian 32-bit), sequence and offset.

    The open bins of a partition hold fewer than ``capacity * (capacity/shortest + 2*shortest)`` ids, however many rows there are.
    """
    rows = text_rows(docs, F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))

    def run(batches):
        packer, encode = HarmonicPacker(TaskContext.get().partitionId(), capacity, shortest), encoder(vocabulary).encode
        end = np.array([end_id], np.uint32)
        for texts, ids in text_slices(batches, ("text", "doc_id")):
            out = []
            for d, found in zip(ids.to_pylist(), encode(texts)):
                out += packer.add(d, np.concatenate([found, end]))
            if out:
                yield record_batch(_ARROW, zip(*out))
        if out := packer.finish():
            yield record_batch(_ARROW, zip(*out))

    return rows.mapInArrow(run, SCHEMA)
