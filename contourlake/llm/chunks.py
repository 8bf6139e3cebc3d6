"""White-space separated chunks of text mapped to numbers, remembered per Python worker.

Texts stay Arrow arrays: they are split, and equal chunks of a slice found, without a Python object per
chunk. Work per word (hashing, subwords, tokenising) is done once per distinct chunk, and what was
worked out is looked up afterwards. The memory is bounded in entries and in characters: when a table is
full, chunks seen only once and very long ones go first.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most chunks remembered in one worker, and their characters.
LIMIT = 120_000
LIMIT_CHARS = 16_000_000
#: Longer chunks are not kept when room is made.
LONG = 256

#: The table of this worker by name; Spark reuses workers, so later tasks find it filled.
_TABLES: dict[tuple, object] = {}


class ChunkTable:
    """chunk -> row number; ``rows`` holds what ``compute`` gave for it."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = LIMIT, limit_chars: int = LIMIT_CHARS):
        self.compute, self.limit, self.limit_chars = compute, limit, limit_chars
        self.index: dict[str, int] = {}
        self.rows: np.ndarray | None = None
        self.seen = np.zeros(0, np.int64)
        self.chars = 0

    def lookup(self, names: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Row numbers of the given chunks, valid until the next call; ``times`` is how often each occurs."""
        at = self._find(names)
        if (missing := np.flatnonzero(at < 0)).size:
            new = list(dict.fromkeys([names[i] for i in missing.tolist()]))
            if self.index and (len(self.index) + len(new) > self.limit or self.chars > self.limit_chars):
                self._shrink()
                at = self._find(names)
                missing = np.flatnonzero(at < 0)
                new = list(dict.fromkeys([names[i] for i in missing.tolist()]))
            rows, n = self.compute(new), len(self.index)
            self.index.update(zip(new, range(n, n + len(new))))
            self.rows = rows if self.rows is None else np.concatenate([self.rows[:n], rows])
            self.seen = np.concatenate([self.seen[:n], np.zeros(len(new), np.int64)])
            self.chars += sum(map(len, new))
            at[missing] = self._find([names[i] for i in missing.tolist()])
        self.seen += np.bincount(at, weights=times, minlength=len(self.seen)).astype(np.int64)
        return at

    def _find(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))

    def _shrink(self) -> None:
        names = list(self.index)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-self.seen, kind="stable")[: self.limit // 2]
        order = order[(self.seen[order] > 1) & (lengths[order] <= LONG)]
        keep = np.sort(order[np.cumsum(lengths[order]) <= self.limit_chars // 2])
        self.index = {names[i]: k for k, i in enumerate(keep)}
        self.rows, self.seen, self.chars = self.rows[keep], self.seen[keep] // 2, int(lengths[keep].sum())


class CharClasses:
    """A small number for every code point, worked out when it is first met."""

    def __init__(self, classify: Callable[[str], int]):
        self.classify = classify
        self.known = np.full(0x110000, 255, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.known[codes]
        if (new := found == 255).any():
            for c in np.unique(codes[new]).tolist():
                self.known[c] = self.classify(chr(c))
            found = self.known[codes]
        return found


def shared_table(key: tuple, make: Callable):
    """What ``make`` gave under that name in this worker. One is kept: another stage's table makes room first."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


def make_room() -> None:
    """Forget this worker's table and hand freed memory back; for tasks that need none."""
    _TABLES.clear()
    pa.default_memory_pool().release_unused()


def split_all(texts: pa.Array, *, unicode: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All chunks of all texts in one array, and how many each text has (null: none). White space is ASCII's, or Unicode's when asked for."""
    parts = (pc.utf8_split_whitespace if unicode else pc.ascii_split_whitespace)(texts)
    chunks, lengths = parts.flatten(), np.asarray(pc.fill_null(pc.list_value_length(parts), 0)).astype(np.int64)
    if pc.min(sizes := pc.binary_length(chunks)).as_py() == 0:  # white space at a text's ends leaves empty chunks
        some = np.asarray(sizes) > 0
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths))
        chunks = chunks.filter(pa.array(some))
    return chunks, lengths


def distinct(chunks: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct chunks and, for every chunk, which of them it is."""
    coded = chunks.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


def group_starts(lengths: np.ndarray) -> np.ndarray:
    """Where each group begins when groups of the given lengths stand in a row."""
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - group_starts(lengths), lengths) + np.arange(total)


def code_points(chunks: list[str], mark: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """The code points of all chunks and which chunk each belongs to; chunks hold no ``mark``."""
    codes = np.frombuffer(mark.join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    between = codes == ord(mark)
    owner = np.cumsum(between)
    return codes[~between], owner[~between]


def stable_hash(codes: np.ndarray, salt: int) -> np.ndarray:
    """Mix 64-bit numbers: the same in every worker, for any salt."""
    x = codes.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))
