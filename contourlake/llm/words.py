"""Words of whole texts cut at byte classes: Arrow texts in, one Arrow array of words out, no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Byte classes: part of a word, between words, end of a piece (also between words).
INSIDE, BLANK, BREAK = 0, 1, 2


def byte_classes(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each of the 256 bytes. Marks must be ASCII, so that no character of UTF-8 is cut."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(breaks)] = BREAK
    return kinds


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def cut(texts: pa.Array, kinds: np.ndarray, *, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts (nulls have none), the text each stands in, and the piece: a number that changes at every break and text.

    ``texts`` is a string array of under 2 GB.
    """
    texts = pa.array(texts, pa.string()) if texts.type != pa.string() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    kind = kinds[data]
    if texts.null_count:  # a null may still cover bytes
        size = np.diff(offsets)
        kind = np.where(np.repeat(np.asarray(texts.is_null()), size), np.uint8(BLANK), kind)
    inside = kind == INSIDE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    bounds = offsets[:-1][np.diff(offsets) > 0] - first  # where texts begin
    begins[bounds] = inside[bounds]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])  # bytes of words before each byte
    ends = np.append(before[starts], before[-1]).astype(np.int32)
    letters = data[inside]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(LOWER[letters] if lower else letters))
    owner = np.searchsorted(offsets[:-1] - first, starts, side="right") - 1
    ended = kind == BREAK
    piece = np.cumsum(ended, dtype=np.int64)[starts] + owner
    return words, owner, piece
