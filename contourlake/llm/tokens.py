"""Token ids of whole texts from a public tokenizer file, as the tokenizers library gives them.

The vocabulary normalises to lower case and never joins pieces over white space, so each distinct
white-space separated chunk has the same ids wherever it stands: those of its words (runs of letters, single
digits, runs of signs), which are remembered per worker.
Texts with a character outside the plain range below, where this has been checked against the
library's own rules, or with a special token's name in them are encoded whole by the library.

Edge cases: null and empty texts have no ids.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from contourlake.llm.chunks import ChunkTable, distinct, group_starts, shared_table, spans, split_all

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: The characters for which lower-casing and splitting by chunk equal the library's own normaliser and splitter.
NOT_PLAIN = "[^\t\n\r\x20-\x7e\xa1-įı-ſ]"
LETTERS = "a-zªµºß-öø-ſ"
NUMBERS = "0-9²³¹¼½¾"
#: Most words remembered in one worker.
WORD_LIMIT = 300_000
#: Words of a chunk, and the mark between chunks.
WORDS = re.compile(f"\x20|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


class TextEncoder:
    """Ids of texts; one per worker and vocabulary file."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = public_tokenizers.path(vocabulary)
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            content = json.load(f)
        kinds = [p["type"] for p in content["pre_tokenizer"].get("pretokenizers", [])]
        steps = [n["type"] for n in (content["normalizer"] or {}).get("normalizers", [])]
        self.by_chunk = kinds == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"] and content["model"].get("end_of_word_suffix") is not None
        self.special = [t["content"] for t in content["added_tokens"]]
        self.bytes = {b: c for b, c in zip(range(256), self._byte_signs())}
        self.words = ChunkTable(self._word_rows, WORD_LIMIT)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _byte_signs() -> list[str]:
        """The sign that stands for each byte: printable Latin-1 for itself, others from 256 on."""
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        return [chr(b) if b in printable else chr(next(others)) for b in range(256)]

    def _word_rows(self, words: list[str]) -> np.ndarray:
        """Where each word's ids stand in the pool, and how many they are; the mark between chunks has none."""
        rows = self.words.rows
        if rows is not None and self.used > 8 * self.words.limit:  # drop what forgotten words left behind
            kept = self.pool[spans(rows[:, 0], rows[:, 1])]
            rows[:, 0] = group_starts(rows[:, 1])
            self.pool, self.used = kept, len(kept)
        tokenize, signs = self.library.model.tokenize, self.bytes
        ids = [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(signs))] if w != " " else [] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        start, end = self.used, self.used + int(lengths.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end - start, len(self.pool)), np.uint32)])
        self.pool[start:end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - start)
        self.used = end
        return np.stack([start + group_starts(lengths), lengths], axis=1)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        plain = np.full(len(texts), self.by_chunk)
        for odd in (pc.match_substring_regex(texts, NOT_PLAIN), *(pc.match_substring(texts, s) for s in self.special)):
            plain &= ~np.asarray(pc.fill_null(odd, False))
        words, lengths = split_all(texts if plain.all() else pc.if_else(pa.array(plain), texts, pa.scalar(None, texts.type)))
        made, per_text = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(words):
            chunks, codes = distinct(words)
            at = self.words.lookup(WORDS.findall(" ".join(chunks).lower()))
            found = self.words.rows[at]
            size = np.bincount(np.cumsum(at == self.words.index[" "]) if len(chunks) > 1 else np.zeros(len(at), np.int64), weights=found[:, 1], minlength=len(chunks)).astype(np.int64)
            made = self.pool[spans(found[:, 0], found[:, 1])][spans(group_starts(size)[codes], size[codes])]
            per_text = np.bincount(np.repeat(np.arange(len(texts)), lengths), weights=size[codes], minlength=len(texts)).astype(np.int64)
        parts = np.split(made, np.cumsum(per_text)[:-1]) if len(texts) else []
        for i in np.flatnonzero(~plain):
            if t := texts[int(i)].as_py():
                parts[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        return parts


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> TextEncoder:
    """The encoder of this worker."""
    return shared_table(("encoder", vocabulary), lambda: TextEncoder(vocabulary))
