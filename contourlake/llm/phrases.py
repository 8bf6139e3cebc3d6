"""Phrase collocations: counts of word sequences by HAT-tries, and the phrases whose words hold together.

Counting. A task adds its texts to a trie over word numbers. The trie is shallow: a node leads to hash containers of the rest
of a phrase (packed numbers to counts), and a container that grows too large bursts into a node with a container for
each next word. When a task's trie holds ``limit`` phrases, its largest subtrees leave it as runs sorted by word, until
half is free. Spark deals the runs to partitions by the prefix of a phrase (all its words but the last) and merges them there; a prefix
that very many phrases share is cut into ``PREFIX_PARTS`` parts by the last word.

Levels. A phrase occurs no more often than any part of it. So single words are counted first, pairs of frequent words next, and
phrases of three and four words only where every pair in them is frequent. Which words and pairs are frequent
is told to the tasks by a filter of a fixed number of bits: it may let rare ones through (they are counted and fall
away by their count) but never holds a frequent one back, so counts are exact at any size, and nothing that is broadcast grows with the data.

A slice of texts is cut into words as Arrow arrays; counts of equal phrases of the slice are summed before the trie sees them.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; an empty table gives an
empty result; extra columns are not read; texts may be of any length (pieces end a phrase, slices end at texts).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contourlake.llm.chunks import stable_hash
from contourlake.llm.common import materialize, record_batch, text_rows, text_slices
from contourlake.llm.words import byte_classes, cut

LEAST, MOST_WORDS, TOP = 30, 4, 2000
#: What ends a piece, and what parts words within one.
KINDS = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Bits of a word's number: most words a task numbers before its trie leaves and numbers start anew.
BITS = 20
#: Words looked at together at most, which bounds the new numbers of a step.
STRETCH = 1 << 19
#: Phrases a task's trie holds, and how many a container holds before it bursts.
LIMIT, BURST = 600_000, 4096
#: Bytes of text of a language looked at together (one longer text stands alone).
SLICE_BYTES = 4_000_000
#: Bits of a filter of frequent phrases.
FILTER_BITS = 1 << 27
#: Partitions that the phrases of one prefix may be dealt to.
PREFIX_PARTS = 4
#: Rows sent at a time.
SENT = 65_536


class Container:
    """Rest of a phrase (packed word numbers) to count."""

    __slots__ = ("counts",)

    def __init__(self):
        self.counts: dict[int, int] = {}

    def add(self, keys: list[int], counts: list[int]) -> None:
        held = self.counts
        for k, c in zip(keys, counts):
            held[k] = held.get(k, 0) + c


class HatTrie:
    """Counts of phrases of one length under word numbers: nodes by next word above, hash containers below."""

    def __init__(self, words: int, burst: int = BURST):
        self.words, self.burst, self.size = words, burst, 0
        self.root: dict[int, Container | dict] = {}

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct phrases in ascending order, rows of word numbers, and how often each occurs."""
        self._into(self.root, keys, counts, 0)

    def _into(self, node: dict, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        if not len(keys):
            return
        first = keys[:, depth]
        cuts = np.flatnonzero(np.diff(first)) + 1
        bounds = [0, *cuts.tolist(), len(first)]
        rest = self._packed(keys, depth + 1).tolist()
        times, heads = counts.tolist(), first[bounds[:-1]].tolist()
        for head, i, j in zip(heads, bounds, bounds[1:]):
            child = node.get(head)
            if child is None:
                child = node[head] = Container()
            if isinstance(child, dict):
                self._into(child, keys[i:j], counts[i:j], depth + 1)
                continue
            before = len(child.counts)
            child.add(rest[i:j], times[i:j])
            self.size += len(child.counts) - before
            if len(child.counts) > self.burst and depth + 2 < self.words:
                node[head] = self._burst(child, depth + 1)

    def _packed(self, keys: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for i in range(depth, self.words):
            out = (out << BITS) | keys[:, i]
        return out

    def _burst(self, full: Container, depth: int) -> dict:
        """A node in place of a container: its phrases dealt to a container for each next word."""
        shift = BITS * (self.words - depth - 1)
        node: dict[int, Container] = {}
        for key, count in full.counts.items():
            head = key >> shift
            child = node.get(head)
            if child is None:
                child = node[head] = Container()
            child.counts[key & ((1 << shift) - 1)] = count
        return node

    def spill(self, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        """Take whole subtrees of the root, the largest first, until at most ``down_to`` phrases are left: phrases (rows of numbers) and counts."""
        sizes = {head: self._count(child) for head, child in self.root.items()}
        parts: list[tuple[tuple[int, ...], Container]] = []
        for head in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= down_to:
                break
            self._collect(self.root.pop(head), (head,), parts)
            self.size -= sizes[head]
        held = [c.counts for _, c in parts]
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        total = int(lengths.sum())
        packed, counts = np.fromiter(chain.from_iterable(held), np.int64, total), np.fromiter(chain.from_iterable(h.values() for h in held), np.int64, total)
        depth = np.repeat(np.fromiter((len(prefix) for prefix, _ in parts), np.int64, len(parts)), lengths)
        out = np.empty((total, self.words), np.int64)
        for i in range(self.words - 1, 0, -1):  # a word of the container's keys, or of the path to it
            out[:, i] = packed & ((1 << BITS) - 1)
            packed = packed >> BITS
            above = depth > i
            if above.any():
                path = np.fromiter((prefix[i] if len(prefix) > i else 0 for prefix, _ in parts), np.int64, len(parts))
                out[above, i] = np.repeat(path, lengths)[above]
        out[:, 0] = np.repeat(np.fromiter((prefix[0] for prefix, _ in parts), np.int64, len(parts)), lengths)
        return out, counts

    def _count(self, child: Container | dict) -> int:
        return sum(map(self._count, child.values())) if isinstance(child, dict) else len(child.counts)

    def _collect(self, child: Container | dict, prefix: tuple[int, ...], parts: list) -> None:
        if isinstance(child, dict):
            for head, x in child.items():
                self._collect(x, (*prefix, head), parts)
        else:
            parts.append((prefix, child))


class Filter:
    """Bits of frequent phrases; what was put in is always found."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, 64 * len(self.words)):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits of a filter for each hash."""
    return [stable_hash(hashes, salt) % np.uint64(bits) for salt in (11, 12)]


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return stable_hash(left, 21) * np.uint64(3) + stable_hash(right, 22)


def filter_of(frequent: DataFrame, pairs: bool, bits: int = FILTER_BITS) -> Filter:
    """The filter of a table of phrases (lang, phrase): single words, or pairs. Its bits are set side by side and joined; at most ``bits`` of them reach the driver."""

    def run(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = word_hashes(lang, phrase.split(" "))
                hashes.append(pair_hashes(h[:1], h[1:])[0] if pairs else h[0])
            at = np.concatenate([np.zeros(0, np.uint64), *places(np.array(hashes, np.uint64), bits)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words)


class Counter:
    """Counts phrases of some lengths for one task: cuts texts, fills a trie for each length, lets subtrees leave.

    Single words need no trie: their numbers are places in an array of counts.
    """

    schema = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("last", pa.string()), ("n", pa.int64())])

    def __init__(self, lengths: tuple[int, ...], words: Filter | None = None, pairs: Filter | None = None, limit: int = LIMIT, burst: int = BURST, stretch: int = STRETCH):
        self.lengths, self.frequent_words, self.frequent_pairs, self.limit, self.burst, self.stretch = lengths, words, pairs, limit, burst, stretch
        self.totals: dict[str, int] = {}
        self.waiting: dict[str, list[pa.Array]] = {}
        self.bytes: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[str, dict[str, int]] = {}
        self.names: list[str] = []
        self.langs: list[str] = []
        self.hashes = np.zeros(0, np.uint64)
        self.single = np.zeros(0, np.int64)
        self.tries = {k: HatTrie(k, self.burst) for k in self.lengths if k > 1}

    def add(self, texts: pa.Array, langs: pa.Array) -> Iterator[pa.RecordBatch]:
        """Texts wait until their language has enough of them, or all languages together have."""
        coded = pc.fill_null(langs, "und").dictionary_encode()
        codes = coded.indices.to_numpy()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            own = texts if len(coded.dictionary) == 1 else texts.filter(pa.array(codes == i))
            self.waiting.setdefault(lang, []).append(own)
            self.bytes[lang] = self.bytes.get(lang, 0) + own.nbytes
        full = [lang for lang, size in self.bytes.items() if size >= SLICE_BYTES]
        if not full and sum(self.bytes.values()) >= 4 * SLICE_BYTES:
            full = list(self.bytes)
        for lang in full:
            yield from self._add_waiting(lang)

    def _add_waiting(self, lang: str) -> Iterator[pa.RecordBatch]:
        self.bytes.pop(lang)
        words, _, piece = cut(pa.concat_arrays(self.waiting.pop(lang)), KINDS, lower=True)
        if 1 in self.lengths:
            self.totals[lang] = self.totals.get(lang, 0) + len(words)
        if len(words) <= self.stretch:
            yield from self._count(lang, words, piece, self.lengths)
            return
        for k in self.lengths:  # many words, so of one long text at least: stretches overlap by a phrase less one word
            for start in range(0, len(words), self.stretch):
                yield from self._count(lang, words.slice(start, self.stretch + k - 1), piece[start : start + self.stretch + k - 1], (k,))

    def _numbered(self, lang: str, names: list[str]) -> np.ndarray:
        """The number of each word, -1 for those that are not frequent; new ones are asked for once."""
        known = self.numbers.setdefault(lang, {})
        number = np.fromiter(map(known.get, names, repeat(-2)), np.int64, len(names))
        new = np.flatnonzero(number == -2)
        if not len(new):
            return number
        words = [names[i] for i in new.tolist()]
        asked = self.frequent_words or self.frequent_pairs
        hashes = word_hashes(lang, words) if asked else np.zeros(len(words), np.uint64)
        wanted = self.frequent_words.has(hashes) if self.frequent_words else np.ones(len(words), bool)
        number[new] = np.where(wanted, len(self.names) + np.cumsum(wanted) - 1, -1)
        known.update(zip(words, number[new].tolist()))
        kept = [words[i] for i in np.flatnonzero(wanted).tolist()]
        self.names += kept
        self.langs += [lang] * len(kept)
        self.hashes = np.concatenate([self.hashes, hashes[wanted]])
        self.single = np.concatenate([self.single, np.zeros(len(kept), np.int64)])
        return number

    def _count(self, lang: str, words: pa.Array, piece: np.ndarray, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        if not len(words):
            return
        coded = words.dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if sum(map(len, self.numbers.values())) + len(names) > 1 << BITS:
            yield from self._leave(0)
            self._restart()
        ids = self._numbered(lang, names)[at]
        linked = (piece[1:] == piece[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)  # a word and the next one may stand in a phrase
        if self.frequent_pairs and linked.any():
            i = np.flatnonzero(linked)
            linked[i] = self.frequent_pairs.has(pair_hashes(self.hashes[ids[i]], self.hashes[ids[i + 1]]))
        for k in lengths:
            if k == 1:
                self.single += np.bincount(ids[ids >= 0], minlength=len(self.single))
            elif len(ids) >= k:
                ok = linked[: len(ids) - k + 1].copy()
                for j in range(1, k - 1):
                    ok &= linked[j : len(ids) - k + 1 + j]
                begin = np.flatnonzero(ok)
                self.tries[k].add(*_distinct_rows(np.stack([ids[begin + j] for j in range(k)], axis=1), len(self.names)))
        if sum(t.size for t in self.tries.values()) > self.limit:
            yield from self._leave(self.limit // 2)

    def _leave(self, down_to: int) -> Iterator[pa.RecordBatch]:
        langs, words = pa.array(self.langs, pa.string()), pa.array(self.names, pa.string())
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        leaving = [(k, *trie.spill(down_to // len(self.tries))) for k, trie in self.tries.items()]
        if 1 in self.lengths:
            leaving.append((1, np.arange(len(words))[:, None], self.single))
            self.single = np.zeros_like(self.single)
        for k, keys, counts in leaving:
            keep = np.flatnonzero(counts)
            order = keep[np.lexsort([rank[keys[keep, i]] for i in range(k - 1, -1, -1)])]
            for start in range(0, len(order), SENT):
                some = order[start : start + SENT]
                parts = [words.take(pa.array(keys[some, i])) for i in range(k)]
                prefix = parts[0] if k <= 2 else pc.binary_join_element_wise(*parts[:-1], " ")
                last = pa.array([""] * len(some)) if k == 1 else parts[-1]
                yield record_batch(self.schema, [langs.take(pa.array(keys[some, 0])), prefix, last, counts[some]])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is left at the end of a task, and the number of all words by language under the empty phrase."""
        for lang in list(self.waiting):
            yield from self._add_waiting(lang)
        yield from self._leave(0)
        if self.totals:
            empty = [""] * len(self.totals)
            yield record_batch(self.schema, [list(self.totals), empty, empty, list(self.totals.values())])


def _distinct_rows(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order and their counts."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    k, wide = rows.shape[1], max(int(most).bit_length(), 1)
    if k * wide <= 63:
        code = rows[:, 0]
        for i in range(1, k):
            code = (code << wide) | rows[:, i]
        code, counts = np.unique(code, return_counts=True)
        return np.stack([(code >> (wide * (k - 1 - i))) & ((1 << wide) - 1) for i in range(k)], axis=1), counts
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def count_phrases(docs: DataFrame, lengths: tuple[int, ...], *, words: Filter | None = None, pairs: Filter | None = None, text: str = "text", lang: str = "lang", limit: int = LIMIT, burst: int = BURST, stretch: int = STRETCH) -> DataFrame:
    """lang, phrase and n: how often phrases of the given lengths occur; with filters, those of frequent words and pairs alone (and what the filters let through).

    Where single words are counted, the empty phrase has the number of all words of the language.
    """
    rows = text_rows(docs, F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((words and words.words, pairs and pairs.words))  # of FILTER_BITS each at most

    def run(batches):
        one, two = (None if x is None else Filter(x) for x in sent.value)
        counter = Counter(lengths, one, two, limit, burst, stretch)
        for texts, langs in text_slices(batches, ["text", "lang"]):
            yield from counter.add(texts, langs)
        yield from counter.rest()

    runs = rows.mapInArrow(run, "lang string, prefix string, last string, n bigint").withColumn("part", F.pmod(F.hash("last"), F.lit(PREFIX_PARTS)))
    sums = runs.repartition("lang", "prefix", "part").groupBy("lang", "prefix", "part", "last").agg(F.sum("n").alias("n"))
    return sums.select("lang", F.when(F.col("last") == "", F.col("prefix")).otherwise(F.concat_ws(" ", "prefix", "last")).alias("phrase"), "n")


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang", **more) -> DataFrame:
    """lang, phrase, size (in words; 0: all words of the language) and n of all phrases that occur at least ``least`` times."""
    keep = lambda df: materialize(df.filter((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")
    found = single = keep(count_phrases(docs, (1,), text=text, lang=lang, **more))
    if most_words > 1:
        words = filter_of(single.filter("phrase <> ''"), False)
        double = keep(count_phrases(docs, (2,), words=words, text=text, lang=lang, **more))
        found = found.unionByName(double)
        if most_words > 2:
            found = found.unionByName(keep(count_phrases(docs, tuple(range(3, most_words + 1)), words=words, pairs=filter_of(double, True), text=text, lang=lang, **more)))
    return found.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("size"), "n")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS, covered: int = 80, top: int = TOP, text: str = "text", lang: str = "lang", **more) -> DataFrame:
    """The best phrases of two words and more in each language: lang, rank, phrase, a (count), l and r (counts of the parts of the weakest cut), n (all words) and score.

    The score is floor(2000000 * a / (l + r)) at the cut where it is lowest (the first of equal ones). Phrases inside a longer frequent
    one with at least ``covered`` percent of their count are left out.
    """
    known = materialize(frequent_phrases(docs, least=least, most_words=most_words, text=text, lang=lang, **more), "frequent")
    totals = known.filter("size = 0").select("lang", F.col("n").alias("total"))
    counts = known.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    candidates = known.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))

    ws = F.split("phrase", " ")
    span = lambda start, size: F.array_join(F.slice(ws, start, size), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), span(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), span(k + 1, F.col("size") - k).alias("part"))))
    sides = candidates.select("lang", "phrase", "size", "a", F.explode(F.flatten(cuts)).alias("c")).select("lang", "phrase", "size", "a", "c.*").join(counts, ["lang", "part"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("of_part")))
    cut_counts = sides.groupBy("lang", "phrase", "size", "a", "k").agg(of(0).alias("l"), of(1).alias("r"))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    scored = cut_counts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")

    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: span(i, k))))
    longer = candidates.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * covered))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(32))
    best = whole.withColumn("__salt", salt).withColumn("__i", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).filter(F.col("__i") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # of 32 * top rows a language at most
    return ranked.join(totals.groupBy("lang").agg(F.sum("total").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
