"""Encoding and decoding with a public sentence-piece vocabulary, by a relational lattice over distinct words.

1. Texts are cut into words: a run of letters or a run of signs with the word marks before it, or a single
   digit. The classes of characters come from the vocabulary: signs are the characters that no piece holds
   next to a letter, so no piece crosses such a cut. Distinct words are counted.
2. Every word's substrings of bounded length are exploded and equi-joined with the piece table (32,000
   rows, broadcast). Matches are the lattice's edges, each packed into one number. Every edge carries its
   word's number. The rows of a word stay together on the way through the broadcast join, so they are
   grouped as they stream by, and the job fails should a number ever come back later: a shuffle or sort of the
   edges would cost many times the input. A higher-order aggregate folds each word's edges.
3. Texts are encoded by looking their words up: the most frequent words (FREQUENT at most, kept as plain
   number arrays) in a broadcast table, all others through a join that hands every document the ids of
   just its own rare words.

The public vocabulary is a byte-pair model: its pieces carry merge ranks, not probabilities, and the path
of the best score sum is not its encoding. So the fold over the lattice is not Viterbi: it takes the edges
from the best rank to the worst and joins two neighbours wherever an edge spans exactly the two. That
equals merging the best pair first as long as every piece encodes to itself, which is checked when the
table is loaded. A word's cuts are bits of one number, so words are folded up to MAX_WORD characters; the
few longer ones, and words behind a run of MAX_MARKS spaces (whose pieces all have one rank), are encoded
by the sentencepiece library.

Edge cases: a null or empty text has no ids and decodes to the empty text; characters without a piece
become bytes; repeated rows are encoded each; empty tables give empty results; extra columns are not touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.llm.chunks import distinct, group_starts, make_room, spans
from contourlake.llm.common import materialize, record_batch, text_rows, text_slices

DEFAULT_MODEL = "piece_bpe_32k.model"
MARK = "▁"
DIGITS = "0-9"
#: Stands between the chunks of several texts; no text holds it.
BETWEEN = "\ud800"
#: Longest word that is folded in Spark.
MAX_WORD = 60
#: Runs of this many marks are not folded: their pieces have equal ranks, so the order of joins would matter.
MAX_MARKS = 15
#: Most words in the broadcast table; a word takes about 20 bytes there.
FREQUENT = 5_000_000
#: Places of an edge's parts in its number: rank, start, end and id + 1 (0: a character without a piece).
RANK, START, END, ID_BITS = 33, 27, 21, 21
#: Rank of single characters, behind all others: they join nothing.
LAST_RANK = (1 << 30) - 1


@dataclass
class Pieces:
    """The piece table: text, rank (0: best; equal scores, equal ranks) and id of ordinary pieces; the id of byte 0; the longest piece; the signs."""

    rows: list[tuple[str, int, int]]
    first_byte: int
    longest: int
    model: str
    signs: str

    @property
    def word(self) -> str:
        """The pattern of a word, as Java and Python read it."""
        signs = "".join(f"\\u{ord(c):04x}" for c in self.signs)
        signs_run = f"|{MARK}*[{signs}]+" if signs else ""
        return f"{MARK}*+(?:[A-Za-z]++|[^{signs}{DIGITS}{MARK}\n])++|\n{signs_run}|[{DIGITS}]|{MARK}+"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "piece string, rank long, id long")


def load(model: str = DEFAULT_MODEL) -> Pieces:
    """Read a vocabulary and check what the lattice relies on."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    ids = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i), sp.get_score(i), i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    octets = [i for i in ids if sp.is_byte(i)]
    if len(ids) > 1 << 16:
        raise ValueError("ids do not fit into 16 bits")
    if octets != list(range(octets[0], octets[0] + 256)):
        raise ValueError("the vocabulary has no run of 256 byte pieces")
    for piece, _, i in plain:
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {i} crosses a word")
    order = {s: r for r, s in enumerate(sorted({s for _, s, _ in plain}, reverse=True))}
    plain = [(p, order[s], i) for p, s, i in plain]
    ranks = {p: r for p, r, _ in plain}
    for piece, _, i in plain:
        if len(piece) > 1 and folded(piece) and fold_word(piece, ranks) != [piece]:
            raise ValueError(f"piece {i} does not encode to itself")
    if any(len(p) > 1 and any(c in "0123456789" for c in p) for p in ranks):
        raise ValueError("a piece joins digits")
    return Pieces(plain, octets[0], max(map(len, ranks)), model, _signs(ranks))


def _signs(pieces) -> str:
    """The characters of the basic plane in pieces of several that no chain of neighbours within a piece leads to a letter."""
    linked: dict[str, str] = {}

    def first(c: str) -> str:
        while linked.setdefault(c, c) != c:
            c = linked[c]
        return c

    for piece in (p.lstrip(MARK) for p in pieces if len(p) > 1):
        for c in piece:
            linked[first(c)] = first(piece[0])
    letters = {first(c) for c in list(linked) if c.isalpha() or ord(c) > 0xFFFF}
    return "".join(sorted(c for c in linked if first(c) not in letters))


def folded(word: str) -> bool:
    """Whether a word is folded; all others are left to the library."""
    return len(word) <= MAX_WORD and not word.startswith(MARK * MAX_MARKS)


def fold_word(word: str, ranks: dict[str, int]) -> list[str]:
    """The fold of one word in plain Python; what the Spark expression is checked against."""
    edges = sorted((ranks[word[s:e]], s, e) for s in range(len(word)) for e in range(s + 2, len(word) + 1) if word[s:e] in ranks)
    cuts = set(range(len(word) + 1))
    for _, s, e in edges:
        inner = [c for c in range(s + 1, e) if c in cuts]
        if s in cuts and e in cuts and len(inner) == 1:
            cuts.discard(inner[0])
    ordered = sorted(cuts)
    return [word[a:b] for a, b in zip(ordered[:-1], ordered[1:])]


def marked(text: Column) -> Column:
    """The text as the vocabulary sees it: spaces as marks, one more in front."""
    return F.when(F.length(text) > 0, F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))).otherwise(F.lit(""))


#: Texts where a run of marks may cross a space.
UNEVEN = f"  |^ | $|{MARK}"


def word_counts(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """Distinct words of all texts and how often they occur. What stands between two spaces is counted first, so that each such chunk is cut into words once."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = lambda c: F.regexp_extract_all(c, F.lit(pieces.word), F.lit(0))
    uneven = value.rlike(UNEVEN) | (value == "")  # in filters of their own: beside an explode it would be tried once a chunk
    whole = docs.filter(uneven).select(F.explode(words(marked(value))).alias("chunk"))
    even = docs.filter(~uneven).select(F.explode(F.split(value, " ")).alias("part")).select(F.concat(F.lit(MARK), F.col("part")).alias("chunk"))
    chunks = even.unionByName(whole).groupBy("chunk").count()
    return chunks.select(F.explode(words(F.col("chunk"))).alias("word"), "count").groupBy("word").agg(F.sum("count").alias("count"))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word and its edges (array of packed numbers) for every word that is folded.

    The first row of a word is its first character's, which is always there; it carries the word.
    """
    n = F.length("word")
    each = words.filter((n <= MAX_WORD) & (n > 0) & ~F.col("word").startswith(MARK * MAX_MARKS)).select("word", F.monotonically_increasing_id().alias("number"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s")))).alias("k"))
    each = each.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("k")))
    found = each.join(F.broadcast(pieces.frame(words.sparkSession)), "piece", "left").filter("id is not null or k = 1")
    edge = F.expr(f"shiftleft(if(k = 1, {LAST_RANK}L, rank), {RANK}) + shiftleft(bigint(s), {START}) + shiftleft(bigint(s + k), {END}) + coalesce(id + 1, 0L)")
    rows = found.select("number", F.when((F.col("s") == 0) & (F.col("k") == 1), F.col("word")).alias("word"), edge.alias("edge"))
    return rows.mapInArrow(_grouped, "word string, edges array<long>")


def _grouped(batches):
    """One row per word from the rows of its edges, which follow one another; a word cut by a batch's end waits for the next."""
    schema = pa.schema([("word", pa.string()), ("edges", pa.list_(pa.int64()))])
    carry, last = None, -1
    for batch in chain(batches, [None]):
        block = carry if batch is None else batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        if block is None or not block.num_rows:
            continue
        number = block.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        if number[0] <= last or (np.diff(number) < 0).any() or block.column(1).take(pa.array(first)).null_count:
            raise RuntimeError("the edges of a word came apart")
        end = block.num_rows if batch is None else int(first[-1])
        carry = None if batch is None else block.slice(end)
        first = first[first < end]
        if len(first):
            last = number[first[-1]]
            offsets = pa.array(np.append(first, end), pa.int32())
            edges = pa.ListArray.from_arrays(offsets, block.column(2).slice(0, end))
            yield pa.RecordBatch.from_arrays([block.column(1).take(pa.array(first)), edges], schema=schema)


def fold(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """word and its ids (array of int)."""
    everything = F.expr("shiftleft(1L, length(word) + 1)") - F.lit(1).cast("bigint")
    one = F.lit(1).cast("bigint")
    shift = lambda x, c: F.call_function("shiftleft", x, c.cast("int"))
    part = lambda x, at, bits: F.shiftright(x, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    start, end = (lambda x: part(x, START, 6)), (lambda x: part(x, END, 6))
    outer = lambda x: shift(one, start(x)).bitwiseOR(shift(one, end(x)))
    inner = lambda x: (shift(one, end(x)) - one).bitwiseAND(F.bitwise_not(shift(one, start(x) + 1) - one))

    def join_pair(cuts, x):
        fits = (cuts.bitwiseAND(outer(x)) == outer(x)) & (F.bit_count(cuts.bitwiseAND(inner(x))) == 1)
        return F.when(fits, cuts.bitwiseAND(F.bitwise_not(inner(x)))).otherwise(cuts)

    def ids_of(x):
        codes = F.hex(F.encode(F.substring(F.col("word"), (start(x) + 1).cast("int"), F.lit(1)), "UTF-8"))
        octets = F.transform(F.sequence(F.lit(0), (F.length(codes) / 2).cast("int") - 1), lambda i: (F.conv(F.substring(codes, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + pieces.first_byte))
        number = part(x, 0, ID_BITS)
        return F.when(number == 0, octets).otherwise(F.array((number - 1).cast("int")))

    ordered = edges.withColumn("m", F.sort_array("edges"))  # single characters, as many as the word has, come last
    folded_ = ordered.withColumn("cuts", F.aggregate(F.slice("m", F.lit(1), F.size("m") - F.length("word")), everything, join_pair))
    kept = F.filter("m", lambda x: (F.col("cuts").bitwiseAND(outer(x)) == outer(x)) & (F.col("cuts").bitwiseAND(inner(x)) == 0))
    placed = F.sort_array(F.transform(kept, lambda x: F.struct(start(x).alias("s"), x.alias("x"))))
    return folded_.withColumn("kept", placed).select("word", F.flatten(F.transform("kept", lambda k: ids_of(k["x"]))).alias("ids"))


def dictionary(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word and ids of each distinct word that is folded."""
    return fold(lattice(words, pieces), pieces)


@dataclass
class WordIds:
    """Ids of many words in number arrays: hashes in order, where each word's ids begin and how many they are, and all ids."""

    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    @staticmethod
    def from_parts(parts: list) -> WordIds:
        """From rows of (hashes, sizes, ids) as bytes, one per partition; the ids stay where they are."""
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(p[name], kind) for p in parts)])
        hashes, sizes = join("hashes", np.uint64), join("sizes", np.uint8)
        order = np.argsort(hashes, kind="stable")
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.uint32)
        return WordIds(hashes[order], starts[order], sizes[order], join("ids", np.uint16))

    def find(self, words: list[str]) -> np.ndarray:
        """Start and number of each word's ids; -1 where it is not known."""
        if not len(self.hashes):
            return np.full((len(words), 2), -1, np.int64)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = np.stack([self.starts[at], self.sizes[at]], axis=1).astype(np.int64)
        return np.where((self.hashes[at] == h)[:, None], found, -1)


class WordCutter:
    """The words of texts as an Arrow batch holds them, each distinct chunk between two spaces cut once."""

    def __init__(self, word: str):
        self.word = re.compile(f"{BETWEEN}|" + word.replace("[^", f"[^{BETWEEN}"))

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, all texts' words as numbers of these, and how many words each text has."""
        texts = pc.fill_null(texts, "")
        uneven = np.asarray(pc.match_substring_regex(texts, UNEVEN)) | (np.asarray(pc.binary_length(texts)) == 0)
        parts = pc.split_pattern(texts, " ")
        names, codes = distinct(parts.flatten())
        per_text = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        found = self.word.findall(BETWEEN.join(MARK + n for n in names))
        table = {w: i for i, w in enumerate(dict.fromkeys(found))}
        at = np.fromiter(map(table.__getitem__, found), np.int64, len(found))
        between = np.cumsum(at == table[BETWEEN]) if BETWEEN in table else np.zeros(len(at), np.int64)
        real = at != table.get(BETWEEN, -1)
        at, size = at[real], np.bincount(between[real], minlength=len(names))
        words = at[spans(group_starts(size)[codes], size[codes])]
        lengths = np.bincount(np.repeat(np.arange(len(texts)), per_text), weights=size[codes], minlength=len(texts)).astype(np.int64)
        if uneven.any():  # runs of spaces are one word's marks
            cuts = np.split(words, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(uneven).tolist():
                text = texts[i].as_py()
                own = self.word.findall(MARK + text.replace(" ", MARK)) if text else []
                cuts[i] = np.array([table.setdefault(w, len(table)) for w in own], np.int64)
                lengths[i] = len(own)
            words = np.concatenate(cuts)
        return ["" if w == BETWEEN else w for w in table], words, lengths


def _packed(batches):
    """One row per partition: hashes (64 bits), numbers of ids (8 bits: at most four a character) and ids (16 bits) of all its words."""
    schema = pa.schema([("hashes", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])
    hashes, sizes, ids = [], [], []
    for batch in batches:
        words, lists = batch.column(0).to_pylist(), batch.column(1)
        hashes.append(np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).tobytes())
        sizes.append(np.diff(lists.offsets.to_numpy()).astype(np.uint8).tobytes())
        ids.append(lists.flatten().to_numpy().astype(np.uint16).tobytes())
    if hashes:
        yield record_batch(schema, [[b"".join(hashes)], [b"".join(sizes)], [b"".join(ids)]])


def _rare_words(frequent, word: str):
    schema = pa.schema([("doc_id", pa.int64()), ("word", pa.string())])

    def run(batches):
        make_room()
        cutter = WordCutter(word)
        for texts, ids in text_slices(batches, ("text", "doc_id")):
            names, words, lengths = cutter.cut(texts)
            if not len(words):
                continue
            lost = (frequent.value.find(names)[:, 0] < 0) & np.fromiter(map(folded, names), bool, len(names))
            pairs = np.unique(np.stack([np.repeat(np.arange(len(texts)), lengths)[lost[words]], words[lost[words]]], axis=1), axis=0)
            if len(pairs):
                yield record_batch(schema, [ids.take(pa.array(pairs[:, 0])), [names[i] for i in pairs[:, 1].tolist()]])

    return run


def _encode(frequent, model: str, word: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    library = []

    def elsewhere(word: str, own: dict) -> np.ndarray:
        """Ids of a word that the broadcast table lacks: a rare one of the document's own, or one that is not folded."""
        if word in own:
            return own[word]
        if not library:
            library.append(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model)))
        return np.array(library[0].encode("\n" + word)[2:], np.uint32)  # behind a line end no mark is put in front; the first two ids are those of a mark and the line end

    def run(batches):
        make_room()
        cutter = WordCutter(word)
        for texts, ids, rare in text_slices(batches, ("text", "doc_id", "rare")):
            names, words, lengths = cutter.cut(texts)
            table = frequent.value
            rows = table.find(names)[words] if names else np.zeros((0, 2), np.int64)
            owner, missing = np.repeat(np.arange(len(texts)), lengths), rows[:, 0] < 0
            sizes = np.where(missing, 0, rows[:, 1])
            known = table.ids[spans(np.maximum(rows[:, 0], 0), sizes)].astype("<u4")
            ends = np.cumsum(np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64))
            out, data = [], known.tobytes()
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                out.append(data[4 * a : 4 * b])
            starts = group_starts(lengths)
            for i in np.unique(owner[missing]).tolist():  # documents with words of their own
                r = rows[starts[i] : starts[i] + lengths[i]]
                own, parts, last = {m["word"]: np.array(m["ids"], np.uint32) for m in rare[i].as_py() or ()}, [], 0
                for k in np.flatnonzero(r[:, 0] < 0).tolist():
                    parts += [table.ids[spans(r[last:k, 0], r[last:k, 1])], elsewhere(names[words[starts[i] + k]], own)]
                    last = k + 1
                parts.append(table.ids[spans(r[last:, 0], r[last:, 1])])
                out[i] = np.concatenate(parts).astype("<u4").tobytes()
            yield record_batch(schema, [ids, out])

    return run


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL, frequent: int = FREQUENT, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of every row; ``decoded`` adds the text they stand for, in the same pass."""
    spark = docs.sparkSession
    pieces = load(model)
    rows = text_rows(docs, F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    counts = materialize(word_counts(rows, pieces), "words")
    n = counts.count()
    table = materialize(dictionary(counts.select("word"), pieces), "word-ids")
    top = table
    if n > frequent:  # words at least as frequent as the last that fits
        least = counts.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.desc("count")).collect()
        total, bound = 0, None
        for r in least:
            total += r["words"]
            if total > frequent:
                break
            bound = r["count"]
        top = table.join(counts.filter(F.col("count") >= bound).select("word"), "word", "left_semi") if bound else table.limit(0)
    known = spark.sparkContext.broadcast(WordIds.from_parts(top.select("word", "ids").mapInArrow(_packed, "hashes binary, sizes binary, ids binary").collect()))
    if n > frequent:
        pairs = rows.mapInArrow(_rare_words(known, pieces.word), "doc_id long, word string")
        rare = pairs.join(table, "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
        rows = rows.join(rare, "doc_id", "left").select("text", "doc_id", "rare")
    else:
        rows = rows.withColumn("rare", F.lit(None).cast("array<struct<word:string,ids:array<int>>>"))
    run = _encode(known, model, pieces.word)
    if not decoded:
        return rows.mapInArrow(run, "doc_id long, ids binary")
    back = _decode(pieces)
    return rows.mapInArrow(lambda batches: back(run(batches)), "doc_id long, ids binary, text string")


def _decode(pieces: Pieces):
    table = [b""] * (max(max(i for _, _, i in pieces.rows), pieces.first_byte + 255) + 1)
    for piece, _, i in pieces.rows:
        table[i] = piece.replace(MARK, " ").encode()
    for b in range(256):
        table[pieces.first_byte + b] = bytes([b])
    sizes = np.array([len(t) for t in table], np.int64)
    octets, starts = np.frombuffer(b"".join(table), np.uint8), group_starts(sizes)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        for batch in (b for b in batches if b.num_rows):
            found = batch.column(1).to_pylist()
            each = np.frombuffer(b"".join(x or b"" for x in found), "<u4")
            data = octets[spans(starts[each], sizes[each])].tobytes()
            ends = np.append(0, np.cumsum(sizes[each]))[np.cumsum([len(x or b"") // 4 for x in found])].tolist()
            texts = [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip([0, *ends[:-1]], ends)]
            yield record_batch(schema, [batch.column(0), batch.column(1), texts])

    return run


def decode(encoded: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids and the text they stand for."""
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_decode(load(model)), "doc_id long, ids binary, text string")
