"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise part is computed in time linear in the number of features through the identity
``sum_{i<j} <v_i,v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]``.

Features: words and word shapes hashed into buckets (square-root counts, scaled to length 1 a text),
structure statistics (cases, symbols, digits, lines, repeats) and metadata known without labels (length).
Labels, language, source and id are never inputs. Trained with Adam in numpy on a bounded sample.

Edge cases: null and empty texts have zero features and get the score of the bias; empty tables give
empty results; several labels of one id are averaged, and of several texts of one labelled id one is learnt from
(that of the smallest hash); repeated rows are scored each; extra columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contourlake.llm.chunks import CharClasses, code_points, distinct, group_starts, make_room, split_all, stable_hash
from contourlake.llm.common import hash_fraction, record_batch, text_rows, text_slices

BUCKETS = 4096
#: Structure statistics and metadata, in this order behind the hashed buckets.
STATS = ("log_chars", "log_words", "mean_word", "upper_share", "digit_share", "symbol_share", "punct_share", "upper_words", "symbol_words", "bare_symbol_words", "distinct_words", "line_words", "distinct_lines", "text_seen")
#: Signs that are no symbols.
MARKS = ".,;:'\"()-"
#: A number for each kind of sign; what is none of these is a symbol.
SMALL, CAPITAL, OTHER_LETTER, DIGIT, MARK, BLANK, SYMBOL = range(7)


def _kind(c: str) -> int:
    if c.isalpha():
        return SMALL if c.islower() else CAPITAL if c.isupper() else OTHER_LETTER
    return DIGIT if c.isdigit() else MARK if c in MARKS else BLANK if c.isspace() or c.isalnum() else SYMBOL


_KINDS = CharClasses(_kind)


@dataclass
class QualityModel:
    """Bias, linear weights, factors, and the mean and spread of the statistics of the training rows."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The machine's value of dense rows."""
        s = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((s * s).sum(axis=1) - (x * x) @ (self.factors**2).sum(axis=1))

    def score(self, found: Features) -> np.ndarray:
        """The score of each text; work in proportion to the buckets that occur."""
        stats = self.scaled(found.stats)
        sums = np.zeros((len(stats), self.factors.shape[1] + 2))
        if len(found.value):
            v, x = self.factors[found.bucket], found.value[:, None]
            parts = np.concatenate([v * x, (v * v).sum(axis=1, keepdims=True) * x * x, self.linear[found.bucket, None] * x], axis=1)
            some = np.flatnonzero(found.counts)
            sums[some] = np.add.reduceat(parts, group_starts(found.counts)[some], axis=0)
        v, w = self.factors[BUCKETS:], self.linear[BUCKETS:]
        s = sums[:, :-2] + stats @ v
        z = self.bias + sums[:, -1] + stats @ w + 0.5 * ((s * s).sum(axis=1) - sums[:, -2] - (stats * stats) @ (v * v).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -5, 5) * (stats[:, -1:] > 0) * 0.3


@dataclass
class Features:
    """Buckets and values of all texts one after another, how many each text has, and the statistics (texts x len(STATS))."""

    bucket: np.ndarray
    value: np.ndarray
    counts: np.ndarray
    stats: np.ndarray


def _word_hashes(codes: np.ndarray, owner: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each word's codes in their order."""
    lengths = np.bincount(owner, minlength=n)
    starts = group_starts(lengths)
    powers = np.cumprod(np.full(max(1, int(lengths.max(initial=1))), _BASE, np.uint64), dtype=np.uint64)
    weighed = (codes.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(codes)) - starts[owner]]
    return stable_hash(np.add.reduceat(weighed, starts), salt)


_BASE = np.uint64(0x9DDFEA08EB382D69)


def word_rows(words: list[str]) -> np.ndarray:
    """Two buckets (the word, and its shape: runs of one kind of letters, of digits or of one sign as one) and the counts of characters,
    capitals, digits, symbols and other marks of each word, and whether it is all capitals or has symbols alone."""
    n = len(words)
    codes, owner = code_points(words)
    kind = _KINDS.of(codes)
    count = lambda *kinds: np.bincount(owner, weights=np.isin(kind, kinds), minlength=n).astype(np.int64)
    sizes, capitals, digits, symbols = np.bincount(owner, minlength=n), count(CAPITAL), count(DIGIT), count(SYMBOL)
    letters = count(SMALL, CAPITAL, OTHER_LETTER)
    shape = np.where(kind >= MARK, codes, np.where(kind == OTHER_LETTER, CAPITAL, kind))
    new = np.ones(len(codes), bool)
    new[1:] = (shape[1:] != shape[:-1]) | (owner[1:] != owner[:-1])
    buckets = [(h % np.uint64(BUCKETS)).astype(np.int64) for h in (_word_hashes(codes, owner, n, 1), _word_hashes(shape[new], owner[new], n, 2))]
    return np.stack([*buckets, sizes, capitals, digits, symbols, sizes - letters - digits - symbols, (letters > 1) & (capitals == letters), (symbols > 0) & (letters + digits == 0)], axis=1)


def features(texts: pa.Array) -> Features:
    """Square-root bucket counts scaled to length 1 a text, and the statistics; nothing where there is no word."""
    words, lengths = split_all(texts, unicode=True)
    stats, none = np.zeros((len(texts), len(STATS))), np.zeros(0, np.int64)
    if not len(words):
        return Features(none, none.astype(float), np.zeros(len(texts), np.int64), stats)
    names, codes = distinct(words)
    known = word_rows(names)
    rows = known[codes]
    owner, some = np.repeat(np.arange(len(texts)), lengths), lengths > 0
    cells, times = np.unique(np.concatenate([owner * BUCKETS + rows[:, c] for c in (0, 1)]), return_counts=True)
    whose, bucket = cells // BUCKETS, cells % BUCKETS
    value = np.sqrt(times / (2.0 * lengths[whose]))  # the squares of a text's counts' roots add up to two a word
    starts = group_starts(lengths)[some]
    sums = np.add.reduceat(rows[:, 2:].astype(np.float64), starts, axis=0)
    n, chars = lengths[some].astype(float), np.maximum(sums[:, 0], 1)
    with_symbols = np.add.reduceat((rows[:, 5] > 0).astype(np.float64), starts)
    pairs = np.unique(owner * np.int64(len(names)) + codes)
    kinds = np.bincount(pairs // len(names), minlength=len(texts))[some]
    lines = [[y for y in t.split("\n") if y and not y.isspace()] if t else [] for t in texts.to_pylist()]
    n_lines = np.array([max(1, len(v)) for v in lines], float)[some]
    line_kinds = np.array([max(1, len(set(v))) for v in lines], float)[some]
    columns = (np.log1p(chars), np.log1p(n), chars / n, sums[:, 1] / chars, sums[:, 2] / chars, sums[:, 3] / chars, sums[:, 4] / chars, sums[:, 5] / n, with_symbols / n, sums[:, 6] / n, kinds / n, np.log1p(n / n_lines), line_kinds / n_lines, np.ones(len(n)))
    stats[some] = np.stack(columns, axis=1)
    return Features(bucket, value, np.bincount(whose, minlength=len(texts)), stats)


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 4000, factors: int = 8, steps: int = 250, seed: int = 5) -> QualityModel:
    """Train on about ``max_rows`` labelled ids, a text each, picked by a hash of the id, half of either label where there are as many.

    Only rows for which ``usable`` (a condition on the id) holds are learnt from.
    """
    marks = labels.filter(usable & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(label).alias("mark"))
    sizes = {r["high"]: r["count"] for r in marks.groupBy((F.col("mark") >= 0.5).alias("high")).count().collect()}
    share = F.when(F.col("mark") >= 0.5, min(1.0, max_rows / 2 / sizes.get(True, 1))).otherwise(min(1.0, max_rows / 2 / sizes.get(False, 1)))
    picked = marks.filter(hash_fraction(seed, "doc_id") < share)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = texts.filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")  # about max_rows ids
    rows = found.groupBy("doc_id").agg(F.min_by(F.struct("text", "mark"), F.xxhash64("text")).alias("one")).select("doc_id", "one.*")

    schema = pa.schema([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("stats", pa.list_(pa.float64())), ("mark", pa.float64()), ("doc_id", pa.int64())])

    def run(batches):
        make_room()
        for texts, marks, ids in text_slices(batches, ("text", "mark", "doc_id")):
            made = features(texts)
            cut = np.cumsum(made.counts)[:-1]
            yield record_batch(schema, [np.split(made.bucket.astype(np.int32), cut), np.split(made.value, cut), list(made.stats), marks, ids])

    found = text_rows(rows, "text", "mark", F.col("doc_id").cast("long")).mapInArrow(run, "at array<int>, x array<double>, stats array<double>, mark double, doc_id long").toArrow().sort_by("doc_id")
    x = np.zeros((found.num_rows, BUCKETS + len(STATS)), np.float32)
    for i, (a, v, s) in enumerate(zip(found["at"].to_pylist(), found["x"].to_pylist(), found["stats"].to_pylist())):
        x[i, a], x[i, BUCKETS:] = v, s
    y = np.array(found["mark"].to_pylist(), np.float64)
    high, low = sizes.get(True, 0), sizes.get(False, 0)
    return fit_factorisation_machine(x, y, high / max(1, high + low), factors=factors, steps=steps, seed=seed)


def fit_factorisation_machine(x: np.ndarray, y: np.ndarray, prior: float, *, factors: int, steps: int, seed: int, rate: float = 0.02, shrink: float = 1e-3) -> QualityModel:
    """Adam on the log loss, rows weighted so that both labels count the same.

    The bias is not moved back to the share of either label: a score of 0.5 separates the two kinds
    with equal care. ``prior`` is only the score given when there is nothing to learn from.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1] if len(x) else BUCKETS + len(STATS)
    model = QualityModel(0.0, np.zeros(width), rng.normal(0, 0.01, (width, factors)), np.zeros(len(STATS)), np.ones(len(STATS)))
    if not len(y) or y.min() == y.max():
        model.bias, model.factors[:] = float(np.clip(np.log((prior + 1e-3) / (1 - prior + 1e-3)), -4, 4)), 0
        return model
    model.mean, model.spread = x[:, BUCKETS:].mean(axis=0), x[:, BUCKETS:].std(axis=0) + 1e-3
    model.mean[-1], model.spread[-1] = 0, 1
    x = np.concatenate([x[:, :BUCKETS], model.scaled(x[:, BUCKETS:])], axis=1).astype(np.float32)
    squared = x * x
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    state = {"bias": np.zeros(1), "linear": model.linear.astype(np.float32), "factors": model.factors.astype(np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in state.items()} for _ in range(2))
    for t in range(1, steps + 1):
        w, v = state["linear"], state["factors"]
        s = x @ v
        z = state["bias"] + x @ w + 0.5 * ((s * s).sum(axis=1) - squared @ (v * v).sum(axis=1))
        g = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight).astype(np.float32)
        grads = {"bias": np.array([g.sum()]), "linear": x.T @ g + shrink * w / 10, "factors": x.T @ (g[:, None] * s) - v * (squared.T @ g)[:, None] + shrink * v / 10}
        for k, grad in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            state[k] = state[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(float(state["bias"][0]), state["linear"].astype(np.float64), state["factors"].astype(np.float64), model.mean, model.spread)


def _score(model: QualityModel):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        make_room()
        for texts, ids in text_slices(batches, ("text", "doc_id")):
            yield record_batch(schema, [ids, model.score(features(texts))])

    return run


def score_quality(docs: DataFrame, model: QualityModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier), one row per input row."""
    rows = text_rows(docs, F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    return rows.mapInArrow(_score(model), "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows scored at least ``least``, with all their columns."""
    score = _score(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            plain = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(batch.num_rows))], ["text", "doc_id"])
            kept = np.concatenate([np.zeros(0, bool), *(b.column(1).to_numpy() >= least for b in score([plain]))])
            yield batch.filter(pa.array(kept))

    return text_rows(docs, *docs.columns).mapInArrow(run, docs.schema)
