"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear layer and a softmax
give the languages. Embeddings and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows. Part of the sample is held back (a small one is held back part by
part, with a model each) to fit a temperature, so that scores are calibrated.

A prediction is rejected for one of two reasons, each with a limit that half of REJECTED of the rightly
predicted rows held back fall under: a low score, or n-grams too rare in the sample for the predicted language. The
second is the mean log frequency of the text's n-grams, as a deviation from what is usual in the language,
measured against the scatter of texts of that length; it tells text of a language that was not learnt, and
letters without a language, where the softmax is sure of one of its few languages.

Since everything before the softmax is linear, the two matrices are folded into one row of language
weights per hash bucket, and each distinct chunk of text is scored once per worker.

Edge cases: a null text or one without a letter gives ``und`` with score 0; empty tables give empty
results; repeated rows are scored each; extra columns are not touched; without any labelled row every
text gives ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contourlake.llm.chunks import CharClasses, ChunkTable, code_points, distinct, group_starts, make_room, shared_table, spans, split_all, stable_hash
from contourlake.llm.common import hash_fraction, record_batch, remainder, text_rows, text_slices

UNKNOWN = "und"
#: 1 for letters of any script (Unicode classes Lu, Ll, Lt, Lm, Lo): neither digits nor fractions, circled or Roman numerals.
_LETTERS = CharClasses(lambda c: int(c.isalpha()))
SIZES = (1, 2, 3, 4)
#: Small samples are gone through more often, up to about this many steps.
LEAST_STEPS = 1500
#: Share of the rightly predicted rows held back that the two limits reject, half of it each.
REJECTED = 0.005
#: Parts of the sample held back in turn: all for the n-gram frequencies, and for the scores where the sample has fewer rows than SMALL, else only the first.
PARTS, SMALL = 5, 2000


@dataclass
class Familiar:
    """Log frequencies of the buckets, their usual mean in each language, the variances among texts and among n-grams, and the least deviation."""

    logs: np.ndarray
    usual: np.ndarray
    among_texts: float
    among_grams: float
    least: float

    def deviations(self, means: np.ndarray, counts: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """How far the texts' mean log frequencies are from the usual of their languages, in standard deviations; n-grams of one letter count once."""
        return (means - self.usual[languages]) / np.sqrt(self.among_texts + self.among_grams * len(SIZES) / np.maximum(counts, 1))


@dataclass
class LanguageModel:
    """Folded weights (buckets x languages), bias, temperature, the score under which a text is rejected, and what tells unfamiliar texts."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    key: int
    familiar: Familiar

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def subword_buckets(chunks: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams of the chunks' letters between word marks, and how many each chunk has."""
    letters, owner = code_points([c.lower() for c in chunks])
    known = _LETTERS.of(letters) == 1
    letters, owner = letters[known], owner[known]
    n = np.bincount(owner, minlength=len(chunks))
    lengths = np.where(n > 0, n + 2, 0)
    starts = group_starts(lengths)
    codes = np.full(int(lengths.sum()), ord(">"), np.uint64)
    codes[starts[n > 0]] = ord("<")
    codes[spans(starts[n > 0] + 1, n[n > 0])] = letters
    ends = np.repeat(np.cumsum(lengths), lengths)
    at, owner = np.arange(len(codes)), np.repeat(np.arange(len(chunks)), lengths)
    found, whose = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        fits = at + n <= ends
        step = np.zeros(len(codes), np.uint64)
        step[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        rolling = rolling * np.uint64(1_000_003) + step
        if n in SIZES:
            found.append((stable_hash(rolling[fits], n) % np.uint64(buckets)).astype(np.int64))
            whose.append(owner[fits])
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return found[order], np.bincount(whose, minlength=len(chunks))


def _bags(buckets: int):
    """Per row of (label, text): the label and its bag of subword buckets (bucket numbers, counts)."""
    schema = pa.schema([("label", pa.string()), ("bucket", pa.list_(pa.int32())), ("times", pa.list_(pa.float32()))])

    def run(batches):
        make_room()
        for texts, labels in text_slices(batches, ("text", "label")):
            out = []
            for i in range(len(texts)):
                chunks, _ = split_all(texts.slice(i, 1), unicode=True)
                found, _ = subword_buckets(chunks.to_pylist(), buckets)
                out.append(np.unique(found, return_counts=True))
            yield record_batch(schema, [labels, [b.astype(np.int32) for b, _ in out], [n.astype(np.float32) for _, n in out]])

    return run


def train_language_id(docs: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, max_rows: int = 6000, buckets: int = 8192, dim: int = 16, epochs: int = 40, seed: int = 11) -> LanguageModel:
    """Train on about ``per_language`` rows of each language, fewer where that makes more than ``max_rows`` in all.

    The sample is picked by a hash of id and text, rows that agree in both counting once, so it is the same in
    every run and bounded whatever repeats; ``usable`` says which rows may be learnt from.
    """
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0, seed, Familiar(np.zeros(buckets, np.float32), np.zeros(0), 1.0, 1.0, -np.inf))
    if len(languages) > max_rows:
        raise ValueError(f"{len(languages)} languages; max_rows = {max_rows} leaves less than a row for each")
    share = docs.sparkSession.createDataFrame([(k, min(per_language, max_rows / len(counts)) / n) for k, n in counts.items()], "label string, share double")
    sample = rows.join(F.broadcast(share), "label").filter(hash_fraction(seed, "doc_id", "text") < F.col("share"))  # one row a language
    picked = text_rows(sample.groupBy("doc_id", "text", "label").count(), "text", "label")
    bags = picked.mapInArrow(_bags(buckets), "label string, bucket array<int>, times array<float>").toArrow()
    x = np.zeros((bags.num_rows, buckets), np.float32)
    for i, (b, n) in enumerate(zip(bags["bucket"].to_pylist(), bags["times"].to_pylist())):
        x[i, b] = n
    counts = x.sum(axis=1)
    x /= np.maximum(counts[:, None], 1)
    y = np.array([languages.index(v) for v in bags["label"].to_pylist()], np.int64)
    return fit_language_model(x, y, counts, languages, dim=dim, epochs=epochs, seed=seed)


def fit_language_model(x: np.ndarray, y: np.ndarray, counts: np.ndarray, languages: list[str], *, dim: int, epochs: int, seed: int) -> LanguageModel:
    """The softmax model; temperature and rejection come from rows held back. ``counts`` are the n-grams of each row."""
    n, k = len(y), len(languages)
    order = np.lexsort((np.arange(n), x @ np.random.default_rng(seed).random(x.shape[1]).astype(np.float32)))  # the same whatever order the rows came in
    x, y, counts = x[order], y[order], counts[order]
    part = np.arange(n) % PARTS
    fit = lambda rows: _descend(x, y, np.flatnonzero(rows), k, dim=dim, epochs=epochs, seed=seed)
    if n < SMALL:
        weights, bias = fit(np.ones(n, bool))
        turns = [(j, *fit(part != j)) for j in range(min(PARTS, n))] if n > 1 else []
    else:
        weights, bias = fit(part != 0)
        turns = [(0, weights, bias)]
    temperature, reject, known = 1.0, 0.0, np.zeros(0, np.int64)
    if turns:
        back = np.concatenate([np.flatnonzero(part == j) for j, _, _ in turns])
        z = np.concatenate([x[part == j] @ w + b for j, w, b in turns])
        temperature = min(np.geomspace(0.2, 5, 40), key=lambda t: _loss(z / t, y[back]))
        p = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True)
        right = p.argmax(axis=1) == y[back]
        if right.any():
            reject = float(np.quantile(p.max(axis=1)[right], REJECTED / 2)) - 1e-6  # the sums of the two ways to score differ by rounding
        known = np.setdiff1d(np.arange(n), back[~right])
    return LanguageModel(languages, weights.astype(np.float32), bias, float(temperature), reject, seed, _familiar(x, y, counts, part, known, k))


def _log_frequency(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Log share of each bucket, all languages and all texts of a language counting alike, with one evenly spread text a language added."""
    share, found = np.zeros(x.shape[1]), 0
    for c in range(k):
        mine = x[y == c]
        if len(mine):
            share += (mine.sum(axis=0, dtype=np.float64) + 1 / x.shape[1]) / (len(mine) + 1)
            found += 1
    return np.log(share / max(found, 1) if found else np.full(x.shape[1], 1 / x.shape[1])).astype(np.float32)


def _familiar(x: np.ndarray, y: np.ndarray, counts: np.ndarray, part: np.ndarray, known: np.ndarray, k: int) -> Familiar:
    """What the rows ``known`` look like to the log frequencies of the other parts; too few rows to compare set no limit."""
    logs = _log_frequency(x, y, k)
    mean, scatter = np.zeros(len(y)), np.zeros(len(y))
    for j in range(PARTS):
        other = _log_frequency(x[part != j], y[part != j], k)
        mean[part == j] = x[part == j] @ other
        scatter[part == j] = x[part == j] @ other**2
    known = known[counts[known] > 0]
    if len(known) < PARTS:
        return Familiar(logs, np.zeros(k), 1.0, 1.0, -np.inf)
    usual = np.full(k, np.median(mean[known]))
    for c in np.unique(y[known]):
        usual[c] = np.median(mean[known][y[known] == c])
    among_texts = (1.4826 * float(np.median(np.abs(mean - usual[y])[known]))) ** 2 + 1e-6
    found = Familiar(logs, usual, among_texts, float((scatter - mean**2)[known].mean()), -np.inf)
    found.least = float(np.quantile(found.deviations(mean[known], counts[known], y[known]), REJECTED / 2)) - 1e-6
    return found


def _descend(x: np.ndarray, y: np.ndarray, train: np.ndarray, k: int, *, dim: int, epochs: int, seed: int, rate: float = 8.0, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """SGD on embeddings and softmax layer over the rows ``train``: folded weights and bias."""
    rng = np.random.default_rng(seed)
    epochs = max(epochs, LEAST_STEPS * batch // max(1, len(train)))
    emb = rng.normal(0, 0.1, (x.shape[1], dim)).astype(np.float32)
    layer, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    steps, done = max(1, epochs * -(-len(train) // batch)), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, -(-len(train) // batch))):
            step = np.float32(rate * (1 - done / steps))
            h = x[part] @ emb
            z = h @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= max(1, len(part))
            grad_h = p @ layer.T
            layer -= step * (h.T @ p)
            bias -= step * 0.05 * p.sum(axis=0)
            emb -= step * (x[part].T @ grad_h)
            done += 1
    return emb @ layer, bias


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())


def _predict(model: LanguageModel):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    k = len(model.languages)
    key = ("langid", hash(model.weights.tobytes()), hash(model.familiar.logs.tobytes()))

    def compute(chunks: list[str]) -> np.ndarray:
        found, counts = subword_buckets(chunks, len(model.weights))
        rows = np.zeros((len(chunks), k + 2), np.float32)
        rows[:, k] = counts
        some = counts > 0
        if some.any():
            rows[some, :k] = np.add.reduceat(model.weights[found], group_starts(counts)[some], axis=0)
            rows[some, k + 1] = np.add.reduceat(model.familiar.logs[found], group_starts(counts)[some])
        return rows

    def run(batches):
        known = shared_table(key, lambda: ChunkTable(compute))
        for texts, ids in text_slices(batches, ("text", "doc_id")):
            chunks, lengths = split_all(texts, unicode=True)
            total = np.zeros((len(texts), k + 2))
            if len(chunks):
                names, codes = distinct(chunks)
                at = known.lookup(names, np.bincount(codes))
                some = lengths > 0
                total[some] = np.add.reduceat(known.rows[at][codes], group_starts(lengths)[some], axis=0, dtype=np.float64)
            fits = total[:, k] > 0
            best, score, strange = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if k:
                p = model.scores(total[:, :k], total[:, k])
                best, score = p.argmax(axis=1), np.where(fits, p.max(axis=1), 0.0)
                strange = model.familiar.deviations(total[:, k + 1] / np.maximum(total[:, k], 1), total[:, k], best) < model.familiar.least
            names = [model.languages[b] if k and f else UNKNOWN for b, f in zip(best, fits)]
            yield record_batch(schema, [ids, names, score, ~fits | (score < model.reject_below) | strange | (k == 0)])

    return run


def predict_language(docs: DataFrame, model: LanguageModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and whether the prediction is rejected, one row per input row."""
    rows = text_rows(docs, F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """The rows whose language is recognised, with all their columns; rows the model rejects are dropped."""
    schema = docs.schema
    score = _predict(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            plain = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(batch.num_rows))], ["text", "doc_id"])
            kept = np.concatenate([np.zeros(0, bool), *(~b.column(3).to_numpy(zero_copy_only=False) for b in score([plain]))])
            yield batch.filter(pa.array(kept))

    return text_rows(docs, *docs.columns).mapInArrow(run, schema)


def held_out(modulus: int, part: int, doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, modulus) == part
