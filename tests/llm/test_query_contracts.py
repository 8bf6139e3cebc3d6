"""Columns of the queries against brute force on the smallest tables: rules of op1, pieces of op3, ids of op9, scores of op7 and op10."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.llm import langid, pieces, quality, urls
from contourlake.llm.queries import QUERIES
from tests.llm.test_operators import library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark):
    given = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op1_url_filters"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(given)
    for r in rows:
        m = re.search(r"(?s)://([^/?#]*)([^?#]*)", given[r.page_id] or "")
        host = re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1)) if m else ""
        path = m.group(2) if m else ""
        fits = [(len(x), x, v) for v, x in urls.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.score >= 0.5 else "allow")


def test_op3(spark, texts):
    lib, parts, sequences = library(), {}, {}
    for r in QUERIES["op3_packing"](spark, SF).collect():
        parts.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(parts) == set(texts)
    for d, t in texts.items():
        ids, at = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(parts[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1].tolist()] and sum(r.length for r in rows) <= 2048


def test_op9(spark, texts):
    import sentencepiece
    from public_tokenizers import path

    sp = sentencepiece.SentencePieceProcessor(model_file=path(pieces.DEFAULT_MODEL))
    rows = QUERIES["op9_sentencepiece"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_crc32, r.text_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(sp.decode(ids).encode()))


def test_op7_scores_by_plain_sums(spark, texts):
    """Every pair of features of a text, as the definition has it, against the query's score."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    usable = ~langid.held_out(3, 1)
    model = quality.train_quality(d, spark.read.parquet(f"{SF}/labels.parquet"), usable)
    import pyarrow as pa

    rows = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, SF).collect()}
    assert sorted(rows) == sorted(texts)
    for k, t in list(texts.items())[:40]:
        found = quality.features(pa.array([t], pa.string()))
        x = np.zeros(quality.BUCKETS + len(quality.STATS))
        x[found.bucket], x[quality.BUCKETS :] = found.value, model.scaled(found.stats)[0]
        at = np.flatnonzero(x)
        v = model.factors[at] * x[at, None]
        z = model.bias + model.linear[at] @ x[at] + sum(float(v[i] @ v[i + 1 :].sum(axis=0)) for i in range(len(at) - 1))
        r = rows[k]
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_op10_scores_by_plain_sums(spark, texts):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train_language_id(d, ~langid.held_out(4, 2))
    rows = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    assert sorted(rows) == sorted(texts)
    for k, t in list(texts.items())[:40]:
        words = ["".join(c for c in w.lower() if c.isalpha()) for w in (t or "").split()]
        sums, n = np.zeros(len(model.languages)), 0
        for w in filter(None, words):
            found, _ = langid.subword_buckets([w], len(model.weights))
            sums, n = sums + model.weights[found].sum(axis=0), n + len(found)
        r = rows[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = np.exp((sums / n + model.bias) / model.temperature)
        assert r.lang_pred == model.languages[int(z.argmax())] and r.score == pytest.approx(float(z.max() / z.sum()), abs=1e-4)


def test_empty_tables_and_repeats(spark, docs):
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    assert urls.judge(pages).count() == 0
    model = quality.train_quality(docs([]), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality.score_quality(docs([]), model).count() == 0
    assert len(quality.score_quality(docs([(1, "a " * 200_000), (1, "a " * 200_000), (None, None)]), model).collect()) == 3
