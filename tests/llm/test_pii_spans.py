"""Spans that the method adds: precision and recall on planted ones, texts with very many spans, odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from contourlake.llm import pii

WORDS = "time people water house street morning river letter story garden window paper music number light".split()


def planted(n, seed):
    """(doc_id, text, wanted spans of loose kinds): personal data behind cues, and look-alikes behind words that speak against them."""
    rnd = random.Random(seed)
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    rows = []
    for i in range(n):
        parts, wanted, at = [], [], 0

        def say(text, kind=None):
            nonlocal at
            if kind:
                wanted.append((kind, at, at + len(text)))
            parts.append(text)
            at += len(text)

        for _ in range(rnd.randint(1, 4)):
            say(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 12))) + ". ")
            what = rnd.randrange(7)
            if what == 0:
                say("api token: "), say(hexes(rnd.choice([32, 40, 64])), "secret")
            elif what == 1:
                say("commit "), say(hexes(40))
            elif what == 2:
                say("contact "), say(f"{rnd.choice(WORDS)} [at] {rnd.choice(WORDS)} [dot] com", "email")
            elif what == 3:
                say("call "), say(f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}", "phone")
            elif what == 4:
                say("order "), say(f"{rnd.randint(200, 999)} {rnd.randint(200, 999)}.{rnd.randint(1000, 9999)}")
            elif what == 5:
                say("sincerely "), say(f"Dr. {rnd.choice(['Mary', 'Peter', 'Klaus'])} {rnd.choice(WORDS).title()}", "name")
            else:
                say(f"{rnd.choice(WORDS)}@{rnd.choice(WORDS)}.org")
            say(" and ")
        rows.append((i, "".join(parts), wanted))
    return rows


def test_precision_and_recall_of_added_spans(docs):
    rows = planted(400, 3)
    found = pii.find(docs([r[:2] for r in rows])).cache()
    model = pii.fit(found)
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if not s.base] for r in found.select("doc_id", pii.decided(F.col("spans"), model).alias("spans")).collect()}
    for kind in ("secret", "email", "phone", "name"):
        want = {(d, *s) for d, _, spans in rows for s in spans if s[0] == kind}
        have = {(d, *s) for d, spans in got.items() for s in spans if s[0] == kind}
        assert len(want & have) >= 0.9 * len(want), kind
        assert len(want & have) >= 0.9 * len(have), kind
    votes = found.select(F.explode("spans").alias("s")).filter("not s.base")
    assert votes.filter("s.format * s.context < 0 or s.format * s.gazetteer < 0 or s.gazetteer * s.context < 0").count() > 0


@pytest.mark.parametrize("n", [100_000])
def test_very_many_spans(spark, docs, n):
    text = "é a@b.de 1.2.3.4 " * n
    began = time.time()
    found = pii.find(docs([(1, text)]), keep=("text",)).cache()
    one = found.select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).first()
    assert (one.n, one.last.start, one.last.end) == (2 * n, 17 * n - 8, 17 * n - 1)
    masked = pii.redact(found, pii.SpanModel()).first().text
    assert masked == "é <EMAIL> <IP> " * n
    assert time.time() - began < 120


def test_running_and_overlaps(spark):
    values = spark.createDataFrame([([3, 1, 4, 1, 5, 9, 2, 6],), ([],), ([7],)], "v array<bigint>")
    got = [(r.a, r.b) for r in values.select(pii.running(F.col("v"), lambda a, x: a + x).alias("a"), pii.running(F.col("v"), F.greatest).alias("b")).collect()]
    assert got == [([3, 4, 8, 9, 14, 23, 25, 31], [3, 3, 4, 4, 5, 9, 9, 9]), ([], []), ([7], [7])]
    rnd = random.Random(2)
    cases = []
    for i in range(300):
        spans = [(s := rnd.randrange(30), rnd.randrange(6), s + rnd.randint(1, 8), rnd.random() < 0.4, 0, 0, 0, 0, 0) for _ in range(rnd.randrange(9))]
        cases.append((i, spans))
    out = spark.createDataFrame(cases, f"i int, f {pii._SPAN}").select("i", pii.without_overlaps(F.col("f")).alias("k")).collect()
    for r in out:
        spans = cases[r.i][1]
        base = [s for s in spans if s[3]]
        want = sorted(base + [s for s in spans if not s[3] and not any(b[0] < s[2] and s[0] < b[2] for b in base)])
        assert [tuple(x) for x in r.k] == want


def test_rows_repeat_and_empty_tables(docs):
    rows = [(1, "a@b.de"), (1, "a@b.de"), (None, "x@y.org 1.2.3.4"), (2, None), (3, "")]
    found = pii.find(docs(rows), keep=("text", "score"))
    assert sorted(((r.doc_id, len(r.spans), r.score) for r in found.collect()), key=str) == sorted([(1, 1, "x"), (1, 1, "x"), (None, 2, "x"), (2, 0, "x"), (3, 0, "x")], key=str)
    assert sorted((r.text for r in pii.redact(found, pii.fit(found)).collect()), key=str) == sorted(["<EMAIL>", "<EMAIL>", "<EMAIL> <IP>", None, ""], key=str)
