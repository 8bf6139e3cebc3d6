"""Phrase collocations, sharding and periodic runs against plain Python and, on whole tables, DuckDB."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contourlake.llm import phrases, runs, sharding
from contourlake.llm import queries as Q
from contourlake.llm.words import cut

SF = "/root/testdata/sf0.001"


# ---- phrases


def plain_collocations(rows, least, top=2000):
    found, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    found[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in found.items():
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows_of = []
        for p, a in frequent.items():
            if 100 * longer[p] < 80 * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows_of.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows_of)[:top])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"limit": 60, "burst": 4, "stretch": 50}])
def test_collocations_equal_counting_in_python(spark, docs, limits):
    rng = random.Random(5)
    words = ["a", "B", "ß", "Éa", "x\x1fy", "of", "the", "#1"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", ",", "; "]) for _ in range(rng.randint(0, 90)))
        rows.append((i, rng.choice([text, text, "Of the B a. " * 9]), rng.choice(["en", "en", None, "de"])))
    rows += [(70, None, "en"), (71, "", None), (72, "  ... ", "fr"), (73, None, None), rows[0], rows[0]]
    got = phrases.collocations(docs(rows).repartition(3), least=6, **limits)
    assert [f.name for f in got.schema] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain_collocations([(t, lang) for _, t, lang in rows], 6)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 30


def test_collocations_of_nothing_and_of_one_long_text(spark, docs):
    assert phrases.collocations(docs([])).count() == 0
    text = "one two three four five " * 40_000
    got = phrases.collocations(docs([(1, text)]), stretch=10_000)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(text, "en")], 30)


def test_top_phrases_keep_ties_by_bytes(spark, docs):
    rows = [(i, f"p{i % 9} q{i % 9}. ß{i % 3} z{i % 3}") for i in range(270)]
    got = phrases.collocations(docs(rows), top=5)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(t, "en") for _, t in rows], 30, 5)


def test_trie_bursts_and_spills_without_loss():
    rng = np.random.default_rng(3)
    trie, seen, left = phrases.HatTrie(4, burst=5), Counter(), Counter()
    for _ in range(30):
        rows = rng.integers(0, 6, (200, 4))
        keys, counts = phrases._distinct_rows(rows, 6)
        seen.update({tuple(k): c for k, c in zip(keys.tolist(), counts.tolist())})
        trie.add(keys, counts)
        if trie.size > 300:
            for k, c in zip(*trie.spill(100)):
                left[tuple(k.tolist())] += int(c)
            assert trie.size <= 100
    assert any(isinstance(x, dict) for x in trie.root.values())
    for k, c in zip(*trie.spill(0)):
        left[tuple(k.tolist())] += int(c)
    assert left == seen and trie.size == 0


def test_filter_never_loses_a_phrase(spark):
    rows = [("en", f"w{i} v{i % 7}") for i in range(500)]
    kept = phrases.filter_of(spark.createDataFrame(rows, "lang string, phrase string"), True, bits=1 << 10)
    hashes = [phrases.pair_hashes(*np.split(phrases.word_hashes("en", p.split(" ")), 2))[0] for _, p in rows]
    assert kept.has(np.array(hashes, np.uint64)).all() and len(kept.words) == 16


@given(st.lists(st.one_of(st.none(), st.text("aB é.\t\n\x0c\x00ü", max_size=20)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_and_pieces_equal_regular_expressions(texts):
    import pyarrow as pa

    words, owner, piece = cut(pa.array(["skip", *texts], pa.string()).slice(1), phrases.KINDS, lower=True)
    got = defaultdict(list)
    for w, o, p in zip(words.to_pylist(), owner.tolist(), piece.tolist()):
        got[o, p].append(w)
    expected = []
    for o, t in enumerate(texts):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        expected += [(o, ws) for x in re.split("[.,;:!?\x0a-\x0d]", t) if (ws := [w for w in re.split("[\x20\x09]+", x) if w])]
    assert [(o, ws) for (o, _), ws in got.items()] == expected


# ---- shards


def plain_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 40, 5000])
def test_jumps_equal_the_published_loop(spark, shards):
    rng = random.Random(shards)
    keys = [None, 0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(300)), *range(200)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shard(sharding.F.col("k"), shards).alias("s")).collect()
    assert [r.s for r in rows] == [plain_jump(r.k or 0, shards) for r in rows]


def test_shards_of_odd_rows(spark, docs):
    rows = [(None, "x"), (None, None), (3, ""), (3, "é" * 700), (3, "é" * 700), (-4, "a"), *((i, "t") for i in range(200)), *((9, str(i)) for i in range(150))]
    got = sharding.shard_documents(docs(rows), 16).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (plain_jump(r.doc_id or 0, 16), plain_jump(r.doc_id or 0, 17), "key")
        assert r.grown_shard in (r.shard, 16)
        by[r.shard].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.slot)
        assert [r.slot for r in rs] == list(range(len(rs)))
        assert [(r.doc_id is not None, r.doc_id or 0) for r in rs] == sorted((r.doc_id is not None, r.doc_id or 0) for r in rs)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.shard_documents(docs([]), 16).count() == 0


def test_only_a_share_of_the_keys_moves_when_shards_are_added(spark):
    rows = spark.range(4000).selectExpr("cast(id as string) as k", "id as shards_before")
    gone = sharding.moved(rows, 16, 20, "k").collect()
    assert all(r.new_shard >= 16 for r in gone) and 600 < len(gone) < 1000  # 4 of 20


def test_written_shards_hold_all_rows(spark, docs):
    rows = docs([(i % 50, f"t{i}") for i in range(120)])
    back = sharding.write_shards(rows, 4, "doc_id", "text")
    assert back.filter("shard is null").count() == 0 and sorted(r.text for r in back.collect()) == sorted(f"t{i}" for i in range(120))
    assert [r.shard for r in sharding.assign(back.drop("shard"), 4, "doc_id", "text").orderBy("text").collect()] == [r.shard for r in back.orderBy("text").collect()]


def test_no_python_and_no_unsplit_window_in_sharding(spark):
    plan = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"), 16)._jdf.queryExecution().toString()
    assert "Python" not in plan and "SinglePartition" not in plan


# ---- runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text, plant):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))


def repetitive(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.randint(0, 110)
    w = [str(rng.randrange(k)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            a = rng.randrange(n)
            p = 1 + rng.randrange(1 + (n - a) // rng.randint(3, 8))
            for i in range(a, a + rng.randint(0, n - a)):
                w[i] = w[a + (i - a) % p]
    return w


@given(st.integers(0, 10**9))
@settings(max_examples=150, deadline=None)
def test_runs_equal_comparing_all_periods(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(rng.randint(1, 5))]
    flat = np.array([int(x) for t in texts for x in t], np.int64)
    expected, at = [], 0
    for t in texts:
        expected += [(s + at, m, q) for s, m, q in plain_runs(t)]
        at += len(t)
    assert list(map(tuple, runs.find_runs(flat, np.array([len(t) for t in texts])).tolist())) == expected


def test_digests_equal_plain_python(spark, docs):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(repetitive(rng))) for i in range(250)]
    rows += [(None, "a b " * 20), (None, None), (7, None), (7, ""), (8, " \n "), (9, "é ü " * 3), (9, "é ü " * 3), (20_000, "w x y z " * 700)]
    for plant in (False, True):
        got = runs.run_digests(docs(rows).repartition(4), plant=plant).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted((plain_digest(*r, plant) for r in rows), key=key)


def test_whole_table_of_planted_runs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in Q.op13_periodic_runs(spark, SF).collect()}
    rows = d.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text) < 20_000:  # the plain loop is quadratic
            assert got[r.doc_id] == plain_digest(r.doc_id, r.text, True)
    assert sum(1 for r in got.values() if r[1]) > 10


def test_lists_of_runs_and_collapsed_texts(spark, docs):
    r = runs.runs_of(docs([(1, "go a b a b a b a b stop"), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[0].runs] == [(1, 8, 2)] and r[0].collapsed == "go a b stop"
    assert r[1].runs == [] and r[1].collapsed == ""
    assert runs.runs_of(docs([])).count() == 0


# ---- SQL


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_sharding"])
def test_queries_equal_sql(spark, name):
    df = Q.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cursor = con.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    rows = cursor.fetchall()
    assert sorted(names) == sorted(df.columns) and rows
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(rows)
