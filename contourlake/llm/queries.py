"""One query per operator, on its whole table with production parameters, and the equal DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.llm import jaccard, langid, packing, phrases, pieces, pii, quality, records, rules, runs, sharding, topk, urls
from contourlake.llm.common import materialize, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest fitting rule's, else the n-gram model's."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and those the fitted span classifier adds."""
    found = materialize(pii.find(table(spark, sf_dir, "documents")), "spans")
    spans = found.select("doc_id", pii.decided(F.col("spans"), pii.fit(found)).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_base(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return spans.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic packing of all documents into sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether it passes the threshold table."""
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as framed records in id order and read back from the files."""
    manifest = records.write_records(table(spark, sf_dir, "documents"))
    return records.read_records(manifest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factorisation machine trained on labels of the learnable rows, scored over all documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), ~langid.held_out(3, 1))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", langid.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a similarity of 0.8 on five-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the checksum of the text they decode to."""
    decoded = pieces.encode(table(spark, sf_dir, "documents"), decoded=True)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("text_crc32"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword-embedding language model trained on the learnable rows, applied to all documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train_language_id(docs, ~langid.held_out(4, 2))
    found = langid.predict_language(docs, model)
    return found.select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words hold together best, from exact counts over all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document among 16, and among 17, by its id alone, with its place in the shard."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, some with repetitions made by the document's id."""
    return runs.run_digests(table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_records": op5_token_records,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Exact links on five-word shingles, and their components by spreading the smallest id.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
r AS (SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(least(d.doc_id, k.class_id), d.doc_id) AS class_id, coalesce(m.n_links, 0) AS n_links
FROM documents d LEFT JOIN (SELECT node, min(other) AS class_id FROM r GROUP BY node) k ON k.node = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) m ON m.a = d.doc_id
"""

#: The counts by list functions; repeated windows by counting them per document.
RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w))
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(ws, lambda x: list_contains(STOP_LIST, lower(x)))) AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, greatest(n_words, 1)::DOUBLE AS n,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (CONDITION) AS kept FROM f
"""


def _rules_sql() -> str:
    """The threshold table as SQL."""
    names = {"n_words": "n_words", "mean_word": "word_chars / n", "symbols_per_word": "n_symbols / n", "stop_share": "n_stop_words / n", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeat_share": "n_repeat_words / n"}
    bounds = [f"{names[m]} {sign} {value}" for _, m, least, most in rules.THRESHOLDS for sign, value in ((">=", least), ("<=", most)) if value is not None]
    return RULES_SQL.replace("STOP_LIST", "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS)) + "]").replace("CONDITION", " AND ".join(bounds))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Counts of all phrases by joining a piece's words at offsets, in whole numbers of 128 bits.
PHRASES_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, k, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.*, l.f AS l, r.f AS r, 2000000::HUGEINT * a // (l.f + r.f) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""

#: The published jump loop in whole numbers of 128 bits; checksums bit by bit over the text's UTF-8 bytes.
SHARDING_SQL = """
WITH RECURSIVE jumps AS (
  SELECT doc_id, n, coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT doc_id, n, next, j, floor((j + 1) * (2147483648.0::DOUBLE / ((next // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT doc_id, n, j, (k * 2862933555777941757::HUGEINT + 1::HUGEINT) % 18446744073709551616::HUGEINT AS next FROM jumps WHERE j < n)
), shards AS (
  SELECT doc_id, max(b) FILTER (n = 16 AND j >= 16)::INTEGER AS shard, max(b) FILTER (n = 17 AND j >= 17)::INTEGER AS grown_shard FROM jumps GROUP BY doc_id
), steps AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(string_split(coalesce(text, ''), ''), lambda c: unicode(c)) AS u FROM documents
), bytes AS (
  SELECT doc_id, size, flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 | (c >> 6), 128 | (c & 63)]
    WHEN c < 65536 THEN [224 | (c >> 12), 128 | ((c >> 6) & 63), 128 | (c & 63)] ELSE [240 | (c >> 18), 128 | ((c >> 12) & 63), 128 | ((c >> 6) & 63), 128 | (c & 63)] END)) AS bs FROM steps
), sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(bs, lambda x: [x::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS text_crc32 FROM bytes
)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard ORDER BY s.doc_id, text_crc32, size) - 1 AS slot
FROM sums s JOIN shards h ON h.doc_id IS NOT DISTINCT FROM s.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": _rules_sql(), "op6_exact_top_k": TOP_K_SQL, "op8_ngram_jaccard_join": JACCARD_SQL, "op11_phrase_collocations": PHRASES_SQL, "op12_sharding": SHARDING_SQL}
