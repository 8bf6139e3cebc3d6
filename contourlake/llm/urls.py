"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for the rest.

A rule ``host/path`` fits its host and all subdomains when the url's path starts with the rule's path; the
longest fitting rule decides. Pages no rule fits are judged by a logistic regression on hashed character
n-grams of host and path, trained from a small labelled table of urls (any table with ``url`` and ``label``; without one, ``labelled_urls``). On request a bounded sample of the
pages that rules decide (``max_rows``) is learnt from too. The driver fits the weights on the rows' n-gram
buckets, a few hundred numbers a row. Judging is one projection of built-in expressions.
Long rule lists are joined to the distinct hosts, and these to the pages, frequent hosts by broadcast.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged by the model's
bias alone; repeated rows are judged each; empty tables give empty results; extra columns are not touched.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.llm.common import hash_fraction, join_stats

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
#: Rules as (verdict, rule), for the production query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words that hosts of the labelled table are made of, by label, and what all of them share.
BLOCKED_WORDS = (
    "jackpot roulette slots blackjack wager baccarat sportsbook lotto sweepstake prize giveaway viagra cialis pharmacy rxmeds steroid weightloss dietpill payday cashadvance "
    "quickloan debtfix creditrepair getrich moneymaker doubler forexsignal replica knockoff fakewatch escort hookup webcamgirls xxx porn nude adultchat sexdating warez keygen "
    "torrent cracked serialkey nulled phish clickbait linkfarm seoboost backlinks trafficbot proxylist followersbuy miracle clickhere luckyspin"
).split()
ALLOWED_WORDS = (
    "garden library museum school college science history physics biology astronomy chemistry weather news daily times journal recipe kitchen bakery travel railway airport hotel "
    "river mountain forest harbour island village city council parliament court hospital clinic nursing football cricket tennis cycling running chess puzzle music opera theatre "
    "cinema photo camera design studio paper print book reader poet writer language grammar dictionary translate code software kernel compiler database network cloud server data "
    "stats maths market farmer coffee tea bread cheese wine bicycle engine motor repair tools wood stone glass textile knitting fashion shoe baby family history archive map atlas "
    "bird horse fish zoo animal pet health doctor dentist insurance bank post mail phone radio video stream game board card club society union church temple bridge road"
).split()
SYLLABLES = "ba be bo ca co cu da de do fa fi fo ga go gi ha he ho ja ju ka ki ko la le lo lu ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi wa we wi za zo st tr gr pl br ar er in on ex".split()
ENDINGS = ("com", "org", "net", "io", "info", "co.uk", "de", "fr", "es", "eu", "site", "online")
FRONTS = ("", "www.", "www.", "m.", "blog.", "shop.", "en.")
JOINTS = ("", "-", "", "-", ".")
PATHS = ("", "/", "/index.html", "/en/12", "/fr/340.html", "/de/7/", "/es/981", "/about", "/p/2024/03/item", "/view")
#: Hosts of each label in the table.
HOSTS = 1500


def labelled_urls() -> list[tuple[str, str]]:
    """(label, url): hosts made of one or two words of their label, and allowed ones of syllables too; fronts, joints, endings and paths are the same for both labels."""
    rng = random.Random(12)
    out = []
    for label, words in (("block", BLOCKED_WORDS), ("allow", ALLOWED_WORDS)):
        for i in range(HOSTS):
            first = rng.choice(words)
            second = rng.choice(("", rng.choice(words), rng.choice(words), rng.choice(SYLLABLES) + rng.choice(SYLLABLES), str(rng.randrange(1, 99))))
            name = first + rng.choice(JOINTS[:4] if label == "block" else JOINTS) + second if second else first
            if label == "allow" and i % 2:
                name = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5)))
            out.append((label, f"https://{rng.choice(FRONTS)}{name}.{rng.choice(ENDINGS)}{rng.choice(PATHS)}"))
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: Tables of at most this many rules become one expression, without any exchange; longer ones, whatever their size, are joined on host suffixes.
COMPILED_RULES = 200


def with_rule(pages: DataFrame, rules) -> DataFrame:
    """Adds rule and rule_verdict (null: none fits) to a table with host and path."""
    ordered = sorted(set(rules), key=lambda r: (-len(r[1]), r[1], r[0]))
    if len(ordered) <= COMPILED_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for decision, text in reversed(ordered):
            host, slash, rest = text.partition("/")
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
            rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
        return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    table = pages.sparkSession.createDataFrame([(d, r, r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "") for d, r in ordered], "decision string, rule string, rule_host string, rule_path string")
    by_host = table.groupBy("rule_host").agg(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "decision", "rule_path")).alias("rules"))  # as long as the list of one host
    hosts = pages.groupBy("host").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    suffixes = hosts.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fitting = suffixes.join(by_host, "rule_host").groupBy("host", "n").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = join_stats(pages, hosts.join(fitting.drop("n"), "host", "left"), "host", total)
    best = F.array_min(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    joined = known.withColumn("best", best)
    return joined.withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.decision")).drop("best", "rules")


def buckets(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the character n-grams of host and path, which are told apart."""
    parts = [_grams(F.concat(F.lit("^"), text, F.lit("$")), mark, n) for mark, text in (("h", host), ("p", path)) for n in SIZES]
    return F.array_distinct(F.concat(*parts))


def _grams(text: Column, mark: str, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
    return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<int>"))


#: Share of blocked urls that the model takes for granted: a host it knows nothing about is allowed.
BLOCKED_SHARE = 0.2


def train(labelled: DataFrame, *, blocked_share: float = BLOCKED_SHARE, steps: int = 300, rate: float = 0.5, shrink: float = 1e-3) -> tuple[float, np.ndarray]:
    """Bias and weights from a small table of (host, path, blocked 0/1, weight): gradient descent on the driver."""
    rows = labelled.select(buckets(F.col("host"), F.col("path")).alias("b"), "blocked", "weight").groupBy("b", "blocked").agg(F.sum("weight").alias("weight")).orderBy("blocked", "b").collect()
    if not rows:
        return -1.0, np.zeros(BUCKETS)
    y, n = np.array([r["blocked"] for r in rows], float), np.array([r["weight"] for r in rows], float)
    at = np.concatenate([np.array(r["b"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r["b"]) for r in rows])
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(rows)), 1))
    for label, share in ((0, 1 - blocked_share), (1, blocked_share)):
        n[y == label] *= share / max(n[y == label].sum(), 1e-9)
    w, bias, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8)
    for _ in range(steps):
        z = bias + scale * np.bincount(owner, weights=w[at], minlength=len(rows))
        g = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(at, weights=(g * scale)[owner], minlength=BUCKETS) + shrink * w / BUCKETS
        seen += grad * grad
        w, bias = w - rate * grad / np.sqrt(seen), bias - rate * g.sum()
    return round(float(bias), 9), w.round(6)


def probability(bias: float, weights: np.ndarray) -> Column:
    """The model's probability of blocking, as an expression over host and path."""
    table = F.split(F.lit(",".join(f"{x:g}" for x in weights)), ",").cast("array<double>")
    b = F.col("buckets")
    total = F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")))))


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None, max_rows: int = 0, seed: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and the model's score, one row per input row. ``labelled``: label (block or allow) and url."""
    spark: SparkSession = pages.sparkSession
    split = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = with_rule(split, rules)
    given = labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "label string, url string")
    given = given.withColumn("blocked", (F.col("label") == "block").cast("int")).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked", F.lit(1.0).alias("weight"))
    if max_rows:
        decided = ruled.filter("rule is not null")
        share = min(1.0, max_rows / max(1, decided.count()))
        sample = decided.filter(hash_fraction(seed, "page_id") < share)
        given = given.unionByName(sample.select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked"), F.lit(1.0).alias("weight")))
    bias, weights = train(given)
    scored = ruled.withColumn("buckets", buckets(F.col("host"), F.col("path"))).withColumn("score", probability(bias, weights))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
