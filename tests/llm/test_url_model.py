"""The url model on hosts it has not seen, its scores in plain Python, and long rule lists with one frequent host."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contourlake.llm import urls


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, label, u) for i, (label, u) in enumerate(urls.labelled_urls())]
    return spark.createDataFrame(rows, "page_id long, label string, url string").withColumn("fold", F.pmod(F.xxhash64(urls.host_of(F.col("url"))), F.lit(5)))


def test_hosts_held_out_are_judged_right(labelled):
    held = labelled.filter("fold = 0")
    got = urls.judge(held, rules=(), labelled=labelled.filter("fold > 0")).join(held.select("page_id", "label"), "page_id")
    counts = {(r.label, r.verdict): r["count"] for r in got.groupBy("label", "verdict").count().collect()}
    share = lambda label: counts[label, label] / sum(n for (x, _), n in counts.items() if x == label)
    assert share("allow") >= 0.97 and share("block") >= 0.85


def test_hosts_of_everyday_life_are_allowed(spark):
    hosts = ["github.com", "www.python.org", "stackoverflow.com", "arxiv.org", "www.nature.com", "en.wikipedia.org", "kernel.org", "www.bbc.co.uk"]
    rows = urls.judge(spark.createDataFrame(list(enumerate(f"https://{h}/a/b" for h in hosts)), "page_id long, url string")).collect()
    assert {r.host: r.verdict for r in rows if r.rule is None} == {h: "allow" for h in hosts}


def test_no_host_of_the_pages_is_in_the_table(spark):
    pages = {r.h for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urls.host_of(F.col("url")).alias("h")).distinct().collect()}
    names = {h.split(".")[1] if h.split(".")[0] in ("www", "m", "blog") else h.split(".")[0] for h in pages if h}
    table = " ".join(u for _, u in urls.labelled_urls())
    assert names and not [n for n in names if len(n) > 3 and n in table]


def test_scores_equal_plain_python(spark):
    given = [(1, "https://www.Garden-news.example.org/en/1"), (2, "http://é-casino.net/x"), (3, None), (4, "http://a/")]
    table = spark.createDataFrame([(label, u) for label, u in urls.labelled_urls()[::40]], "label string, url string")
    rows = table.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), (F.col("label") == "block").cast("int").alias("blocked"), F.lit(1.0).alias("weight"))
    bias, weights = urls.train(rows)
    for r in urls.judge(spark.createDataFrame(given, "page_id long, url string"), labelled=table).collect():
        grams = set()
        for mark, text in (("h", r.host), ("p", r.path)):
            text = f"^{text}$"
            for n in urls.SIZES:
                for i in range(len(text) - n + 1):
                    grams.add(xxhash.xxh64_intdigest(text[i : i + n].encode(), xxhash.xxh64_intdigest(mark, 42)) % urls.BUCKETS)
        z = bias + sum(float(f"{weights[b]:g}") for b in grams) / math.sqrt(max(len(grams), 1))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_long_rule_lists_with_a_host_that_most_pages_share(spark):
    rng = np.random.default_rng(3)
    hosts = ["big.example.test"] * 400 + [f"h{i}.d{i % 40}.test" for i in range(200)] + [""] * 100
    given = [(i, None if not h else f"http://{h}/{rng.choice(['a/x', 'b', 'a'])}") for i, h in enumerate(hosts)]
    rules = [("block", "test/a"), ("allow", "big.example.test/a/"), ("block", "example.test/"), *(("allow", f"d{i}.test/b") for i in range(40)), *(("block", f"r{i}.none/") for i in range(300))]
    pages = spark.createDataFrame(given, "page_id long, url string")
    got = urls.judge(pages, rules=rules).collect()
    assert len(got) == 700
    for r in got:
        fits = [(len(x), x) for _, x in rules if (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0])) and r.path.startswith("/" + x.split("/", 1)[1])]
        assert r.rule == (max(fits)[1] if fits else None)
    few = urls.judge(pages, rules=rules[:43]).collect()  # the compiled form of the same list
    assert sorted((r.page_id, r.rule or "") for r in few) == sorted((r.page_id, r.rule or "") for r in got)
