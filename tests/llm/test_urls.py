"""The URL filter: rules, features, the trained trees."""

import math
import random
from collections import Counter

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tripleloom.llm import url_filter
from tripleloom.llm.queries import QUERIES, RULES
from tripleloom.llm.url_filter import Rule, entropy, features, host_and_path, judge, probability, train

URLS = [
    None, "", "no scheme", "http://", "://Host.ORG/a", "https://A.example.net/en/1?x=1&y=2#z", "http://example.net/en", "http://xexample.net/en/",
    "http://net", "http://net/", "http://a.net?q=/x", "HTTP://ÄB.org/fr/ü", "http://example.com/de/\nnew", "a://b://c/d", "http://org/fr/" + "x" * 70_000, "http://org/fr/",
]


def _split(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    end = next((i for i, c in enumerate(rest) if i >= at and c in "?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    return host, rest[at:end]


def _rule(host, path, rules):
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.text), default=None)


@pytest.fixture(scope="module")
def judged(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    return judge(frame.withColumns({c: F.lit(0) for c in ("host", "rule", "verdict", "score", "suffix")}), RULES, url_filter.UrlModel(-1.0, {}, 0.0, [])).collect()


def test_hosts_paths_and_rules(judged):
    assert len(judged) == len(URLS)
    for row in judged:
        host, path = _split(row.url)
        rule = _rule(host, path, RULES)
        assert (row.host, row.path, row.rule) == (host, path, rule and rule.text)
        assert row.verdict == (rule.verdict if rule else "allow")
        assert row.suffix == 0


def test_query(spark):
    rows = QUERIES["op1_url_filter"](spark, SF_DIR).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    right = total = 0
    for row in rows:
        host, path = _split(pages[row.page_id])
        rule = _rule(host, path, RULES)
        assert (row.host, row.path, row.rule) == (host, path, rule and rule.text)
        assert row.verdict == (rule.verdict if rule else "block" if row.score >= 0.5 else "allow")
        if rule:
            total += 1
            right += (row.score >= 0.5) == (rule.verdict == "block")
    assert right >= 0.85 * total


def test_native(spark):
    plan = QUERIES["op1_url_filter"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert "html" not in plan.rpartition("Physical Plan")[2]


def test_features(spark):
    url = "http://a.b.org/x/yy?p=1&q=22"
    row = spark.range(1).select(*[c.alias(n) for n, c in features(F.lit(url)).items()], entropy(F.lit("")).alias("none")).first()
    n = len(url)
    assert (row.length, row.host_length, row.path_length, row.depth, row.labels, row.parameters) == (n, 7, 5, 2, 3, 2)
    assert row.digit_ratio == pytest.approx(3 / n)
    assert row.entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(url).values()))
    assert row["none"] == 0


def test_trees_learn_what_rules_do_not_say(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        bad = rng.random() < 0.4
        tail = "".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(12))
        rows.append((f"http://h{rng.randrange(30)}.example/{tail}", bad))
    table = spark.createDataFrame(rows, "url string, blocked boolean")
    model = train(table.limit(400), trees=4)
    assert model.trees and len(model.suffixes) <= url_filter.SUFFIXES
    found = table.withColumn("p", probability(F.col("url"), model)).collect()
    assert sum((r.p >= 0.5) == r.blocked for r in found) >= 0.97 * len(found)


def test_rare_suffixes_keep_their_odds(spark, monkeypatch):
    """Suffixes beyond the expression's are joined, and say the same as if all were in it."""
    rows = [(f"http://a.s{i % 40}.example/{i}", i % 40 < 20) for i in range(1200)] + [(f"http://once{i}.example/x", True) for i in range(30)]
    table = spark.createDataFrame(rows, "url string, blocked boolean")
    asked = table.select("url").withColumns({name: F.lit(1) for name in ("_rule", "odds", "suffix", "row", "found", "_key", "n.`x")})
    asked = asked.unionByName(asked.limit(1).withColumn("url", F.lit("http://never.seen/")))
    few, all_ = train(table, trees=4, suffixes=3), train(table, trees=4, suffixes=1000)
    assert len(few.suffixes) == 3 and few.rest.count() == 67 and all_.rest is None and few.trees == all_.trees
    for threshold in ("-1", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        one, two = (sorted((r.url, round(r.score, 9)) for r in judge(asked, [], m).collect()) for m in (few, all_))
        assert one == two and len(one) == asked.count()
    assert judge(asked, [], few).columns[: len(asked.columns)] == asked.columns
    scores = dict(one)
    assert scores["http://a.s3.example/3"] > 0.5 > scores["http://a.s33.example/33"]


def test_models_without_much_to_learn_from(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    assert train(none).trees == [] and train(none).start == 0
    one = spark.createDataFrame([("http://a/b", True), (None, False), ("http://c", None)], "url string, blocked boolean")
    assert train(one).trees == [] and train(one).start > 0
    same = spark.createDataFrame([("http://a/b", True), ("http://a/b", False)] * 3, "url string, blocked boolean")
    model = train(same, trees=2)
    assert spark.range(1).select(probability(F.lit("http://a/b"), model).alias("p")).first().p == pytest.approx(0.5)
    assert judge(none.select("url"), [Rule("block", "a/")], model).count() == 0
