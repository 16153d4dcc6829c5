import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm.q_url_filter import RULES
from gridspark.llm.url_filter import Rule, Weights, judge, train, url_features, url_parts
from gridspark.llm.url_seed import labelled_urls

URLS = [
    "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de", "http://x.com/de/",
    "http://x.com?/fr/", "http://x.com#/fr/", "http://org", "http://org/", "http://", "://", "no scheme", "", None, "a://b://c/d", "http://x.com/fr/de/?q=/de/",
    "http://ex.net/org/", "HTTP://EXAMPLE.org/EN/1", "http://example.org/en/1\n?z",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule")
    out = judge(pages, Weights((0.0,) * 64, -3.0), RULES).orderBy("page_id").collect()
    for row, url in zip(out, URLS, strict=True):
        host, path, rule, verdict = brute(url)
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict or "allow"), url


def test_features_are_n_grams(spark):
    host, path = url_parts(F.col("url"))
    table = spark.createDataFrame([("http://ab/x12",), ("http://ab/x7",), (None,)], "url string").select(url_features(host, path, (3,), 1 << 30).alias("f"))
    first, second, none = (set(r.f) for r in table.collect())
    assert len(first) == 2 + 3 and first == second and none == set()


def test_learns_the_labelled_table(spark):
    weights = train(labelled_urls(spark))
    out = judge(labelled_urls(spark), weights, []).collect()
    assert sum((r.verdict == "block") == (r.blocked == 1) for r in out) / len(out) > 0.95
    fresh = ["http://casino-bonus-win.example.com/en/1", "https://free-bets.example.net/de/3", "http://www.ththre.example.net/en/7", None]
    got = judge(spark.createDataFrame([(u,) for u in fresh], "url string"), weights, []).collect()
    assert [r.verdict for r in got] == ["block", "block", "allow", "allow"]


@pytest.mark.parametrize(("label", "verdict"), [(0, "allow"), (1, "block")])
def test_one_label_only_and_empty_tables(spark, label, verdict):
    weights = train(spark.createDataFrame([("http://a.b/c", label), ("http://d.e/f", None)], "url string, blocked int"))
    assert judge(spark.createDataFrame([("http://q.r/s",)], "url string"), weights, [Rule("z", "/", "allow")]).first().verdict == verdict
    assert judge(spark.createDataFrame([], "url string"), weights, []).collect() == []
    assert train(spark.createDataFrame([], "url string, blocked int")).intercept < 0


def test_score_matches_a_plain_dot_product(spark):
    """Weights of the labelled table on urls of all kinds, with n-grams and hashes written out."""
    weights = train(labelled_urls(spark))
    rows = judge(spark.createDataFrame([(u,) for u in [*URLS, "http://Win-Casino.example/é/字/123x45"]], "url string"), weights, []).collect()

    def number(field, gram):
        h = xxhash.xxh64_intdigest(gram.encode(), xxhash.xxh64_intdigest(field.encode(), 42))
        return (h - (1 << 64) if h >> 63 else h) % len(weights.values)

    for row in rows:
        texts = {"host": row.host, "path": re.sub("[0-9]+", "0", row.path)} if row.host else {}
        found = {number(field, f"^{t}$"[i : i + n]) for field, t in texts.items() for n in (3, 4, 5) for i in range(len(t) + 3 - n)}
        total = weights.intercept + sum(weights.values[i] for i in found)
        assert math.isclose(row.score, 1 / (1 + math.exp(-total)), rel_tol=1e-6), row.url
        assert row.verdict == ("block" if row.score >= 0.5 else "allow")
