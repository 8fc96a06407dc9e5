import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import urls
from corpuslens.llm.queries import URL_RULES


def parts(spark, some):
    df = spark.createDataFrame([(u,) for u in some], "url string")
    host, path = urls.split_url(F.col("url"))
    rule, verdict = urls.rule_for(host, path, URL_RULES)
    return [tuple(r) for r in df.select(host, path, rule, verdict).collect()]


def test_hosts_paths_and_rules(spark):
    assert parts(
        spark,
        [
            *("HTTPS://A.Example.NET/en/1?x#y", "http://example.net/EN/", "http://x.net", "x://net/a", "http://notexample.com/de/"),
            *("http://www.example.com/de/x#z", "http://a.org/fr/?q", "http://a.org/fr", "://h?x", "no scheme", None, "http://É.com/P:1"),
            "http://a/b://c.net/",
        ],
    ) == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/EN/", "net/", "block"),
        ("x.net", "", None, None),
        ("net", "/a", "net/", "block"),
        ("notexample.com", "/de/", None, None),
        ("www.example.com", "/de/x", "example.com/de/", "block"),
        ("a.org", "/fr/", "org/fr/", "allow"),
        ("a.org", "/fr", None, None),
        ("h", "", None, None),
        ("", "", None, None),
        ("", "", None, None),
        ("É.com", "/P:1", None, None),
        ("a", "/b://c.net/", None, None),
    ]


def brute_ratio(accepted, rejected, gram):
    """The difference of the interpolated log-probabilities, straight from the definition."""

    def windows(texts, order):
        padded = ["^" * (urls.ORDER - 1) + t + "$" for t in texts]
        return Counter(p[i + urls.ORDER - order : i + urls.ORDER] for p in padded for i in range(len(p) - urls.ORDER + 1))

    def probability(texts, gram):
        p = 1 / urls.SYMBOLS
        for order in range(1, urls.ORDER + 1):
            counts, context = windows(texts, order), gram[-order:-1] if order > 1 else ""
            after = {g: n for g, n in counts.items() if g[:-1] == context}
            if after:
                p = (counts[gram[-order:]] + len(after) * p) / (sum(after.values()) + len(after))
        return p

    return math.log(probability(accepted, gram)) - math.log(probability(rejected, gram))


def test_models_equal_the_definition(spark):
    accepted, rejected = ["good.org/a", "good.org/b", "fine.org"], ["bad.net/x", "bad.net"]
    rows = [(t, 1) for t in accepted] + [(t, 0) for t in rejected] + [("other.com", None)]
    found = {r.gram: r.ratio for r in urls.log_ratios(spark.createDataFrame(rows, "text string, label int")).collect()}
    for gram in ("^^^g", "good", "ther", ".org", "com$", "bad."):
        assert found[gram] == pytest.approx(brute_ratio(accepted, rejected, gram))


def pages(spark, some):
    return spark.createDataFrame([(i, u, "x") for i, u in some], "page_id long, url string, host string")


def test_the_model_separates_what_rules_leave_open(spark):
    rules = [("allow", "news.org", "/"), ("block", "spam.biz", "/")]
    ends = [a + b for a in "abcdefghij" for b in "klmnop"]
    some = [(i, f"http://www.news.org/report/{e}") for i, e in enumerate(ends)]
    some += [(100 + i, f"http://x.spam.biz/pills/{e}") for i, e in enumerate(ends)]
    some += [(200, "http://other.com/report/zz"), (201, "http://other.com/pills/zz")]
    out = {r.page_id: r for r in urls.judge(pages(spark, some), rules).collect()}
    assert out[200].verdict == "allow" and out[201].verdict == "block" and out[200].rule is None
    assert len(out) == 122 and out[0].verdict == "allow" and out[100].verdict == "block"


def test_edge_rows(spark):
    some = [(1, None), (2, ""), (None, "http://a.net/"), (3, "x://"), (3, "x://"), (4, "http://h/" + "long/" * 5000)]
    out = urls.judge(pages(spark, some), URL_RULES).collect()
    assert sorted((str(r.page_id), r.verdict) for r in out) == sorted(
        [("1", "allow"), ("2", "allow"), ("None", "block"), ("3", "allow"), ("3", "allow"), ("4", "allow")]
    )
    assert urls.judge(pages(spark, []), URL_RULES).count() == 0
