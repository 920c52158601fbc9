"""URL filters: listed rules by hand, mined ones against every subset of every url's tokens."""

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import urlrules as U

SF = "/root/testdata/sf0.001"


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def by_list(url, rules=U.RULES):
    host, path = parsed(url)
    found = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(found)[1:] if found else None


def by_subsets(urls, labelled, min_support, min_confidence):
    """{url: (verdict, confidence)} by counting every subset of the tokens of every labelled url."""
    both, alone = Counter(), Counter()
    for ts, verdict in labelled:
        for k in range(1, len(ts) + 1):
            for x in itertools.combinations(sorted(ts), k):
                alone[x] += 1
                both[x, verdict] += 1
    n = len(labelled)
    rules = [(round(c / alone[x], 9), c / n, set(x), v) for (x, v), c in both.items() if c >= min_support * n and c / alone[x] >= min_confidence]
    out = {}
    for url, ts in urls.items():
        fits = [r for r in rules if r[2] <= ts]
        best = max((r[:2] for r in fits), default=None)
        out[url] = None if best is None else (best[0], round(best[1], 9), {r[3] for r in fits if r[:2] == best})
    return out


def test_query_by_every_subset(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    tokens = {r.url: set(r.tokens) for r in U.distinct_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    labelled = [(tokens[u], by_list(u)[1]) for u in set(pages.values()) if by_list(u)]
    want = by_subsets(tokens, labelled, 0.01, 0.8)
    rows = U.op13_url_filters(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        url = pages[r.page_id]
        assert (r.host, r.path) == parsed(url)
        rule, best = by_list(url), want[url]
        assert r.confidence == (best and best[0]) and (best is None or r.mined in best[2])
        assert (r.rule, r.verdict) == (rule or (None, r.mined or "allow"))
    assert {r.verdict for r in rows if r.rule is None} == set(U.VERDICTS)


def test_listed_rules(spark):
    urls = [
        "http://org/", "http://a.ORG/x", "https://example.org/es/1", "https://example.org/es", "http://m.example.org/en/1?x", "http://example.org/en/21", "x://notexample.org/es/1", "http://b.com/fr/", "http://b.com/de/#top",
        "http://b.com", "http://b.com?x=/de/", "http://org", "no scheme org/", "", None, "://org/", "http://u@b.com/de/", "http://b.com/fr/://org/", "http://.com/de/", "http://Ü.com/de/\n2", "http://b.com/de/", "http://b.com/de/",
    ]
    table = spark.createDataFrame([(u, "x") for u in urls], "url string, host string").withColumn("verdict", F.lit("x")).withColumn("tokens", F.lit(1))
    out = {r.url: r for r in U.judge(table, U.rule_table(spark)).collect()}
    assert set(out) == set(urls)
    for u, r in out.items():
        assert (r.host, r.path) == parsed(u) and (r.rule, r.verdict) == (by_list(u) or (None, r.mined or "allow"))
    assert out[None].verdict == "allow" and out[None].rule is None


def test_mined_from_labels(spark):
    """Labels of one's own; tokens that always stand together are one item, so a long shared path is no burden."""
    rng = random.Random(4)
    deep = "/".join(f"d{k}" for k in range(60))
    rows = [(f"http://{rng.choice('ab')}.net/{deep}/{k}?s={k % 2}", "block" if k % 2 else "allow") for k in range(300)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    out = U.judge(labelled.select("url"), U.rule_table(spark), labelled).collect()
    want = dict(rows)
    assert all(r.verdict == want[r.url] and r.evidence == f"field s={int(want[r.url] == 'block')}" and r.confidence == 1.0 for r in out)


def test_without_labels_and_empty(spark):
    urls = spark.createDataFrame([("http://x.net/a",), (None,)], "url string")
    none = spark.createDataFrame([], "url string, verdict string")
    assert [(r.verdict, r.mined, r.rule) for r in U.judge(urls, U.rule_table(spark), none).collect()] == [("allow", None, None)] * 2
    assert U.judge(urls.limit(0), U.rule_table(spark)).isEmpty()


def test_plan_has_no_python(spark):
    plan = U.op13_url_filters(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
