import re

import pytest

from sparkveil.llm import urlrules
from sparkveil.llm.queries import URL_RULES

URLS = [
    "http://a.example.org/en/1?x=1", "https://example.org/en/100", "https://example.org/es/", "https://example.org/es", "https://EXAMPLE.org/EN/1", "http://notexample.org/es/",
    "https://x.com/de/1", "https://x.com/fr/", "https://com/fr/q", "https://x.net/", "https://org", "no scheme", "", None, "https://", "ftp://a.org#frag/x", "https://a.org/?u=http://b.com/de/", "x://y.com/de/://z",
    "https://a.b.c.d.e.f.g.com/de/x", "https://.org/", "https://" + "a." * 3000 + "org/x", "https://é.org/ü",
]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for action, rule in rules:
        own, tail = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            best = max(best or (0, 0), (len(rule), len(own), action, rule)) if best else (len(rule), len(own), action, rule)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [100_000, 0])
def test_verdicts(spark, monkeypatch, limit):
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", limit)
    rows = [(i, u, "old") for i, u in enumerate(URLS + URLS[:3])]
    out = urlrules.verdicts(spark.createDataFrame(rows, "page_id bigint, url string, rule string"), URL_RULES)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == {i: plain(u, URL_RULES) for i, u, _ in rows}
    assert out.count() == len(rows) and out.columns.count("rule") == 1


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x")], "page_id bigint, url string")
    assert [tuple(r)[2:] for r in urlrules.verdicts(df, []).collect()] == [("a.org", "/x", None, "allow")] * 2
    assert urlrules.verdicts(df.limit(0), URL_RULES).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    plan = urlrules.verdicts(df, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_columns_with_names_of_its_own(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", 7, 8)], "page_id bigint, url string, action int, _vhost int")
    row = urlrules.verdicts(df, URL_RULES).first()
    assert (row["rule"], row["verdict"], row["action"], row["_vhost"]) == ("org/", "allow", 7, 8)


def test_many_urls_without_a_host_and_one_popular_head(spark):
    rows = [(i, None) for i in range(3000)] + [(i, "no scheme") for i in range(3000, 6000)] + [(i, "http://a.example.org/en/1/x") for i in range(6000, 9000)] + [(9000, "http://b.org/y")]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id bigint, url string, host string, _vhost string").repartition(5)
    out = urlrules.verdicts(df, [("block", "example.org/en/1"), ("allow", "org/")]).groupBy("rule", "verdict", "host").count().collect()
    assert {(r["rule"], r["verdict"], r["host"], r["count"]) for r in out} == {(None, "allow", "", 6000), ("example.org/en/1", "block", "a.example.org", 3000), ("org/", "allow", "b.org", 1)}
