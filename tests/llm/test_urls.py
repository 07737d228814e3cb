"""URL filters against a plain reading of the rules."""

import re

import pytest

from tabwright.llm import urls as u

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("Case.ORG", "/A", "block"), ("case.org", "", "allow"), ("both.org", "/x", "allow"), ("both.org", "/x", "block"),
    ("a.b.c", "/1", "block"), ("c", "/1/22/", "allow"), ("", "/", "block"), (None, "/", "block"), ("x.y", None, "block"), ("x.y", "/", "odd"),
]
URLS = [
    None, "", "no scheme", "http://", "http:///en/", "http://example.com/en/1", "https://www.example.com/en/1", "http://m.example.com/en/",
    "http://example.com/en", "HTTP://EXAMPLE.COM/EN/", "http://example.com?/en/", "http://example.com#/en/", "http://x.net/es/?q", "http://net/es/",
    "http://xnet/es/", "http://x.case.org/A", "http://case.org/a", "http://case.org", "http://both.org/xyz", "http://q.a.b.c/1/22/3",
    "http://q.a.b.c/1", "http://Üx.COM/ü", "a://b://c.com/", "http://.com/", "http://com./", "http://x.y/", "http://u:p@example.com:80/en/",
    "http://" + "s." * 200 + "com/" + "d/" * 500, "http://a\nb.com/x\ny", "http://example.com/en/1",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    lower = {c: c + 32 for c in range(65, 91)}
    host = host.translate(lower)
    fits = []
    for h, p, v in RULES:
        if h and p is not None and v in ("allow", "block"):
            h = h.translate(lower)
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h) + len(p), len(h), h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("copies", [1, 3])
def test_verdicts(spark, copies):
    rows = [(i, x, "odd", 1) for i, x in enumerate(URLS)] * copies + [(None, "http://example.com/en/1", None, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _url int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = u.judge(pages, rules)
    assert out.columns == ["page_id", "url", "_url", "host", "path", "rule", "verdict"]
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert list(map(str, got)) == list(map(str, sorted((str(i), *brute(x)) for i, x, *_ in rows)))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert u.judge(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in u.judge(pages, rules.limit(0)).collect()] == ["allow"]
    assert [r.verdict for r in u.judge(pages, rules.limit(0), default="block").collect()] == ["block"]


def test_rules_of_very_many_lengths(spark):
    """Five thousand lengths of paths: no bound on them, and the longest that fits decides."""
    rules = spark.range(5000).selectExpr("'a.com' AS host", "concat('/', repeat('x', int(id))) AS path", "if(id % 2 = 0, 'allow', 'block') AS verdict")
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 3001), (2, "http://b.a.com/xy"), (3, "http://a.com")], "page_id long, url string")
    found = {r.page_id: (len(r.rule or ""), r.verdict) for r in u.judge(pages, rules).collect()}
    assert found == {1: (len("a.com/") + 3001, "block"), 2: (len("a.com/x"), "block"), 3: (0, "allow")}
