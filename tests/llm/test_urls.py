"""Op 8: rules against plain code, and the character model on separable URLs."""

from pyspark.sql import functions as F

from entailer.llm import urls
from tests.llm.helpers import records

SCHEMA = "page_id long, url string"
URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/x?q=1", "HTTP://Example.COM/en/", "http://example.com",
    "http://example.com/fr/", "http://x.net/es/1", "http://x.net/fr/2", "http://net/fr/", "http://x.net/en/",
    "http://notexample.com/en/1", "no scheme", "", None, "://", "://com/", "a://b.com?x/en/", "a://b.com#/", "a://u@b.com:80/p",
    "http://com.evil.org/", "http://wwwexample.com/en/", "http://a.www.example.com/en/", "http://x.net/es/1",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_rules(spark):
    rows = list(enumerate(URLS))
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("host", "g", "s", "a", "n", "rule", "score")])
    for table in (df, clash):
        got = {r["page_id"]: r for r in urls.judge_urls(table).collect()}
        assert len(got) == len(rows)
        for i, url in rows:
            host, path, rule, verdict = brute(url)
            assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
            assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
        assert got[URLS.index("")]["verdict"] == got[URLS.index(None)]["verdict"] == "block"


def test_model_separates_unruled_urls(spark):
    rows = [(i, f"http://site{i}.com/news/good-article-{i}") for i in range(40)]
    rows += [(100 + i, f"http://site{i}.net/es/xxxcasino{i}") for i in range(40)]
    rows += [(200, "http://site.org/news/good-article-7"), (201, "http://site.org/xxxcasino9"), (201, "http://site.org/xxxcasino9")]
    got = records(urls.judge_urls(spark.createDataFrame(rows, SCHEMA)).where("rule is null"), "page_id", "verdict")
    assert got == [(200, "allow"), (201, "block"), (201, "block")]


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (None, "http://b.org/y")], SCHEMA)
    assert {r["verdict"] for r in urls.judge_urls(df).collect()} == {"allow"}
    assert urls.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
