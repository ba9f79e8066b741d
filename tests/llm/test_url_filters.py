import duckdb

from plumbline.llm import url_filters
from plumbline.llm.queries import ORACLE_SQL, op10_url_filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("deep.example.org", "/a/b", "block"), ("any.org", "", "block"), ("any.org", None, "allow"), (None, "/", "block"), ("x", "/", None)]
URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://example.net/en", "http://example.net", "http://notexample.com/de/", "https://sub.example.com/de/1#f", "//x", "http://w.org/fr/", "http://deep.example.org/a/bc", "http://deep.example.org/a/c", "http://any.org", "http://q.any.org?z", "a://b://c.net/", "http://h.net:80/", "http://net/", "http://h.net/" + "d/" * 3000,
        "http://example.net/en/" + "/" * 100_000, "http://" + "a." * 50_000 + "example.com/de/", "http://deep.example.org/a/b" + "/c" * 50_000]


def _judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in RULES if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1, 2) for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, verdict string, best int, u_host int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for most in (1000, 1):  # broadcast, and by a shuffle
        got = url_filters.judge_urls(pages, rules, broadcast_rules=most).collect()
        assert len(got) == len(URLS) + 4
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == _judge(r["url"]), r["url"]
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_query_against_sql(spark, sf):
    pages = duckdb.read_parquet(f"{sf}/pages.parquet")  # noqa: F841  named in the SQL
    want = duckdb.sql(ORACLE_SQL["op10_url_filters"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op10_url_filters(spark, sf).collect())
