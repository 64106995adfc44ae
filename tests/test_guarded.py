"""Crawls behind the guard: private and missing hosts, redirects on and off, cancellation between pages."""
import datetime as dt

from pyspark.sql import functions as F

from pagefold.operators import crawl as C
from pagefold.operators import fetch as X

SEEDS = "crawl_id long, seed_url string, max_pages int, max_depth int, follow boolean"


def tables(spark):
    page = lambda *links: "".join(f'<a href="{x}">l</a>' for x in links)
    snapshot = [("http://a.com/", 200, page("/old", "rel/x", "/gone", "http://in.a.com/", "/loop", "/far1", "/evil", "ftp://a.com/")),
                ("http://a.com/new/", 200, page("deep", "/")), ("http://a.com/deep", 200, page("/")), ("http://a.com/rel/x", 500, page("/deep")),
                ("http://b.com/", 200, page("/")), ("http://nodns.com/", 200, page("/x")), ("http://a.com/f", 200, page("/deep")),
                ("ftp://a.com/", 200, page("/"))]
    redirects = [("http://a.com/old", 301, "/new/"), ("http://a.com/loop", 302, "/loop"), ("http://a.com/evil", 302, "http://b.com/"),
                 ("http://a.com/lost", 302, "http://nodns.com/"), *((f"http://a.com/far{i}", 302, f"/far{i + 1}") for i in range(1, 5)),
                 ("http://a.com/far5", 301, "/f"), ("http://a.com/near", 301, "http://a.com/far2")]
    dns = [("a.com", 0, "93.1.1.1"), ("b.com", 0, "93.1.1.2"), ("b.com", 1, "10.0.0.1")]
    return (spark.createDataFrame(snapshot, "url string, http_status int, body string"), spark.createDataFrame(dns, "host string, ord int, ip string"),
            spark.createDataFrame(redirects, "url string, http_status int, location string"))


def test_answers(spark):
    got = {r["url"]: (r["final_url"], r["http_status"], r["error"]) for r in X.guarded_answers(*tables(spark)).collect()}
    assert got["http://a.com/"] == ("http://a.com/", 200, None) and got["http://a.com/old"] == ("http://a.com/new/", 200, None)
    assert got["http://a.com/rel/x"][1:] == (500, "http_failed") and got["ftp://a.com/"][1:] == (0, "invalid_url")
    assert got["http://b.com/"][1:] == (0, "private_ip") and got["http://nodns.com/"][1:] == (0, "dns")
    assert got["http://a.com/evil"][1:] == (0, "private_ip") and got["http://a.com/lost"][1:] == (0, "dns")
    assert got["http://a.com/loop"][1:] == got["http://a.com/far1"][1:] == (0, "too_many_redirects")
    assert got["http://a.com/far2"] == ("http://a.com/f", 200, None) and got["http://a.com/near"][1:] == (0, "too_many_redirects")
    off = {r["url"]: (r["http_status"], r["error"]) for r in X.guarded_answers(*tables(spark), follow_redirects=False).collect()}
    assert off["http://a.com/old"] == (301, "http_failed") and off["http://a.com/loop"] == (302, "http_failed") and off["http://a.com/deep"] == (200, None)
    private = {r["url"]: r["error"] for r in X.guarded_answers(*tables(spark), allow_private=True).collect()}
    assert private["http://b.com/"] is None and private["http://nodns.com/"] == "dns" and private["http://a.com/evil"] == "private_ip"


def test_closure_agrees_with_the_walk(spark):
    snapshot, dns, redirects = tables(spark)
    verdict = X.dns_verdict(dns)
    walked = X.follow_redirects(redirects.select("url").withColumn("follow", F.lit(True)), redirects, verdict)
    want = {r["url"]: (r["redirect_error"], None if r["redirect_error"] else (r["final_url"], r["hops"])) for r in walked.collect()}
    got = {r["url"]: (r["redirect_error"], None if r["redirect_error"] else (r["final_url"], r["hops"])) for r in X.redirect_closure(redirects, verdict).collect()}
    assert got == want


def test_crawl_and_map(spark):
    seeds = spark.createDataFrame([(1, "http://a.com/", 50, 2, True), (2, "http://b.com/", 50, 2, True), (3, "http://a.com/old", 50, 1, True),
                                   (4, "http://a.com/unknown", 50, 2, True), (5, "http://bad host/", 50, 2, True)], SEEDS)
    got = C.crawl_guarded(seeds, *tables(spark)).orderBy("crawl_id", "rank").collect()
    pages = lambda i: [(r["url"], r["depth"], r["http_status"]) for r in got if r["crawl_id"] == i]
    a = "http://a.com"
    assert pages(1) == [(f"{a}/", 0, 200), (f"{a}/old", 1, 200), (f"{a}/rel/x", 1, 500), (f"{a}/gone", 1, 0), (f"{a}/loop", 1, 0), (f"{a}/far1", 1, 0),
                        (f"{a}/evil", 1, 0), ("ftp://a.com/", 1, 0), (f"{a}/deep", 2, 200)]
    assert pages(2) == [("http://b.com/", 0, 0)] and pages(4) == [(f"{a}/unknown", 0, 0)]
    # links of a redirected page are resolved against the URL that was asked for
    assert pages(3) == [(f"{a}/old", 0, 200), (f"{a}/deep", 1, 200), (f"{a}/", 1, 200)]
    assert [r["error"] for r in got if r["crawl_id"] == 5] == ["invalid_url"]
    off = C.crawl_guarded(seeds.where("crawl_id = 3"), *tables(spark), follow_redirects=False).collect()
    assert [(r["url"], r["http_status"], r["ok"]) for r in off] == [(f"{a}/old", 301, False)]
    m = C.map_guarded(seeds.where("crawl_id < 3").withColumnRenamed("max_pages", "max_urls"), *tables(spark)).orderBy("crawl_id", "rank").collect()
    assert [r["url"] for r in m if r["crawl_id"] == 1] == [u for u, _, _ in pages(1)] and [r["url"] for r in m if r["crawl_id"] == 2] == ["http://b.com/"]


def test_cancellation_is_dated(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    crawls = spark.createDataFrame([(i, at(100 * i)) for i in range(5)], "crawl_id long, started_at timestamp")
    asked = spark.createDataFrame([(0, at(-1)), (1, at(100)), (2, at(202.5)), (2, at(201.2)), (3, at(303)), (9, at(0))], "crawl_id long, cancelled_at timestamp")
    got = {r["crawl_id"]: r["stop_rank"] for r in C.stop_ranks(crawls, asked).collect()}
    assert got == {0: None, 1: 0, 2: 2, 3: 3, 4: None}
    assert C.stop_ranks(crawls, asked, page_seconds=0.5).where("crawl_id = 2").first()["stop_rank"] == 3
    snapshot = spark.createDataFrame([("http://a.com/", 200, "<a href=/1><a href=/2>"), ("http://a.com/1", 200, "<a href=/3>"), ("http://a.com/2", 200, "<a href=/4>")],
                                     "url string, http_status int, body string")
    seeds = spark.createDataFrame([(i, "http://a.com/", 9, 3, True, i if i < 9 else None) for i in (0, 1, 2, 3, 9)], SEEDS + ", stop_rank int")
    rows = C.crawl_bfs(seeds, snapshot).collect()
    assert [sum(r["crawl_id"] == i for r in rows) for i in (0, 1, 2, 3, 9)] == [0, 1, 2, 3, 5]
    rows = C.map_bfs(seeds.withColumnRenamed("max_pages", "max_urls"), snapshot).collect()
    assert [sum(r["crawl_id"] == i for r in rows) for i in (0, 1, 2, 3, 9)] == [1, 3, 4, 5, 5]
