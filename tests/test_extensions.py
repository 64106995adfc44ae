"""Extension points and remaining operators: images type (U1), job-id validity (P12),
mid-crawl cancellation (T8), stuck jobs (T9), worker sink (T2)."""
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagefold.functions.validate import is_valid_job_id
from pagefold.operators import crawl as C
from pagefold.operators import extract as X
from pagefold.streaming import pipelines as P

from test_crawl import _seeds, _snapshot


def test_images_extension(spark):
    X.register_images()
    try:
        df = spark.createDataFrame([(1, "https://ex.com/p/", '<body><img src="a.png"><img alt=x><img src="/b.png"></body>')],
                                   "page_id long, url string, html string")
        r = X.extract_pages(df, ["images"]).collect()[0]
        assert r["images"] == ["https://ex.com/p/a.png", "https://ex.com/b.png"]
        assert "images" in X.extract_set(["all"])
    finally:
        X._REGISTRY.pop("images", None)


def test_job_id_validity(spark):
    ids = ["6ba7b810-9dad-11d1-80b4-00c04fd430c8", "urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8",
           "{6ba7b810-9dad-11d1-80b4-00c04fd430c8}", "6ba7b8109dad11d180b400c04fd430c8", "not-a-uuid", "123"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(is_valid_job_id(F.col("i"))).collect()]
    assert got == [True, True, True, True, False, False]


def test_cancel_between_levels(spark):
    g = {"https://ex.com/": ["https://ex.com/a"], "https://ex.com/a": ["https://ex.com/b"], "https://ex.com/b": [],
         "https://ot.com/": ["https://ot.com/a"], "https://ot.com/a": []}
    seeds = _seeds(spark, ["https://ex.com/", "https://ot.com/"])
    active = spark.createDataFrame([(1,)], "crawl_id long")         # crawl 0 was cancelled
    got = C.crawl_bfs(seeds, _snapshot(spark, g), active=active).collect()
    assert {r["crawl_id"] for r in got} == {1} and len(got) == 2


def test_cancelled_map_keeps_what_it_found(spark):
    g = {"https://ex.com/": ["https://ex.com/a"], "https://ex.com/a": []}
    seeds = _seeds(spark, ["https://ex.com/"], "max_urls")
    none = spark.createDataFrame([], "crawl_id long")
    assert [r["url"] for r in C.map_bfs(seeds, _snapshot(spark, g), active=none).collect()] == ["https://ex.com/"]


def test_crawl_finishing_between_levels_keeps_its_pages(spark, scratch):
    g = {"https://ex.com/": ["https://ex.com/a"], "https://ex.com/a": []}
    path = os.path.join(scratch, "active")
    spark.createDataFrame([(0,)], "crawl_id long").write.parquet(path)
    seen = []

    class Table:  # the live table: crawl 0 is gone when the second level asks
        def select(self, *cols):
            seen.append(1)
            return spark.read.parquet(path).where(F.lit(len(seen) == 1)).select(*cols)
    pages = C.crawl_bfs(_seeds(spark, ["https://ex.com/"]), _snapshot(spark, g), active=Table())
    assert [r["url"] for r in pages.collect()] == ["https://ex.com/"] and len(seen) == 2


def test_stuck_jobs(spark):
    now = datetime(2024, 1, 1, 12)
    jobs = spark.createDataFrame([("a", "processing", now - timedelta(minutes=30)), ("b", "processing", now),
                                  ("c", "queued", now - timedelta(hours=2))], "job_id string, status string, updated_at timestamp")
    got = [r["job_id"] for r in P.stuck_jobs(jobs, F.lit(now).cast("timestamp")).collect()]
    assert got == ["a"]


def test_worker_sink(spark, scratch):
    snap = spark.createDataFrame([("https://ex.com/", 200, "<body><a href='/x'>x</a><h1>H</h1></body>")],
                                 "url string, http_status int, body string")
    dns = spark.createDataFrame([("ex.com", 0, "93.1.2.3")], "host string, ord int, ip string")
    red = spark.createDataFrame([], "url string, http_status int, location string")
    jobs = spark.createDataFrame([("j1", "scrape", "https://ex.com/", ["links"], None),
                                  ("j2", "scrape", "https://nodns.com/", [], None),
                                  ("j3", "crawl", "https://ex.com/", ["links"], (None, None, None, 5, 1, None, None)),
                                  ("j4", "map", "https://ex.com/", ["links"], (None, None, None, None, 1, 9, None)),
                                  ("j5", "crawl", "http://bad host/", ["links"], None)],
                                 "job_id string, kind string, url string, extract array<string>, "
                                 "options struct<timeout_seconds:int,max_retries:int,follow_redirects:boolean,"
                                 "max_pages:int,max_depth:int,max_urls:int,render_js:boolean>")
    out = os.path.join(scratch, "w")
    P.worker_writer(out, snap, dns, red)(jobs, 0)
    rows = {r["job_id"]: r for r in spark.read.parquet(os.path.join(out, "results")).collect()}
    assert rows["j1"]["status"] == "completed" and '"links":["https://ex.com/x"]' in rows["j1"]["result_json"]
    assert len(rows) == 5 and rows["j5"]["error_type"] == "invalid_url" and rows["j5"]["status"] == "failed"
    assert '"urls":["https://ex.com/","https://ex.com/x"]' in rows["j4"]["result_json"] and rows["j4"]["http_status"] == 200
    assert '"pages_crawled":2,"pages_skipped":1' in rows["j3"]["result_json"]
    assert rows["j2"]["status"] == "failed" and rows["j2"]["error_type"] == "dns" and rows["j2"]["retries_used"] == 1
