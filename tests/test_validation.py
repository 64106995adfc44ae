"""Request binding and validation fixtures."""
from pyspark.sql import functions as F

from pagefold.functions.validate import validate, with_defaults
from pagefold.sources.requests import parse_requests

BODIES = [
    ("scrape", '{"url":"https://example.com","extract":["links","headers"]}', None),
    ("scrape", "{}", "invalid request body"),
    ("scrape", '{"extract":["links"]}', "invalid request body"),
    ("scrape", '{"url":"not-a-url"}', "url must be a valid http:// or https:// URL"),
    ("scrape", '{"url":"https://example.com","extract":["invalid"]}',
     'invalid extract type "invalid": must be one of links, headers, paragraphs, markdown, html, raw_html'),
    ("scrape", '{"url":"https://example.com","options":{"timeout_seconds":100}}', "timeout_seconds must be between 1 and 60"),
    ("scrape", '{"url":"https://example.com","options":{"timeout_seconds":0}}', "timeout_seconds must be between 1 and 60"),
    ("scrape", '{"url":"https://example.com","options":{"max_retries":10}}', "max_retries must be between 0 and 5"),
    ("scrape", '{"url": "https://example.com"', "invalid request body"),
    ("scrape", '{"url":"HTTP://example.com","extract":["ALL"]}',
     'invalid extract type "ALL": must be one of links, headers, paragraphs, markdown, html, raw_html'),
    ("map", '{"url":"https://example.com","extract":["bogus"]}', None),
    ("crawl", '{"url":"https://example.com","options":{"max_pages":0,"max_depth":9}}', "max_pages must be between 1 and 100"),
]


def test_reject_reasons(spark):
    df = spark.createDataFrame([(i, k, b) for i, (k, b, _) in enumerate(BODIES)], "req_id long, kind string, body string")
    got = {r["req_id"]: r["reject_reason"] for r in validate(parse_requests(df)).collect()}
    assert [got[i] for i in range(len(BODIES))] == [e for _, _, e in BODIES]


def test_defaults(spark):
    df = spark.createDataFrame([(1, "crawl", '{"url":"https://e.com"}'), (2, "map", '{"url":"https://e.com"}'),
                                (3, "scrape", '{"url":"https://e.com"}')], "req_id long, kind string, body string")
    rows = {r["req_id"]: r for r in with_defaults(validate(parse_requests(df))).collect()}
    assert rows[1]["extract"] == ["markdown"] and rows[1]["options"]["max_pages"] == 10 and rows[1]["options"]["max_depth"] == 2
    assert rows[2]["extract"] == ["links"] and rows[2]["options"]["max_urls"] == 50
    assert rows[3]["extract"] == ["links"] and rows[3]["options"]["max_pages"] is None
