"""URL resolution, normalisation and host predicates against literal cases."""
from pyspark.sql import functions as F

from pagefold.functions import urls as U

CASES = [
    ("https://Ex.com/a/b?x=1#f", "/für", "https://Ex.com/f%C3%BCr"),
    ("http://ex.com/a/b/c", "../d", "http://ex.com/a/d"),
    ("http://ex.com/a/b/c", "./", "http://ex.com/a/b/"),
    ("http://ex.com/a/b?q", "?z", "http://ex.com/a/b?z"),
    ("http://ex.com/a/b?q#g", "#h", "http://ex.com/a/b?q#h"),
    ("http://ex.com/a/b?q#g", "", "http://ex.com/a/b?q#g"),
    ("http://ex.com", "x", "http://ex.com/x"),
    ("HTTP://ex.com/a", "//other.com/p/../q", "http://other.com/q"),
    ("http://ex.com/a", "mailto:me@x", "mailto:me@x"),
    ("http://ex.com/a", "a b", "http://ex.com/a%20b"),
    ("http://ex.com/a", "%zz", None),
    ("http://ex.com/a", "1a:b", None),
    ("http://ex.com/a", "/a(b)", "http://ex.com/a(b)"),
    ("http://ex.com/a", "/a(b)é", "http://ex.com/a%28b%29%C3%A9"),
    ("http://ex.com:8080/a", "/x%41é", "http://ex.com:8080/xA%C3%A9"),
    ("http://ex.com/a", "http://h:bad/", None),
]


def test_resolve(spark):
    df = spark.createDataFrame([(b, r) for b, r, _ in CASES], "base string, ref string")
    got = [r[0] for r in df.select(U.resolve_url(F.col("base"), F.col("ref"))).collect()]
    assert got == [e for _, _, e in CASES]


def test_normalize_and_hosts(spark):
    df = spark.createDataFrame([("HTTPS://Ex.COM:443/a/../b?q=1#frag",), ("not a url:x",), ("http://:80",)], "u string")
    rows = df.select(U.normalize_url(F.col("u")).alias("n"), U.hostname(F.col("u")).alias("h"),
                     U.extract_hostname(F.col("u")).alias("eh"), U.is_valid_api_url(F.col("u")).alias("v"),
                     U.has_http_prefix(F.col("u")).alias("p")).collect()
    assert rows[0]["n"] == "https://Ex.COM:443/a/../b?q=1" and rows[0]["h"] == "Ex.COM"
    assert rows[0]["v"] and not rows[0]["p"]
    assert rows[1]["eh"] == "unknown" and not rows[1]["v"]
    assert rows[2]["v"]           # host:port ":80" is not empty


def test_same_host(spark):
    df = spark.createDataFrame([("http://A.com:1/x", "https://a.COM/y"), ("http://a.com", "mailto:a@a.com")], "a string, b string")
    assert [r[0] for r in df.select(U.same_host(F.col("a"), F.col("b"))).collect()] == [True, False]
