from pagefold.llm.url_filters import filter_urls, url_keys, validity_intervals
from pyspark.sql import functions as F

ENTRIES = [("ads", "block", "domain", "bad.com", "add", 10), ("ads", "block", "domain", "bad.com", "remove", 20),
           ("ads", "block", "domain", "bad.com", "add", 30), ("ads", "block", "domain", "bad.com", "add", 35),
           ("ads", "block", "domain", "bad.com", "add", 35), ("tie", "block", "host", "tie.org", "add", 5),
           ("tie", "block", "host", "tie.org", "remove", 5), ("words", "block", "word", "casino", "add", 0),
           ("good", "allow", "path", "ok.net/casino", "add", 50), (None, "block", "host", "x.com", "add", 0),
           ("null", "block", "host", "x.com", "add", None)]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "list string, verdict string, kind string, pattern string, action string, dated long")


def test_intervals(spark):
    got = {(r["pattern"], r["valid_from"], r["valid_to"]) for r in validity_intervals(entries(spark)).collect()}
    assert got == {("bad.com", 10, 20), ("bad.com", 30, 35), ("bad.com", 35, None), ("casino", 0, None), ("ok.net/casino", 50, None)}


def test_keys(spark):
    url = "HTTPS://user:pw@A.b.Com:80/p/Q%20x?y=casino#z"
    keys = spark.range(1).select(F.explode(url_keys(F.lit(url))).alias("k")).select("k.*").collect()
    assert {tuple(r) for r in keys} == {
        ("host", "a.b.com"), ("domain", "a.b.com"), ("domain", "b.com"), ("domain", "com"), ("path", "a.b.com/"), ("path", "a.b.com/p"),
        ("path", "a.b.com/p/Q%20x"), ("word", "a"), ("word", "b"), ("word", "com"), ("word", "p"), ("word", "q"), ("word", "20x")}


def test_captures_are_judged_as_of_their_fetch(spark):
    rows = [("http://a.bad.com/x", t, t in (10, 19, 30, 35, 99)) for t in (9, 10, 19, 20, 29, 30, 35, 99)]
    rows += [("http://notbad.com/", 15, False), ("http://tie.org", 9, False), ("http://x.com/", 9, False),
             ("http://ok.net/casino/1", 49, True), ("http://ok.net/casino/1", 50, False), ("http://ok.net/casinos", 60, False),
             (None, 9, False), ("not a url casino", 9, False), ("http://bad.com/" + "a/" * 300, 12, True), ("http://bad.com", None, False)]
    rows += rows[:3]
    captures = spark.createDataFrame(rows, "url string, fetched_at long, want boolean").withColumn("kind", F.lit("k"))
    out = filter_urls(captures, entries(spark))
    assert out.columns == ["url", "fetched_at", "want", "kind", "blocked", "n_active", "active_lists"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["blocked"] == r["want"] for r in got)
    both = next(r for r in got if r["fetched_at"] == 50)
    assert (both["n_active"], both["active_lists"]) == (2, "good,words")


def test_empty_tables_and_native_plan(spark):
    captures = spark.createDataFrame([("http://bad.com/", 12)], "url string, fetched_at long")
    assert not filter_urls(captures, entries(spark).where("false")).first()["blocked"]
    out = filter_urls(captures, entries(spark))
    assert filter_urls(captures.where("false"), entries(spark)).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
