"""Page extraction fixtures (links, headers, paragraphs, markdown, html, truncation)."""
import pyarrow as pa
from pyspark.sql import functions as F

from pagefold.operators import extract as X
from pagefold.operators import htmltree as H

BASIC = """<html><head><title>T</title></head><body>
<nav><a href="/nav">Nav</a></nav>
<h1>Main Title</h1><h2>Sub</h2><h3>Third</h3><h4>Fourth</h4>
<a href="/relative">Rel</a><a href="https://external.example.com/x">Ext</a><a href="#section">Sec</a><a>No href</a>
<p>First paragraph.</p><p>Second <b>bold</b> paragraph.</p><div>A div</div>
</body></html>"""


def test_basic_counts():
    r = X.extract_one(BASIC, X.extract_set(["links", "headers", "paragraphs"]))
    assert len(r["links"]) == 4          # nav link + 3 in body; the a without href is dropped
    assert r["headers"] == ["Main Title", "Sub", "Third", "Fourth"]
    assert r["paragraphs"] == ["First paragraph.", "Second bold paragraph."]


def test_all_excludes_raw_html():
    types = X.extract_set(["all"])
    assert "raw_html" not in types and "markdown" in types and "html" in types
    r = X.extract_one(BASIC, types)
    assert "Main Title" in r["markdown"] and r["html"]


def test_main_content_and_markdown_rules():
    r = X.extract_one("<html><body><nav>skip</nav><main><h1>Hi</h1><p>Body</p></main></body></html>", ["markdown"])
    assert r["markdown"].startswith("# Hi")
    md = X.extract_one("""<html><body><article><nav>evil nav</nav><h1>Title</h1>
      <p>Hello <a href="/x">world</a>.</p><ul><li>One</li><li>Two</li></ul><ol><li>A</li></ol>
      <pre><code>x = 1\n  y</code></pre><blockquote> quoted  text </blockquote><script>evil()</script>
      <footer>skip</footer></article></body></html>""", ["markdown"])["markdown"]
    assert "# Title" in md and "Hello[world](/x)." in md and "- One\n- Two" in md and "1. A" in md
    assert "```\nx = 1\n  y\n```" in md and "> quoted  text" in md
    assert "evil" not in md and "skip" not in md


def test_empty_body_markdown():
    assert X.extract_one("<html><body></body></html>", ["markdown"])["markdown"] == ""


def test_truncate_bytes():
    s, t = X.truncate_utf8("a" * 524298)
    assert t and len(s.encode()) == 524288
    s2, t2 = X.truncate_utf8("é" * 4, 3)
    assert t2 and s2 == "é�"


def test_implied_end_tags_and_formatting():
    d = H.parse("<body><p><b>one<br><p>two</p><li>x<li>y</body>")
    ps = [H.go_trim(H.text_of(e)) for e in H.iter_elements(d) if e.tag == "p"]
    assert ps == ["one", "two"]
    body = [e for e in H.iter_elements(d) if e.tag == "body"][0]
    assert "<p><b>two</b></p>" in H.render(body)


def test_spark_links_resolved(spark):
    df = spark.createDataFrame([(1, "https://ex.com/a/b?q=1#top", BASIC)], "page_id long, url string, html string")
    out = X.extract_pages(df, ["links"]).collect()[0]
    assert out["links"] == ["https://ex.com/nav", "https://ex.com/relative", "https://external.example.com/x",
                            "https://ex.com/a/b?q=1#section"]


def test_per_row_types(spark):
    df = spark.createDataFrame([(1, "https://ex.com/", BASIC, ["HEADERS"]), (2, "https://ex.com/", BASIC, [])],
                               "job_id long, url string, body string, extract array<string>")
    out = {r["job_id"]: r for r in X.extract_pages(df, None, body_col="body", keep=("job_id",),
                                                   types_col="extract").collect()}
    assert out[1]["headers"][0] == "Main Title" and out[1]["links"] is None
    assert len(out[2]["links"]) == 4 and out[2]["headers"] is None


def test_malformed_declarations_lose_nothing():
    for odd in ("<![foo[bar]]>", "<![ x ]>", "<!x>", "<?php x ?>", "<![CDATA[a]]>"):
        got = X.extract_one(f"<p>one</p>{odd}<p>two</p><a href='/x'>l</a>", ["paragraphs", "links"])
        assert got["paragraphs"] == ["one", "two"] and got["links"] == ["/x"], odd


def test_body_cut_is_a_parameter_with_a_flag():
    body = "<p>" + "a" * 50 + "</p><p>tail</p>"
    for b in (body, body.encode()):
        assert X.extract_one(b, ["paragraphs"])["paragraphs"][-1] == "tail"
        cut = X.extract_one(b, ["paragraphs"], max_body_bytes=20)
        assert cut["truncated"] and cut["paragraphs"] == ["a" * 17]


def test_table_cells_title_and_textarea():
    got = X.extract_one("<table><tr><td><p>c1<td><p>c2<tr><th>h</table><p>after", ["paragraphs"])
    assert got["paragraphs"] == ["c1", "c2", "after"]
    got = X.extract_one("<title>t &amp; <p>x</p></title><body><textarea><p>in</p></textarea><p>one</p>", ["paragraphs", "headers"])
    assert got["paragraphs"] == ["one"]
    got = X.extract_one("<table><tr><td><b>a<td>b</table><p>c", ["html"])
    assert "<td><b>a</b></td><td>b</td></tr></table><p>c</p>" in got["html"].replace("<tbody>", "").replace("</tbody>", "")


def test_requests_share_one_parse_and_keep_their_own_types(spark):
    long = "<body><p>x</p>" + "a" * (X.MAX_STORED_HTML + 10) + "<a href=y>l</a></body>"
    bodies = spark.createDataFrame([("http://e.com/d/", long), ("http://e.com/q", BASIC), ("http://e.com/unwanted", BASIC)], "final_url string, body string")
    asked = [(1, "http://e.com/d/", "http://e.com/d/", ["links"]), (2, "http://e.com/alias", "http://e.com/d/", ["LINKS", "html"]),
             (3, "http://e.com/d/", "http://e.com/d/", ["raw_html"]), (4, "http://e.com/d/", "http://e.com/d/", ["headers", "markdown"]),
             (5, "http://e.com/q", "http://e.com/q", None), (6, "http://e.com/q", "http://e.com/q", ["ALL"]), (7, "http://e.com/no", "http://e.com/no", ["links"])]
    requests = spark.createDataFrame(asked, "job_id int, url string, final_url string, extract array<string>")
    out = X.extract_shared(requests, bodies, key="final_url", url_col="url", types_col="extract")
    got = {r["job_id"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]  # a page that is not there gives nothing
    assert [got[i]["truncated"] for i in range(1, 7)] == [False, True, True, False, False, False]
    assert got[1]["links"] == ["http://e.com/d/y"] and got[2]["links"] == ["http://e.com/y"] and got[3]["links"] is None
    assert got[1]["html"] is None and len(got[2]["html"]) == len(got[3]["raw_html"]) == X.MAX_STORED_HTML and got[4]["markdown"].startswith("x")
    assert len(got[5]["links"]) == 4 and got[5]["headers"] is None and got[6]["headers"][0] == "Main Title" and got[6]["raw_html"] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("MapInArrow") == 1


def test_query_strings_in_the_tree():
    page = "<body><a href='/p?a=1&section=2&copy=3&amp;b=4&times;5&region' Title=\"x &lt; y\" title=no =odd=1 bare>t</a></body>"
    got = X.extract_one(page, ["links", "markdown", "html"])
    assert got["links"] == ["/p?a=1&section=2&copy=3&b=4×5&region"] and got["markdown"] == f"[t]({got['links'][0]})"
    assert 'title="x &lt; y"' in got["html"] and ' bare=""' in got["html"] and "no" not in got["html"]


def test_pages_are_parsed_a_few_megabytes_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(X, "PIECE_BYTES", 100)
    bodies = ["<p>a</p>" * 5] * 7 + [None, "", "<p>b</p>" * 100, "<p>c</p>", None]
    for kind in (pa.string(), pa.binary()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(bodies, kind)], names=["page_id", "html"])
        pieces = list(X._pieces(batch, "html"))
        assert sum((p.column(0).to_pylist() for p in pieces), []) == list(range(12))
        held = [sum(len(b) for b in p.column(1).to_pylist() if b) for p in pieces]
        assert all(h <= 100 or sum(1 for b in p.column(1).to_pylist() if b) == 1 for h, p in zip(held, pieces)) and len(pieces) > 4
    rows = spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string").selectExpr("page_id", "'https://e.com/' url", "html").coalesce(1)
    got = {r["page_id"]: r["markdown"] for r in X.extract_pages(rows, ["markdown"]).collect()}
    assert got == {i: X.extract_one(b, ["markdown"])["markdown"] for i, b in enumerate(bodies)}
