"""Native cut of markup: links, headings, paragraphs and character references."""
from html import unescape
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from pagefold.operators import tokens as K
from pagefold.operators.extract import extract_one, extract_pages

SF001 = "/root/testdata/sf0.001"


def hrefs(spark, bodies):
    df = K.cut_markup(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, html string"), "html", texts=None)
    return [r["l"] for r in df.select("i", K.start_attributes(F.col("_tags"), "a", "href").alias("l")).orderBy("i").collect()]


def texts(spark, kind, bodies):
    df = K.cut_markup(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, html string"), "html")
    return [r["x"] for r in K.with_element_texts(df, kind, "x").orderBy("i").collect()]


def test_names_without_semicolon_in_attributes(spark):
    names = sorted(k for k in html5 if not k.endswith(";"))
    assert len(names) > 100
    values = [f"/p?a=1&{n}{after}" for n in names for after in ("=2", "x", "9", "", "&b", ";", "-")]
    want = [f"/p?a=1&{n}{a}" if a in ("=2", "x", "9") and f"{n}{a};" not in html5 else
            f"/p?a=1{html5[n]}{'' if a == ';' else a}" for n in names for a in ("=2", "x", "9", "", "&b", ";", "-")]
    got = hrefs(spark, [f'<a href="{v}">' for v in values])
    assert [g[0] for g in got] == want
    assert hrefs(spark, ['<a href="/p?a=1&section=2&region=x&notify=1&parameter=3&times=4">']) == [["/p?a=1&section=2&region=x&notify=1&parameter=3&times=4"]]


def test_references_in_text(spark):
    names = sorted(html5)
    cases = [f"x &{n} y" for n in names] + [f"&{n}z" for n in names if not n.endswith(";")]
    cases += ["&#65;&#x42;&#X43 &#68", "&#128;&#150;", "&amp;lt;", "& &; &# &#; &#x; &unknown; &notit; &ampersand", "&am&amp;p;", "&#32;", "&#x1F600;", "&hellip;" * 50]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", K.decoded(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == [unescape(c) for c in cases]
    bad = ["&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#000000000000065;", "&#x00000000000000041;"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(bad)], "i int, t string").select("i", K.decoded(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == ["�", "�", "�", "�", "A", "A"]


@pytest.mark.parametrize("body,want", [
    ("<a href=x>1</a><A HREF='y&amp;z'>2<a name=q><a href>3</a>", ["x", "y&z", ""]),
    ("<a href=\"u\nv\" href=w><a\thref = 'sp'/><a href=/p/q/>s</a>", ["u\nv", "sp", "/p/q/"]),
    ("<!-- <a href=no> --><script>'<a href=no>'</script><STYLE><a href=no></Style ><noscript><a href=no></noscript><a href=yes>", ["yes"]),
    ("<img alt='<a href=no>'><textarea><a href=no></textarea><title><a href=no></title><abbr href=no><a data-href=no hrefs=no>", []),
    ("<!--><a href=1>--><!---><a href=2><!-- x --!><a href=3><!x <a href=no><a href=4></ <a href=no><a href=5>", ["1", "2", "3", "4", "5"]),
    ("<a href=open", ["open"]), ("<a title=it's href=x>", ["x"]), ("<a title=\"a>b\" href='c>d'>", ["c>d"]), ("<a/href=x>", ["x"]),
    ("<svg/><a href=x><plaintext><a href=no>", ["x"]), ("<script><!-- </script><a href=x>", ["x"]), ("", []), ("no markup < 3 & a<b", []), (None, []),
    ("<a " + "x=y " * 3000 + "href=far>", ["far"]), ("<a href=x>" + "<" * 3000, ["x"])], ids=range(16))
def test_links(spark, body, want):
    assert hrefs(spark, [body]) == [want]


def test_intervals_end_where_html_ends_them(spark):
    bodies = ["<p><b>one<br><p>two</p><li>x<li>y", "<table><tr><td><p>c1<td><p>c2<tr><th>h</table><p>after", "<div><p>in</div>out<p>x<span>y</span>z</div><h4>q",
              "<p>é&eacute;&nbsp;</p><p> </p><p>\n\t&nbsp;</p><p>a<!-- c -->b<script>no</script></p>", "<p>&am<i>p;</i>", "<p>one<section>two<p>three</section>four", "", None]
    assert texts(spark, "paragraphs", bodies) == [["one", "two"], ["c1", "c2", "after"], ["in", "xyz"], ["éé", "ab"], ["&amp;"], ["one", "three"], [], []]
    bodies = ["<h1>a<b>b</b></h1><h2>c<h3>d</h2><h5>no</h5><h4> e </h4>", "<div><h1>open</div>out", "<H1 class=x>Up\n per</H1><h10>no</h10>", "<h1><p>x</h1>y", None]
    assert texts(spark, "headers", bodies) == [["ab", "c", "d", "e"], ["open"], ["Up\n per"], ["x"], []]


def test_same_as_the_tree_on_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r["page_id"]: r for r in extract_pages(pages, ["links", "headers", "paragraphs"], resolve=False).collect()}
    for r in pages.collect():
        want = extract_one(r["html"], ["links", "headers", "paragraphs"])
        assert all(got[r["page_id"]][k] == want[k] for k in ("links", "headers", "paragraphs"))


def test_native_plan_unless_the_tree_is_asked_for(spark):
    pages = spark.createDataFrame([(1, "http://e.com/", "<p>x<a href=y>", ["PARAGRAPHS"])], "page_id long, url string, html string, want array<string>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan(extract_pages(pages, ["links", "headers", "paragraphs"]))
    both = extract_pages(pages, ["markdown", "paragraphs"], types_col="want")
    assert "MapInArrow" in plan(both) and both.columns == ["page_id", "url", "markdown", "paragraphs", "truncated"]
    assert both.first().asDict() == {"page_id": 1, "url": "http://e.com/", "markdown": None, "paragraphs": ["x"], "truncated": False}
