"""JSON result columns."""
from pyspark.sql import functions as F

from pagefold.sources.jsoncodec import parse_result_json, result_to_json


def test_result_json_omitempty(spark):
    df = spark.createDataFrame([(["a"], [], "", False, 0, 200, 5)],
                               "links array<string>, headers array<string>, markdown string, truncated boolean, "
                               "pages_crawled int, http_status int, duration_ms long")
    r = df.select(F.struct("links", "headers", "markdown", "truncated", "pages_crawled", "http_status", "duration_ms",
                           F.lit(None).cast("array<string>").alias("paragraphs"), F.lit(None).cast("string").alias("html"),
                           F.lit(None).cast("string").alias("raw_html"),
                           F.lit(None).cast("array<struct<url:string,depth:int,links:array<string>,headers:array<string>,"
                                            "paragraphs:array<string>,markdown:string,html:string,raw_html:string,"
                                            "http_status:int,truncated:boolean>>").alias("pages"),
                           F.lit(0).alias("pages_skipped"), F.lit(None).cast("array<string>").alias("urls")).alias("r"))
    js = r.select(result_to_json(F.col("r"))).collect()[0][0]
    assert js == '{"links":["a"],"http_status":200,"duration_ms":5}'
    bad = spark.createDataFrame([("",), ("{bad",), ('{"links": 5}',), (js,)], "j string")
    got = [r[0] for r in bad.select(parse_result_json(F.col("j")).alias("p")).select(F.col("p.links")).collect()]
    assert got[:3] == [None, None, None] and got[3] == ["a"]
