"""Request intake as a table: JSON bodies -> typed rows (S1), derived test bodies.

A request body is bound with an explicit schema (never inferred). A body that is
not JSON, has a mistyped field, or lacks a non-empty ``url`` fails binding
("invalid request body"); unknown fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS_SCHEMA = T.StructType([
    T.StructField("timeout_seconds", T.IntegerType()),
    T.StructField("max_retries", T.IntegerType()),
    T.StructField("follow_redirects", T.BooleanType()),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("max_urls", T.IntegerType()),
    T.StructField("render_js", T.BooleanType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("extract", T.ArrayType(T.StringType())),
    T.StructField("options", OPTIONS_SCHEMA),
    T.StructField("_corrupt_record", T.StringType()),
])

MAX_BODY_BYTES = 1 << 20  # fixed value: request bodies above 1 MiB are refused


def bind_request(body: Column) -> Column:
    """Struct(url, extract, options, bind_ok) from a JSON body column."""
    parsed = F.from_json(body, REQUEST_SCHEMA, {"mode": "PERMISSIVE",
                                                "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.struct(parsed["url"].alias("url"), parsed["extract"].alias("extract"),
                    parsed["options"].alias("options"),
                    ((F.octet_length(body) <= MAX_BODY_BYTES) &
                    F.try_parse_json(body).isNotNull() &
                    F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False)) &
                    parsed["_corrupt_record"].isNull() &
                    F.coalesce(parsed["url"] != "", F.lit(False))).alias("bind_ok"))


def parse_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Add url, extract, options, bind_ok parsed from ``body_col``. The bind struct
    is materialised once (one JSON parse per row) and then split into columns."""
    b = df.withColumn("_bind", bind_request(F.col(body_col)))
    out = b
    for name, field in (("url", "url"), ("extract", "extract"), ("options", "options"), ("bind_ok", "bind_ok")):
        out = out.withColumn(name, F.col("_bind")[field])
    return out.drop("_bind")


def read_requests_json(spark: SparkSession, path: str, kind: str = "scrape") -> DataFrame:
    """Batch or file-based intake of one JSON request per line."""
    raw = spark.read.text(path).withColumnRenamed("value", "body")
    return parse_requests(raw.withColumn("kind", F.lit(kind)))


# ---- derived request bodies ---------------------------------------------------------------
# One SQL text runs on Spark and on DuckDB, so both engines see the same bodies. Every
# page yields one request; the page id picks the request kind and which variant of url,
# extract list and options it carries (all rows are kept).
DERIVED_REQUESTS_SQL = """
SELECT page_id AS req_id,
       CASE page_id % 3 WHEN 0 THEN 'scrape' WHEN 1 THEN 'crawl' ELSE 'map' END AS kind,
       CASE WHEN page_id % 13 = 5 THEN '{"url": "' || url || '", "extract": ["links"'
            WHEN page_id % 13 = 7 THEN '{"extract": ["links"]}'
            WHEN page_id % 13 = 11 THEN '{"url": "' || url || '", "options": {"timeout_seconds": "ten"}}'
            ELSE '{"url": "' ||
              CASE page_id % 7
                WHEN 1 THEN 'HTTP://' || substr(url, instr(url, '://') + 3)
                WHEN 2 THEN 'ftp://' || substr(url, instr(url, '://') + 3)
                WHEN 3 THEN 'not-a-url'
                WHEN 6 THEN 'http://:8080/x'
                ELSE url END || '"' ||
              CASE page_id % 5
                WHEN 0 THEN ''
                WHEN 1 THEN ', "extract": ["links", "Headers"]'
                WHEN 2 THEN ', "extract": ["MARKDOWN", "paragraphs"]'
                WHEN 3 THEN ', "extract": ["links", "invalid"]'
                ELSE ', "extract": ["all"]' END ||
              CASE page_id % 4
                WHEN 0 THEN ''
                WHEN 1 THEN ', "options": {"timeout_seconds": ' || CAST(page_id % 70 AS STRING) ||
                            ', "max_retries": ' || CAST(page_id % 7 AS STRING) || '}'
                WHEN 2 THEN ', "options": {"max_pages": ' || CAST(page_id % 120 AS STRING) ||
                            ', "max_depth": ' || CAST(page_id % 7 AS STRING) || ', "follow_redirects": false}'
                ELSE ', "options": {"max_urls": ' || CAST(page_id % 600 AS STRING) || ', "render_js": true}' END ||
              ', "unknown_field": 1}'
       END AS body
FROM pages
"""


def derived_request_bodies(spark: SparkSession, pages: DataFrame) -> DataFrame:
    text = DERIVED_REQUESTS_SQL.replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    return spark.sql(text,
                     pages=pages.select("page_id", "url"))
