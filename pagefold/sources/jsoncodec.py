"""JSON columns of the jobs table.

Encoding follows the reference's omitempty rules: empty strings, empty arrays, zero
numbers and false disappear, except ``http_status`` and ``duration_ms`` of a result
and ``url`` and ``depth`` of a crawled page. ``to_json`` already drops NULL fields, so
empty values are turned into NULL first. Decoding gives NULL for NULL, empty,
malformed or mistyped JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("links", T.ArrayType(T.StringType())), T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("markdown", T.StringType()),
    T.StructField("html", T.StringType()), T.StructField("raw_html", T.StringType()),
    T.StructField("http_status", T.IntegerType()), T.StructField("truncated", T.BooleanType())])

RESULT_SCHEMA = T.StructType([
    T.StructField("links", T.ArrayType(T.StringType())), T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("markdown", T.StringType()),
    T.StructField("html", T.StringType()), T.StructField("raw_html", T.StringType()),
    T.StructField("truncated", T.BooleanType()), T.StructField("pages", T.ArrayType(PAGE_SCHEMA)),
    T.StructField("pages_crawled", T.IntegerType()), T.StructField("pages_skipped", T.IntegerType()),
    T.StructField("urls", T.ArrayType(T.StringType())), T.StructField("http_status", T.IntegerType()),
    T.StructField("duration_ms", T.LongType())])

KEEP_RESULT = ("http_status", "duration_ms")      # fixed values: always encoded
KEEP_PAGE = ("url", "depth")


def _omit(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.when(F.size(c) > 0, c)
    if isinstance(dtype, T.StringType):
        return F.when(c != "", c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, c)
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return F.when(c != 0, c)
    return c


def _clean_struct(c: Column, schema: T.StructType, keep: tuple) -> Column:
    fields = []
    for f in schema.fields:
        v = c[f.name]
        if f.name == "pages":
            v = F.when(F.size(v) > 0, F.transform(v, lambda p: _clean_struct(p, PAGE_SCHEMA, KEEP_PAGE)))
        elif f.name in keep:
            v = F.coalesce(v, F.lit(0).cast(f.dataType))
        else:
            v = _omit(v, f.dataType)
        fields.append(v.alias(f.name))
    return F.struct(*fields)


def result_to_json(result: Column) -> Column:
    """Encode a result struct (fields missing from it are treated as empty)."""
    return F.when(result.isNotNull(), F.to_json(_clean_struct(result, RESULT_SCHEMA, KEEP_RESULT)))


def parse_result_json(c: Column) -> Column:
    """Decode: NULL for NULL, empty, malformed or mistyped JSON."""
    ok = F.coalesce((c != "") & F.try_parse_json(c).isNotNull(), F.lit(False))
    schema = RESULT_SCHEMA.add("_corrupt_record", T.StringType())
    parsed = F.from_json(c, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(ok & parsed["_corrupt_record"].isNull(), parsed.dropFields("_corrupt_record"))


def options_to_json(options: Column) -> Column:
    """Options keep every non-NULL field (pointer fields: zero and false are kept)."""
    return F.when(options.isNotNull(), F.to_json(options))
