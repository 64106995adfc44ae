"""Structured extraction with a language model, as request and response tables
(P13, F26, F27, J8).

The model call itself is outside Spark: ``build_requests`` writes one chat request
per page or job, an external batch run answers them, and ``parse_responses`` /
``join_page_responses`` turn the answers back into per-page results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: limits, system message, response-format names and error texts ----------
MAX_MARKDOWN_BYTES = 100_000
MAX_PROMPT_BYTES = 4_000
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
SYSTEM_MESSAGE = "Extract structured data from the markdown. Reply with JSON only."
PROMPT_SEPARATOR = "\n\n---\n\n"
SCHEMA_NAME = "extract"
ERR_INVALID = "llm invalid response"
ERR_LLM = "llm error"
ERR_EMPTY = "llm empty response"
ERR_NON_JSON = "llm returned non-json"
ERR_NO_MARKDOWN = "no markdown"
ERR_EXTRACT_FAILED = "extract failed"
REASON_NEED_INPUT = "schema or prompt is required"
REASON_PROMPT_LONG = "prompt too long"
REASON_NOT_COMPLETED = "job must be completed with results"
REASON_NO_MARKDOWN = "job has no markdown; scrape with extract markdown first"
# ---------------------------------------------------------------------------------------------


def cut_bytes(text: Column, n: int) -> Column:
    """First ``n`` UTF-8 bytes; what the cut leaves of a character is replaced."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(cut)


def trim_space(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(c, F.lit(WHITE_SPACE))


def eligibility(req: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to (job_id, status, markdown, n_pages, schema, prompt).
    Order: schema/prompt present, prompt size, job completed, markdown present."""
    has_schema = F.coalesce(F.length(F.col("schema")) > 0, F.lit(False))
    blank_prompt = F.coalesce(trim_space(F.col("prompt")) == "", F.lit(True))
    reason = F.when(~has_schema & blank_prompt, F.lit(REASON_NEED_INPUT)) \
        .when(F.coalesce(F.octet_length("prompt"), F.lit(0)) > MAX_PROMPT_BYTES, F.lit(REASON_PROMPT_LONG)) \
        .when(F.col("status") != "completed", F.lit(REASON_NOT_COMPLETED)) \
        .when((F.coalesce(F.col("n_pages"), F.lit(0)) == 0) & (F.coalesce(F.col("markdown"), F.lit("")) == ""),
              F.lit(REASON_NO_MARKDOWN))
    return req.withColumn("reject_reason", reason)


def build_requests(pages: DataFrame, model: str = "model", max_markdown_bytes: int | None = None) -> DataFrame:
    """one chat request per row of ``pages`` with job_id, url, markdown, schema, prompt; all its columns stay.

    With ``max_markdown_bytes`` longer markdown is cut there (MAX_MARKDOWN_BYTES is the reference's limit) and
    ``truncated`` says so; by default nothing is cut. The user message is the prompt, a separator
    and the markdown (just the markdown without a prompt); the response format is
    a named JSON schema when a schema is given, else a JSON object."""
    md = F.coalesce(F.col("markdown"), F.lit(""))
    truncated = F.lit(False) if max_markdown_bytes is None else F.octet_length(md) > max_markdown_bytes
    md = md if max_markdown_bytes is None else cut_bytes(md, max_markdown_bytes)
    has_prompt = F.coalesce(F.col("prompt") != "", F.lit(False))
    user = F.when(has_prompt, F.concat(F.col("prompt"), F.lit(PROMPT_SEPARATOR), md)).otherwise(md)
    has_schema = F.coalesce(F.length(F.col("schema")) > 0, F.lit(False))
    fmt = F.when(has_schema, F.lit("json_schema")).otherwise(F.lit("json_object"))
    x = pages.withColumns({"user": user, "response_format": fmt, "truncated": truncated})
    body = F.to_json(F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))).alias("messages"),
        F.struct(F.col("response_format").alias("type"),
                 F.when(F.col("response_format") == "json_schema", F.struct(
                     F.lit(SCHEMA_NAME).alias("name"), F.lit(False).alias("strict"),
                     F.try_parse_json(F.col("schema")).alias("schema"))).alias("json_schema")
                 ).alias("response_format")))
    return x.withColumn("body", body)


_RESP_SCHEMA = "struct<choices: array<struct<message: struct<content: string>>>, error: struct<message: string>>"


def parse_responses(resp: DataFrame) -> DataFrame:
    """(job_id, url, body) -> extracted JSON text or an error, in the reference's
    order: body not JSON, error field, no choices, content not JSON."""
    parsed = F.from_json(F.col("body"), _RESP_SCHEMA)
    content = trim_space(F.try_element_at(parsed["choices"], F.lit(1))["message"]["content"])
    body_ok = F.try_parse_json(F.col("body")).isNotNull()
    err = F.when(~body_ok, F.lit(ERR_INVALID)) \
        .when(F.try_variant_get(F.try_parse_json(F.col("body")), "$.error", "string").isNotNull(), F.lit(ERR_LLM)) \
        .when(F.coalesce(F.size(parsed["choices"]), F.lit(0)) <= 0, F.lit(ERR_EMPTY)) \
        .when(F.try_parse_json(content).isNull(), F.lit(ERR_NON_JSON))
    x = resp.withColumn("_err", err).withColumn("_content", content)
    return x.select("job_id", "url", F.when(F.col("_err").isNull(), F.col("_content")).alias("extracted"),
                    F.col("_err").alias("error"))


def join_page_responses(job_pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per crawled page -- 'no markdown' when the page has none, 'extract failed'
    when the model answer failed, else the extracted JSON."""
    j = job_pages.join(parsed, ["job_id", "url"], "left")
    no_md = F.coalesce(F.col("markdown"), F.lit("")) == ""
    return j.select("job_id", "url",
                    F.when(no_md, F.lit(None)).otherwise(F.col("extracted")).alias("extracted"),
                    F.when(no_md, F.lit(ERR_NO_MARKDOWN))
                    .when(F.col("error").isNotNull() | F.col("extracted").isNull(), F.lit(ERR_EXTRACT_FAILED))
                    .alias("error"))
