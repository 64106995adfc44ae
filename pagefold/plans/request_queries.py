"""Queries over request intake: binding, validation router, defaults, accept (S1,
S8, S9, P1-P6, F1, F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions import validate as V
from pagefold.plans.catalog import query
from pagefold.sources.requests import DERIVED_REQUESTS_SQL, derived_request_bodies, parse_requests
from pagefold.sources.tables import pages

_INT_OPTS = ("timeout_seconds", "max_retries", "max_pages", "max_depth", "max_urls")
_BOOL_OPTS = ("follow_redirects", "render_js")


def _oracle_parsed() -> str:
    """DuckDB: bind the derived bodies with JSON functions, like the typed binder."""
    int_cols = ",\n".join(
        f"TRY_CAST(json_extract(body, '$.options.{o}') AS BIGINT) AS {o}" for o in _INT_OPTS)
    int_ok = " AND ".join(
        f"coalesce(json_type(body, '$.options.{o}') IN ('UBIGINT', 'BIGINT', 'NULL'), true)" for o in _INT_OPTS)
    bool_ok = " AND ".join(
        f"coalesce(json_type(body, '$.options.{o}') IN ('BOOLEAN', 'NULL'), true)" for o in _BOOL_OPTS)
    return f"""
r AS ({DERIVED_REQUESTS_SQL}),
j AS (SELECT req_id, body FROM r WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
jp AS (
  SELECT req_id,
         json_extract_string(body, '$.url') AS url,
         CASE WHEN json_type(body, '$.extract') = 'ARRAY' THEN CAST(json_extract(body, '$.extract') AS VARCHAR[]) END AS extract,
         {int_cols},
         TRY_CAST(json_extract(body, '$.options.follow_redirects') AS BOOLEAN) AS follow_redirects,
         coalesce(json_type(body, '$.url') IN ('VARCHAR', 'NULL'), true)
           AND coalesce(json_type(body, '$.extract') IN ('ARRAY', 'NULL'), true)
           AND coalesce(json_type(body, '$.options') IN ('OBJECT', 'NULL'), true)
           AND {int_ok} AND {bool_ok} AS typed_ok
  FROM j),
p AS (
  SELECT r.req_id, r.kind, jp.url, jp.extract, {", ".join("jp." + o for o in _INT_OPTS)}, jp.follow_redirects,
         coalesce(octet_length(encode(r.body)) <= 1048576 AND jp.typed_ok AND jp.url <> '', false) AS bind_ok
  FROM r LEFT JOIN jp ON r.req_id = jp.req_id)"""


_HOSTPORT = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_URL_OK = (f"(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') AND "
           f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https') AND "
           f"{_HOSTPORT} <> '' AND regexp_full_match({_HOSTPORT}, '[^:]*(:[0-9]*)?') AND "
           f"NOT regexp_matches(url, '[\\x00-\\x1f\\x7f]'))")
_BAD_EXTRACT = ("list_filter(coalesce(extract, []::VARCHAR[]), lambda t: lower(t) NOT IN "
                "('links', 'headers', 'paragraphs', 'markdown', 'html', 'raw_html'))[1]")
_OPT_REASON = "coalesce(" + ", ".join(
    f"CASE WHEN {name} NOT BETWEEN {lo} AND {hi} THEN '{msg}' END" for name, lo, hi, msg in V.OPTION_BOUNDS) + ")"

VALIDATION_ORACLE = f"""
WITH {_oracle_parsed().strip()},
v AS (
  SELECT req_id, kind, url, extract, {", ".join(_INT_OPTS)}, follow_redirects,
    CASE WHEN NOT bind_ok THEN 'invalid request body'
         WHEN NOT coalesce({_URL_OK}, false) THEN 'url must be a valid http:// or https:// URL'
         WHEN kind <> 'map' AND {_BAD_EXTRACT} IS NOT NULL THEN
              'invalid extract type "' || {_BAD_EXTRACT} || '": must be one of {V.EXTRACT_TYPES_MSG}'
         ELSE {_OPT_REASON} END AS reject_reason
  FROM p)
"""


@query("request_validation", oracle=VALIDATION_ORACLE + """
SELECT CAST(req_id AS BIGINT) AS req_id, kind, reject_reason IS NULL AS accepted, reject_reason FROM v
""")
def q_request_validation(spark, sf):
    req = parse_requests(derived_request_bodies(spark, pages(spark, sf)))
    v = V.validate(req)
    return v.select(F.col("req_id").cast("bigint").alias("req_id"), "kind", "accepted", "reject_reason")


@query("request_defaults", oracle=VALIDATION_ORACLE + """
SELECT CAST(req_id AS BIGINT) AS req_id, kind,
       CASE WHEN kind = 'map' THEN 'links'
            WHEN coalesce(len(extract), 0) = 0 THEN CASE WHEN kind = 'crawl' THEN 'markdown' ELSE 'links' END
            ELSE array_to_string(extract, ',') END AS extract_list,
       CAST(CASE WHEN kind = 'crawl' THEN coalesce(max_pages, 10) ELSE max_pages END AS BIGINT) AS max_pages,
       CAST(CASE WHEN kind IN ('crawl', 'map') THEN coalesce(max_depth, 2) ELSE max_depth END AS BIGINT) AS max_depth,
       CAST(CASE WHEN kind = 'map' THEN coalesce(max_urls, 50) ELSE max_urls END AS BIGINT) AS max_urls,
       CAST(coalesce(timeout_seconds, 10) AS BIGINT) AS eff_timeout_seconds,
       CAST(coalesce(max_retries, 3) AS BIGINT) AS eff_max_retries
FROM v WHERE reject_reason IS NULL
""")
def q_request_defaults(spark, sf):
    req = parse_requests(derived_request_bodies(spark, pages(spark, sf)))
    acc = V.with_defaults(V.validate(req).where("accepted"))
    eff = V.effective_options(F.col("options"))
    return acc.select(
        F.col("req_id").cast("bigint").alias("req_id"), "kind",
        F.array_join("extract", ",").alias("extract_list"),
        F.col("options.max_pages").cast("bigint").alias("max_pages"),
        F.col("options.max_depth").cast("bigint").alias("max_depth"),
        F.col("options.max_urls").cast("bigint").alias("max_urls"),
        eff["timeout_seconds"].cast("bigint").alias("eff_timeout_seconds"),
        eff["max_retries"].cast("bigint").alias("eff_max_retries"))


@query("accepted_jobs", oracle=VALIDATION_ORACLE + """
, a AS (SELECT req_id, kind, url, sha256(CAST(req_id AS VARCHAR)) AS h FROM v WHERE reject_reason IS NULL)
SELECT CAST(req_id AS BIGINT) AS req_id,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' ||
       substr(h, 21, 12) AS job_id,
       kind, url, 'queued' AS status,
       '/api/v1/jobs/' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
       substr(h, 17, 4) || '-' || substr(h, 21, 12) AS poll_url
FROM a
""")
def q_accepted_jobs(spark, sf):
    from pagefold.operators.jobs import accept_requests
    req = parse_requests(derived_request_bodies(spark, pages(spark, sf)))
    jobs = accept_requests(V.validate(req).where("accepted"))
    return jobs.select(F.col("req_id").cast("bigint").alias("req_id"), "job_id", "kind", "url", "status",
                       "poll_url")
