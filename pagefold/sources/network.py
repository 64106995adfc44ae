"""Network stand-ins derived from ``pages``: DNS answers and redirects.

Live DNS lookups and HTTP redirects become joins against snapshot tables. Both are
derived with SQL that DuckDB runs unchanged (used by the oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HOST = "lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', ''))"

# Two answers per host, derived from the host's smallest page id (answer order = ord).
DNS_SQL = f"""
SELECT host, ord, CASE
    WHEN x % 23 = 3 THEN '10.' || CAST(x % 256 AS STRING) || '.0.1'
    WHEN x % 29 = 5 THEN '127.0.0.' || CAST(x % 250 + 1 AS STRING)
    WHEN x % 31 = 7 THEN '169.254.' || CAST(x % 256 AS STRING) || '.1'
    WHEN x % 37 = 2 THEN '172.' || CAST(16 + x % 16 AS STRING) || '.0.9'
    WHEN x % 41 = 4 THEN '172.' || CAST(32 + x % 16 AS STRING) || '.0.9'
    WHEN x % 43 = 6 THEN '192.168.' || CAST(x % 256 AS STRING) || '.7'
    WHEN x % 47 = 8 THEN '::1'
    WHEN x % 53 = 1 THEN '::ffff:10.1.2.3'
    WHEN x % 59 = 9 THEN 'fe80::1'
    WHEN x % 61 = 10 THEN '0.0.0.0'
    WHEN x % 67 = 11 THEN '0:0:0:0:0:FFFF:0a00:0001'
    WHEN x % 71 = 12 THEN '::ffff:7f00:1'
    WHEN x % 73 = 13 THEN '0::1'
    WHEN x % 79 = 14 THEN '2001:db8::10.0.0.1'
    WHEN x % 83 = 15 THEN '::ffff:93.1.2.3'
    ELSE '93.' || CAST(x % 200 + 10 AS STRING) || '.' || CAST(x % 251 AS STRING) || '.' || CAST(x % 241 + 1 AS STRING)
  END AS ip
FROM (SELECT host, lo + k AS x, k AS ord
      FROM (SELECT {_HOST} AS host, min(page_id) AS lo FROM pages GROUP BY 1) h
      CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk)
"""

# Redirects: every https page is also served at its http:// twin with a 301 to the
# https URL; every page also has an /r<N>/ alias chain of N = page_id % 7 hops
# (N = 0: no alias) ending at the page itself.
REDIRECT_SQL = """
SELECT 'http://' || substr(url, 9) AS url, 301 AS http_status, url AS location
FROM (SELECT regexp_replace(url, '#.*$', '') AS url FROM pages) p WHERE url LIKE 'https://%'
UNION ALL
SELECT base || '/r' || CAST(page_id AS STRING) || '/' || CAST(h AS STRING) AS url,
       CASE WHEN h % 2 = 0 THEN 301 ELSE 302 END AS http_status,
       CASE WHEN h = 1 THEN nurl ELSE base || '/r' || CAST(page_id AS STRING) || '/' || CAST(h - 1 AS STRING) END
         AS location
FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS nurl,
             regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS base, page_id % 7 AS n
      FROM pages) p
CROSS JOIN (SELECT 1 AS h UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
            UNION ALL SELECT 6) hh
WHERE h <= n
"""


def _spark_sql(spark: SparkSession, text: str, pages: DataFrame) -> DataFrame:
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}"),
                     pages=pages.select("page_id", "url"))


def dns_snapshot(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, ord, ip): resolver answers in answer order."""
    return _spark_sql(spark, DNS_SQL, pages)


def redirect_table(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(url, http_status, location): 3xx responses of the snapshot."""
    return _spark_sql(spark, REDIRECT_SQL, pages)


def alias_chain_heads(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, hops): every page once, at the head of its alias chain (a page
    without aliases starts at its own URL with 0 hops)."""
    return spark.sql("""
      SELECT page_id,
             CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '#.*$', '')
                  ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/r' ||
                       CAST(page_id AS STRING) || '/' || CAST(page_id % 7 AS STRING) END AS url,
             page_id % 7 AS hops
      FROM {pages}""", pages=pages.select("page_id", "url"))
