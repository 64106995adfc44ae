"""Queries over DNS, SSRF, redirects and whole scrape jobs (P7, P8, J3, G3, S2, J1,
P9, F5, F19-F25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions.netaddr import is_private_ip
from pagefold.functions.validate import with_defaults
from pagefold.operators import fetch as X
from pagefold.operators.jobs import job_meta
from pagefold.plans.catalog import query
from pagefold.plans.extraction_queries import MARKDOWN_SQL
from pagefold.plans.request_queries import VALIDATION_ORACLE
from pagefold.plans.sqlsnippets import CLEAN_PAGES, RESOLVED_LINKS, dec, hostname, trim_ws
from pagefold.sources.network import DNS_SQL, REDIRECT_SQL, alias_chain_heads, dns_snapshot, redirect_table
from pagefold.sources.requests import OPTIONS_SCHEMA, derived_request_bodies, parse_requests
from pagefold.sources.sitegraph import page_snapshot
from pagefold.sources.tables import pages


def _duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


def _private_sql(ip: str) -> str:
    """The private blocks as rules on text: leading octets, and the spellings of IPv6 that the table holds."""
    v4 = f"regexp_replace(lower({ip}), '^::ffff:([0-9]+[.])', '\\1')"
    return (f"(regexp_matches({v4}, '^(127|10)[.][0-9]+[.][0-9]+[.][0-9]+$') "
            f"OR regexp_matches({v4}, '^(192[.]168|169[.]254)[.][0-9]+[.][0-9]+$') "
            f"OR regexp_matches({v4}, '^172[.](1[6-9]|2[0-9]|3[01])[.][0-9]+[.][0-9]+$') "
            f"OR lower({ip}) IN ('::1', '0::1', '::ffff:7f00:1', '0:0:0:0:0:ffff:0a00:0001'))")


DNS_VERDICT_SQL = f"""
dns AS ({_duck(DNS_SQL)}),
verdict AS (SELECT host, count(*) AS n_answers, arg_min(ip, ord) FILTER (WHERE {_private_sql('ip')}) AS private_ip
            FROM dns GROUP BY host)"""


@query("private_ip_check", oracle=f"WITH dns AS ({_duck(DNS_SQL)})\n" + f"""
SELECT host, CAST(ord AS BIGINT) AS ord, ip, {_private_sql('ip')} AS is_private FROM dns
""")
def q_private_ip_check(spark, sf):
    d = dns_snapshot(spark, pages(spark, sf))
    return d.select("host", F.col("ord").cast("bigint"), "ip", is_private_ip(F.col("ip")).alias("is_private"))


@query("ssrf_guard", oracle="WITH " + DNS_VERDICT_SQL.strip() + """
SELECT host, CAST(n_answers AS BIGINT) AS n_answers, private_ip IS NOT NULL AS blocked, private_ip FROM verdict
""")
def q_ssrf_guard(spark, sf):
    v = X.dns_verdict(dns_snapshot(spark, pages(spark, sf)))
    return v.select("host", F.col("n_answers").cast("bigint"), F.col("private_ip").isNotNull().alias("blocked"),
                    "private_ip")


@query("redirect_chain", oracle="WITH RECURSIVE " + DNS_VERDICT_SQL.strip() + f""",
red AS ({_duck(REDIRECT_SQL)}),
seeds AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '#.*$', '')
                 ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/r' ||
                      CAST(page_id AS VARCHAR) || '/' || CAST(page_id % 7 AS VARCHAR) END AS url FROM pages),
chain AS (SELECT page_id, url AS cur, 0 AS hops FROM seeds
          UNION ALL
          SELECT c.page_id, r.location, c.hops + 1 FROM chain c JOIN red r ON r.url = c.cur WHERE c.hops < 5),
hi AS (SELECT c.page_id, c.hops, c.cur, v.host IS NULL AS nodns, v.private_ip IS NOT NULL AS priv
       FROM chain c LEFT JOIN verdict v ON v.host = lower({hostname('c.cur')})),
ag AS (SELECT page_id, max(hops) AS h, min(hops) FILTER (WHERE hops >= 1 AND (nodns OR priv)) AS e FROM hi GROUP BY 1),
fin AS (SELECT page_id, CASE WHEN e IS NOT NULL AND e <= 4 THEN e WHEN h >= 5 THEN 4 ELSE h END AS hops,
               CASE WHEN e IS NOT NULL AND e <= 4 THEN 'err' WHEN h >= 5 THEN 'too_many_redirects' END AS kind FROM ag)
SELECT CAST(f.page_id AS BIGINT) AS page_id, hi.cur AS final_url, CAST(f.hops AS BIGINT) AS hops,
       CASE WHEN f.kind = 'err' THEN CASE WHEN hi.nodns THEN 'dns' ELSE 'private_ip' END ELSE f.kind END AS redirect_error
FROM fin f JOIN hi ON hi.page_id = f.page_id AND hi.hops = f.hops
""")
def q_redirect_chain(spark, sf):
    p = pages(spark, sf)
    seeds = alias_chain_heads(spark, p).withColumn("follow", F.lit(True))
    r = X.follow_redirects(seeds, redirect_table(spark, p), X.dns_verdict(dns_snapshot(spark, p)))
    return r.select(F.col("page_id").cast("bigint"), "final_url", F.col("hops").cast("bigint"), "redirect_error")


def _scrape(spark, sf):
    p = pages(spark, sf)
    req = parse_requests(derived_request_bodies(spark, p))
    from pagefold.functions.validate import validate
    acc = with_defaults(validate(req).where(F.col("accepted") & (F.col("kind") == "scrape")))
    acc = acc.withColumn("job_id", F.col("req_id"))
    return acc, X.scrape_jobs(acc, page_snapshot(p), dns_snapshot(spark, p), redirect_table(spark, p))


_COUNTS_SQL = f"""
cl AS (SELECT page_id, count(*) AS n FROM ({RESOLVED_LINKS}) z GROUP BY 1),
b AS ({CLEAN_PAGES}),
hh AS (SELECT page_id, unnest(regexp_extract_all(h, '<h[1-4][^>]*>(.*?)</h[1-4]>', 1, 's')) AS raw FROM b),
ch AS (SELECT page_id, count(*) FILTER (WHERE {trim_ws(dec("regexp_replace(raw, '<[^>]*>', '', 'g')"))} <> '') AS n
       FROM hh GROUP BY 1),
ps AS (SELECT page_id, unnest(string_split(h, '<p>')[2:]) AS seg FROM b),
cp AS (SELECT page_id, count(*) FILTER (WHERE {trim_ws(dec("regexp_replace(split_part(split_part(seg, '</p>', 1), '</article>', 1), '<[^>]*>', '', 'g')"))} <> '') AS n
       FROM ps GROUP BY 1)"""


_SCRAPE_CTES = VALIDATION_ORACLE + "," + DNS_VERDICT_SQL.strip() + "," + _COUNTS_SQL.strip() + f""",
snap AS (SELECT regexp_replace(url, '#.*$', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1),
sj AS (SELECT req_id, url, coalesce(max_retries, 3) AS mr,
              CASE WHEN coalesce(len(extract), 0) = 0 THEN ['links'] ELSE list_transform(extract, lambda t: lower(t)) END AS ex
       FROM v WHERE reject_reason IS NULL AND kind = 'scrape'),
st AS (SELECT sj.*, CASE
          WHEN NOT (sj.url LIKE 'http://%' OR sj.url LIKE 'https://%') THEN 'invalid_url'
          WHEN vd.host IS NULL THEN 'dns'
          WHEN vd.private_ip IS NOT NULL THEN 'private_ip'
          WHEN sn.url IS NULL THEN 'request_failed' END AS et, sn.page_id
       FROM sj LEFT JOIN verdict vd ON vd.host = lower({hostname('sj.url')})
               LEFT JOIN snap sn ON sn.url = regexp_replace(lower(regexp_extract(sj.url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))
                                     || substr(sj.url, strpos(sj.url, ':')), '#.*$', '')),
fx AS (SELECT *, CASE WHEN mr <= 0 THEN 'no_attempts' ELSE et END AS error_type FROM st)
"""


@query("scrape_jobs", oracle=_SCRAPE_CTES + """
SELECT CAST(req_id AS BIGINT) AS req_id, CASE WHEN error_type IS NULL THEN 'completed' ELSE 'failed' END AS status,
       error_type,
       CAST(CASE WHEN error_type IS NULL THEN 200 WHEN error_type = 'request_failed' THEN 0 END AS BIGINT) AS http_status,
       CAST(CASE WHEN error_type IS NULL THEN 0 ELSE 1 END AS BIGINT) AS retries_used,
       CAST(CASE WHEN error_type IS NULL THEN CASE WHEN list_contains(ex, 'links') THEN coalesce(cl.n, 0) ELSE 0 END END AS BIGINT) AS links_count,
       CAST(CASE WHEN error_type IS NULL THEN CASE WHEN list_contains(ex, 'headers') THEN coalesce(ch.n, 0) ELSE 0 END END AS BIGINT) AS headers_count,
       CAST(CASE WHEN error_type IS NULL THEN CASE WHEN list_contains(ex, 'paragraphs') THEN coalesce(cp.n, 0) ELSE 0 END END AS BIGINT) AS paragraphs_count
FROM fx LEFT JOIN cl ON cl.page_id = fx.page_id LEFT JOIN ch ON ch.page_id = fx.page_id
        LEFT JOIN cp ON cp.page_id = fx.page_id
""")
def q_scrape_jobs(spark, sf):
    _, jobs = _scrape(spark, sf)
    meta = job_meta(F.col("result"), F.col("status"), F.col("retries_used"))
    j = jobs.withColumn("meta", meta)
    return j.select(F.col("job_id").cast("bigint").alias("req_id"), "status", "error_type",
                    F.col("http_status").cast("bigint").alias("http_status"),
                    F.col("retries_used").cast("bigint").alias("retries_used"),
                    F.col("meta.links_count").cast("bigint").alias("links_count"),
                    F.col("meta.headers_count").cast("bigint").alias("headers_count"),
                    F.col("meta.paragraphs_count").cast("bigint").alias("paragraphs_count"))


@query("scrape_job_responses", oracle=_SCRAPE_CTES.rstrip() + f""",
md AS ({MARKDOWN_SQL}),
done AS (SELECT fx.req_id, fx.url, fx.error_type, vd.private_ip, list_contains(ex, 'markdown') AS with_md,
                octet_length(encode(md.markdown)) AS md_bytes,
                CASE WHEN list_contains(ex, 'links') THEN coalesce(cl.n, 0) ELSE 0 END AS links,
                CASE WHEN list_contains(ex, 'headers') THEN coalesce(ch.n, 0) ELSE 0 END AS headers,
                CASE WHEN list_contains(ex, 'paragraphs') THEN coalesce(cp.n, 0) ELSE 0 END AS paragraphs
         FROM fx LEFT JOIN cl ON cl.page_id = fx.page_id LEFT JOIN ch ON ch.page_id = fx.page_id
              LEFT JOIN cp ON cp.page_id = fx.page_id LEFT JOIN md ON md.page_id = fx.page_id
              LEFT JOIN verdict vd ON vd.host = lower({hostname('fx.url')}))
SELECT CAST(req_id AS BIGINT) AS job_id, CASE WHEN error_type IS NULL THEN 'completed' ELSE 'failed' END AS status, url,
       CASE WHEN error_type IS NULL THEN '{{"links_count":' || links || ',"headers_count":' || headers || ',"paragraphs_count":' ||
            paragraphs || ',"markdown_length":' || CASE WHEN with_md THEN md_bytes ELSE 0 END ||
            ',"pages_crawled":0,"url_count":0,"http_status":200,"retries_used":0,"truncated":false}}' END AS meta_json,
       CASE error_type WHEN 'no_attempts' THEN 'no attempts' WHEN 'dns' THEN 'dns lookup failed' WHEN 'request_failed' THEN 'request failed'
            WHEN 'invalid_url' THEN 'invalid URL: must be http:// or https://: ' || url
            WHEN 'private_ip' THEN 'request refused: target resolves to a private IP: ' || lower({hostname('url')}) ||
                                   ' resolves to ' || private_ip END AS error,
       CAST(CASE WHEN error_type IS NULL AND with_md THEN md_bytes END AS BIGINT) AS markdown_bytes
FROM done
""")
def q_scrape_job_responses(spark, sf):
    from pagefold.operators.jobs import job_response
    acc, jobs = _scrape(spark, sf)
    full = jobs.join(acc.select("job_id", "url"), "job_id").withColumn("created_at", F.lit(None).cast("timestamp")) \
        .withColumn("completed_at", F.lit(None).cast("timestamp")).withColumn("duration_ms", F.lit(0).cast("bigint"))
    r = job_response(full)
    return r.select(F.col("job_id").cast("bigint"), "status", "url", F.to_json("meta").alias("meta_json"), "error",
                    F.octet_length(F.col("results.markdown")).cast("bigint").alias("markdown_bytes"))


@query("job_result_json")
def q_job_result_json(spark, sf):
    """Result JSON as stored (omitempty rules), decoded back; rows-only check."""
    from pagefold.sources.jsoncodec import parse_result_json, result_to_json
    _, jobs = _scrape(spark, sf)
    enc = jobs.select(F.col("job_id").cast("bigint"), "status", result_to_json(F.col("result")).alias("result_json"))
    dec = enc.withColumn("_r", parse_result_json(F.col("result_json")))
    return dec.select("job_id", "status", "result_json",
                      F.coalesce(F.size("_r.links"), F.lit(0)).alias("links_count"),
                      F.col("_r.http_status").alias("http_status"))


#: One job per page. The page id picks what its job meets: a scheme that is refused, a page that needs a browser, no
#: attempts, an alias chain with and without following, a missing page, or its own URL; and how its page answers.
_OUTCOME_JOBS = """
SELECT page_id AS job_id,
       CASE page_id % 16
         WHEN 0 THEN 'ftp://' || substr(nurl, strpos(nurl, '://') + 3)
         WHEN 3 THEN alias WHEN 4 THEN alias
         WHEN 5 THEN nurl || '/missing'
         ELSE nurl END AS url,
       CASE WHEN page_id % 16 = 2 THEN 0 ELSE 3 END AS max_retries,
       page_id % 16 <> 4 AS follow, page_id % 16 = 1 AS render_js
FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS nurl,
             CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '#.*$', '')
                  ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/r' ||
                       CAST(page_id AS STRING) || '/' || CAST(page_id % 7 AS STRING) END AS alias
      FROM pages) AS p
"""
_ANSWERS = """CASE page_id % 16 WHEN 6 THEN 404 WHEN 7 THEN 503 ELSE 200 END AS http_status,
       CASE page_id % 16 WHEN 8 THEN 'timeout' WHEN 9 THEN 'parse_failure' END AS error"""


@query("scrape_outcomes", oracle="WITH RECURSIVE " + DNS_VERDICT_SQL.strip() + f""",
red AS (SELECT DISTINCT * FROM ({_duck(REDIRECT_SQL)})),
jobs AS ({_duck(_OUTCOME_JOBS)}),
snap AS (SELECT url, page_id, {_ANSWERS}
         FROM (SELECT regexp_replace(url, '#.*$', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1)),
chain AS (SELECT job_id, url AS cur, 0 AS hops FROM jobs
          UNION ALL SELECT c.job_id, r.location, c.hops + 1 FROM chain c JOIN red r ON r.url = c.cur WHERE c.hops < 5),
ends AS (SELECT job_id, max(hops) AS h, arg_max(cur, hops) AS last FROM chain GROUP BY job_id),
met AS (SELECT j.*, e.h, e.last, r.http_status AS moved, v.host IS NULL AS nodns, v.private_ip IS NOT NULL AS priv
        FROM jobs j JOIN ends e USING (job_id) LEFT JOIN red r ON r.url = j.url
             LEFT JOIN verdict v ON v.host = lower({hostname('j.url')})),
seen AS (SELECT met.*, s.http_status AS st, s.error AS er FROM met
         LEFT JOIN snap s ON s.url = CASE WHEN follow THEN last ELSE met.url END),
outcome AS (SELECT *, CASE
    WHEN max_retries <= 0 THEN 'no_attempts' WHEN url LIKE 'ftp:%' THEN 'invalid_url' WHEN nodns THEN 'dns' WHEN priv THEN 'private_ip'
    WHEN render_js THEN 'browser_unavailable' WHEN follow AND h >= 5 THEN 'too_many_redirects'
    WHEN NOT follow AND h >= 1 THEN 'http_failed' WHEN st IS NULL THEN 'request_failed' WHEN er = 'timeout' THEN 'timeout'
    WHEN st <> 200 THEN 'http_failed' WHEN er IS NOT NULL THEN er END AS error_type FROM seen)
SELECT CAST(job_id AS BIGINT) AS job_id, CASE WHEN error_type IS NULL THEN 'completed' ELSE 'failed' END AS status, error_type,
       CAST(CASE WHEN error_type IN ('no_attempts', 'invalid_url', 'dns', 'private_ip') THEN NULL
                 WHEN error_type IN ('browser_unavailable', 'too_many_redirects', 'request_failed', 'timeout') THEN 0
                 WHEN NOT follow AND h >= 1 THEN moved ELSE st END AS BIGINT) AS http_status
FROM outcome
""")
def q_scrape_outcomes(spark, sf):
    p = pages(spark, sf)
    options = F.struct(F.lit(None).cast("int").alias("timeout_seconds"), "max_retries", F.col("follow").alias("follow_redirects"),
                       *[F.lit(None).cast("int").alias(c) for c in ("max_pages", "max_depth", "max_urls")], "render_js")
    jobs = spark.sql(_OUTCOME_JOBS.replace("FROM pages", "FROM {pages}").replace("strpos(nurl, '://')", "instr(nurl, '://')"),
                     pages=p.select("page_id", "url")).select("job_id", "url", F.array(F.lit("links")).alias("extract"), options.alias("options"))
    snap = page_snapshot(p).select("url", "page_id", "body").selectExpr("url", "body", *_ANSWERS.split(",\n       "))
    done = X.scrape_jobs(jobs, snap, dns_snapshot(spark, p), redirect_table(spark, p).distinct(), browser_available=False)
    return done.select(F.col("job_id").cast("bigint"), "status", "error_type", F.col("http_status").cast("bigint"))


#: Two requests for every page, the second with other types than the first.
_TYPES = (("links",), ("headers", "Paragraphs"), ("all",), ("markdown",), ())


def _two_a_page_sql() -> str:
    lists = " ".join(f"WHEN {i} THEN {list(t) if t else '[]::VARCHAR[]'}" for i, t in enumerate(_TYPES))
    return f"""
jobs AS (SELECT page_id * 2 + k AS job_id, page_id, url, CASE (page_id + 2 * k) % 5 {lists} END AS ex
         FROM pages, (VALUES (0), (1)) t(k)),
low AS (SELECT *, CASE WHEN len(ex) = 0 THEN ['links'] ELSE list_transform(ex, lambda t: lower(t)) END AS lx FROM jobs),
first AS (SELECT regexp_replace(url, '#.*$', '') AS nurl, min(page_id) AS page_id FROM pages GROUP BY 1),
got AS (SELECT low.job_id, lx, CASE WHEN v.host IS NULL THEN 'dns' WHEN v.private_ip IS NOT NULL THEN 'private_ip' END AS error_type,
               first.page_id
        FROM low JOIN first ON first.nurl = regexp_replace(low.url, '#.*$', '') LEFT JOIN verdict v ON v.host = lower({hostname('low.url')}))"""


def _if_asked(t: str, value: str) -> str:
    return f"CASE WHEN error_type IS NULL AND (list_contains(lx, '{t}') OR list_contains(lx, 'all')) THEN {value} END"


@query("scrape_every_page", oracle="WITH " + DNS_VERDICT_SQL.strip() + "," + _two_a_page_sql().strip() + "," + _COUNTS_SQL.strip() + f""",
md AS ({MARKDOWN_SQL})
SELECT CAST(job_id AS BIGINT) AS job_id, error_type, CAST(CASE WHEN error_type IS NULL THEN 200 END AS BIGINT) AS http_status,
       CAST({_if_asked('links', 'coalesce(cl.n, 0)')} AS BIGINT) AS links, CAST({_if_asked('headers', 'coalesce(ch.n, 0)')} AS BIGINT) AS headers,
       CAST({_if_asked('paragraphs', 'coalesce(cp.n, 0)')} AS BIGINT) AS paragraphs, {_if_asked('markdown', 'md.markdown')} AS markdown,
       CASE WHEN error_type IS NULL THEN false END AS truncated
FROM got LEFT JOIN cl USING (page_id) LEFT JOIN ch USING (page_id) LEFT JOIN cp USING (page_id) LEFT JOIN md USING (page_id)
""")
def q_scrape_every_page(spark, sf):
    """Two valid scrape jobs for every page (S2, J1): a page is read and parsed once for both, each gets its own types."""
    p = pages(spark, sf)
    lists = F.array(*(F.array(*map(F.lit, t)) if t else F.array().cast("array<string>") for t in _TYPES))
    twice = p.select("page_id", "url", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    jobs = twice.select((F.col("page_id") * 2 + F.col("k")).alias("job_id"), "url", F.lit(None).cast(OPTIONS_SCHEMA).alias("options"),
                        F.get(lists, ((F.col("page_id") + 2 * F.col("k")) % 5).cast("int")).alias("extract"))
    r = X.scrape_jobs(jobs, page_snapshot(p), dns_snapshot(spark, p), redirect_table(spark, p))
    n = lambda c: F.when(F.col("result")[c].isNotNull(), F.size(F.col("result")[c])).cast("bigint").alias(c)
    return r.select(F.col("job_id").cast("bigint").alias("job_id"), "error_type", F.col("http_status").cast("bigint").alias("http_status"),
                    n("links"), n("headers"), n("paragraphs"), F.col("result.markdown").alias("markdown"), F.col("result.truncated").alias("truncated"))
