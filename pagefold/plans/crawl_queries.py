"""Crawl / map queries over the derived site graph.

Every page of the snapshot seeds one crawl (crawl_id = page_id), so the work
grows with the table. The oracle unrolls the same level-synchronous BFS in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import crawl as C
from pagefold.plans.catalog import query
from pagefold.plans.network_queries import DNS_VERDICT_SQL, _duck
from pagefold.plans.network_queries import _COUNTS_SQL as COUNTS_SQL
from pagefold.plans.sqlsnippets import RAW_HREFS, escaped_path, hostname, origin
from pagefold.sources.network import REDIRECT_SQL, alias_chain_heads, dns_snapshot, redirect_table
from pagefold.sources.sitegraph import BLOCK, site_snapshot
from pagefold.sources.tables import pages

CRAWL_PAGES, CRAWL_DEPTH = 10, 2
MAP_URLS, MAP_DEPTH = 50, 2


def _graph_sql() -> str:
    return f"""
p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS nurl,
             lower({hostname('url')}) AS host, CAST(floor(page_id / {BLOCK}) AS BIGINT) AS blk FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY host, blk ORDER BY page_id) AS n FROM p),
snap AS (SELECT nurl AS url, min(page_id) AS page_id FROM p GROUP BY nurl),
syn AS (SELECT a.page_id, t.k, b.nurl AS link
        FROM n a CROSS JOIN (VALUES (0), (1), (2)) t(k)
        JOIN n b ON a.host = b.host AND a.blk = b.blk
                AND b.n = CASE t.k WHEN 0 THEN 2 * a.n WHEN 1 THEN 2 * a.n + 1 ELSE 1 END
        WHERE t.k < 2 OR a.n > 1),
rh AS ({RAW_HREFS}),
rl AS (SELECT page_id, pos, {origin('url')} || {escaped_path('href')} AS link FROM rh),
nreal AS (SELECT page_id, count(*) AS c FROM rh GROUP BY page_id),
sl AS (SELECT s.page_id, coalesce(nr.c, 0) + row_number() OVER (PARTITION BY s.page_id ORDER BY s.k) - 1 AS pos, s.link
       FROM syn s LEFT JOIN nreal nr ON nr.page_id = s.page_id),
al AS (SELECT page_id, pos, link FROM rl UNION ALL SELECT page_id, pos, link FROM sl),
edges AS (SELECT snap.url AS src_url, al.pos, al.link AS dst_url
          FROM al JOIN snap ON snap.page_id = al.page_id
          WHERE lower({hostname('al.link')}) = lower({hostname('snap.url')}))"""


def bfs_sql(budget: int, max_depth: int, graph: str | None = None, seeds: str = "SELECT page_id, url FROM snap",
            stop: str = "2147483647") -> str:
    """Unrolled BFS: l<k> = listed items of level k (rank < budget). ``served`` says what a request of a URL gets;
    ``stop`` is the rank from which a crawl fetches nothing more."""
    parts = [graph or _graph_sql() + """,
served AS (SELECT url, true AS ok, 200 AS http_status FROM snap)""", f""",
l0 AS (SELECT page_id AS crawl_id, url, 0 AS depth, 0 AS rank FROM ({seeds}) z),
f0 AS (SELECT l.*, coalesce(s.ok, false) AS ok, coalesce(s.http_status, 0) AS http_status
       FROM l0 l LEFT JOIN served s ON s.url = l.url),
o0 AS (SELECT crawl_id, 1 AS next_rank FROM l0)"""]
    seen = ["l0"]
    for k in range(1, max_depth + 1):
        prev = f"f{k - 1}"
        seen_union = " UNION ALL ".join(f"SELECT crawl_id, url FROM {s}" for s in seen)
        parts.append(f""",
c{k} AS (SELECT f.crawl_id, e.dst_url AS url, f.rank AS parent_rank, e.pos, f.depth + 1 AS depth
        FROM {prev} f JOIN edges e ON e.src_url = f.url WHERE f.ok AND f.depth < {max_depth} AND f.rank < {stop}),
d{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY parent_rank, pos) AS rn
                        FROM c{k}) WHERE rn = 1),
a{k} AS (SELECT d.* FROM d{k} d WHERE NOT EXISTS (SELECT 1 FROM ({seen_union}) s
                                                   WHERE s.crawl_id = d.crawl_id AND s.url = d.url)),
r{k} AS (SELECT a.crawl_id, a.url, a.depth,
                o.next_rank + row_number() OVER (PARTITION BY a.crawl_id ORDER BY a.parent_rank, a.pos) - 1 AS rank
         FROM a{k} a JOIN o{k - 1} o ON o.crawl_id = a.crawl_id),
o{k} AS (SELECT o.crawl_id, o.next_rank + coalesce(x.c, 0) AS next_rank
         FROM o{k - 1} o LEFT JOIN (SELECT crawl_id, count(*) AS c FROM a{k} GROUP BY crawl_id) x
              ON x.crawl_id = o.crawl_id),
l{k} AS (SELECT crawl_id, url, depth, rank FROM r{k} WHERE rank < {budget}),
f{k} AS (SELECT l.*, coalesce(s.ok, false) AS ok, coalesce(s.http_status, 0) AS http_status
        FROM l{k} l LEFT JOIN served s ON s.url = l.url)""")
        seen.append(f"l{k}")
    levels = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(max_depth + 1))
    return f"WITH {'RECURSIVE ' if graph else ''}" + "".join(parts).strip() + f",\nallf AS ({levels})\n"


def _seeds(snap, budget_col, budget, depth, follow=True):
    return snap.select(F.col("page_id").alias("crawl_id"), F.col("url").alias("seed_url"),
                       F.lit(budget).alias(budget_col), F.lit(depth).alias("max_depth"),
                       F.lit(follow).alias("follow"))


@query("crawl_bfs", oracle=bfs_sql(CRAWL_PAGES, CRAWL_DEPTH) + """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth, ok,
       CAST(CASE WHEN ok THEN 200 ELSE 0 END AS BIGINT) AS http_status
FROM allf WHERE rank < 10
""")
def q_crawl_bfs(spark, sf):
    snap = site_snapshot(pages(spark, sf))
    cp = C.crawl_bfs(_seeds(snap, "max_pages", CRAWL_PAGES, CRAWL_DEPTH), snap)
    return cp.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url",
                     F.col("depth").cast("bigint"), "ok", F.col("http_status").cast("bigint"))


@query("crawl_rollup", oracle=bfs_sql(CRAWL_PAGES, CRAWL_DEPTH) + """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(count(*) AS BIGINT) AS pages_crawled,
       CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS pages_skipped, false AS truncated,
       CAST(arg_min(CASE WHEN ok THEN 200 ELSE 0 END, rank) AS BIGINT) AS http_status
FROM allf WHERE rank < 10 GROUP BY crawl_id
""")
def q_crawl_rollup(spark, sf):
    snap = site_snapshot(pages(spark, sf))
    cp = C.crawl_bfs(_seeds(snap, "max_pages", CRAWL_PAGES, CRAWL_DEPTH), snap)
    r = C.crawl_rollup(cp)
    return r.select(F.col("crawl_id").cast("bigint"), F.col("pages_crawled").cast("bigint"),
                    F.col("pages_skipped").cast("bigint"), "truncated", F.col("http_status").cast("bigint"))


@query("crawl_default_extract", oracle="""
SELECT CAST(min(page_id) AS BIGINT) AS crawl_id, CAST(0 AS BIGINT) AS rank, regexp_replace(url, '#.*$', '') AS url,
       CAST(0 AS BIGINT) AS depth, true AS ok, CAST(200 AS BIGINT) AS http_status
FROM pages GROUP BY regexp_replace(url, '#.*$', '')
""")
def q_crawl_default_extract(spark, sf):
    # default extract [markdown]: links are not extracted, so only the seed is visited
    snap = site_snapshot(pages(spark, sf))
    cp = C.crawl_bfs(_seeds(snap, "max_pages", CRAWL_PAGES, CRAWL_DEPTH, follow=False), snap)
    return cp.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url",
                     F.col("depth").cast("bigint"), "ok", F.col("http_status").cast("bigint"))


@query("map_bfs", oracle=bfs_sql(MAP_URLS, MAP_DEPTH) + """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth
FROM allf WHERE rank < 50
""")
def q_map_bfs(spark, sf):
    snap = site_snapshot(pages(spark, sf))
    m = C.map_bfs(_seeds(snap, "max_urls", MAP_URLS, MAP_DEPTH), snap)
    return m.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url",
                    F.col("depth").cast("bigint"))


def _jobs(snap, kind, **options):
    """One accepted job per snapshot page; every 50th seed is not a URL that parses."""
    url = F.when(F.col("page_id") % 50 == 7, F.lit("http://bad host/")).otherwise(F.col("url"))
    opts = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in options.items()])
    return snap.select(F.col("page_id").alias("job_id"), url.alias("url"), F.array(F.lit("links")).alias("extract"),
                       opts.alias("options"))


_BROKEN = "crawl_id % 50 = 7"
_JOB_COLUMNS = f"""CAST(crawl_id AS BIGINT) AS job_id, CASE WHEN {_BROKEN} THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN {_BROKEN} THEN 'invalid_url' END AS error_type,
       CASE WHEN {_BROKEN} THEN 'invalid URL: must be http:// or https://: http://bad host/' END AS error_msg,
       CAST(CASE WHEN {_BROKEN} THEN 1 ELSE 0 END AS BIGINT) AS retries_used"""


def _unless_broken(sql: str, alias: str) -> str:
    return f"CASE WHEN NOT {_BROKEN} THEN {sql} END AS {alias}"


@query("crawl_job_results", oracle=bfs_sql(CRAWL_PAGES, CRAWL_DEPTH) + f"""
SELECT {_JOB_COLUMNS}, {_unless_broken("CAST(arg_min(CASE WHEN ok THEN 200 ELSE 0 END, rank) AS BIGINT)", "http_status")},
       {_unless_broken("CAST(count(*) AS BIGINT)", "pages_crawled")},
       {_unless_broken("CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT)", "pages_skipped")},
       {_unless_broken("string_agg(url, ' ' ORDER BY rank)", "page_urls")}
FROM allf WHERE rank < 10 GROUP BY crawl_id
""")
def q_crawl_job_results(spark, sf):
    snap = site_snapshot(pages(spark, sf))
    r = C.crawl_job_results(_jobs(snap, "crawl", max_pages=CRAWL_PAGES, max_depth=CRAWL_DEPTH), snap)
    return r.select(F.col("job_id").cast("bigint"), "status", "error_type", "error_msg",
                    F.col("retries_used").cast("bigint"), F.col("http_status").cast("bigint"),
                    F.col("result.pages_crawled").cast("bigint").alias("pages_crawled"),
                    F.col("result.pages_skipped").cast("bigint").alias("pages_skipped"),
                    F.array_join(F.col("result.pages.url"), " ").alias("page_urls"))


@query("map_job_results", oracle=bfs_sql(MAP_URLS, MAP_DEPTH) + f"""
SELECT {_JOB_COLUMNS}, {_unless_broken("CAST(200 AS BIGINT)", "http_status")},
       {_unless_broken("string_agg(url, ' ' ORDER BY rank)", "urls")}
FROM allf WHERE rank < 50 GROUP BY crawl_id
""")
def q_map_job_results(spark, sf):
    snap = site_snapshot(pages(spark, sf))
    r = C.map_job_results(_jobs(snap, "map", max_urls=MAP_URLS, max_depth=MAP_DEPTH), snap)
    return r.select(F.col("job_id").cast("bigint"), "status", "error_type", "error_msg",
                    F.col("retries_used").cast("bigint"), F.col("http_status").cast("bigint"),
                    F.array_join(F.col("result.urls"), " ").alias("urls"))


CHAIN_DEPTH = 9


@query("crawl_depth", oracle=bfs_sql(100, CHAIN_DEPTH) + """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth, ok
FROM allf WHERE rank < 100
""")
def q_crawl_depth(spark, sf):
    # deeper than the request layer's own limit of five: the crawl goes on until its frontier is empty
    snap = site_snapshot(pages(spark, sf))
    cp = C.crawl_bfs(_seeds(snap, "max_pages", 100, CHAIN_DEPTH), snap)
    return cp.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url",
                     F.col("depth").cast("bigint"), "ok")


@query("map_cancelled", oracle=bfs_sql(MAP_URLS, 0) + """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(rank AS BIGINT) AS rank, url FROM allf
""")
def q_map_cancelled(spark, sf):
    # every map is cancelled before its first fetch: what is known by then, the seed, stays listed
    snap = site_snapshot(pages(spark, sf))
    m = C.map_bfs(_seeds(snap, "max_urls", MAP_URLS, MAP_DEPTH), snap, active=snap.where("false").select(F.col("page_id").alias("crawl_id")))
    return m.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url")


@query("crawl_pages_content", oracle=bfs_sql(CRAWL_PAGES, CRAWL_DEPTH) + f""",
{COUNTS_SQL.strip()}
SELECT CAST(f.crawl_id AS BIGINT) AS crawl_id, CAST(f.rank AS BIGINT) AS rank, f.url, f.ok,
       CAST(CASE WHEN f.ok THEN coalesce(ch.n, 0) END AS BIGINT) AS headers_count,
       CAST(CASE WHEN f.ok THEN coalesce(cp.n, 0) END AS BIGINT) AS paragraphs_count,
       CASE WHEN f.ok THEN false END AS truncated
FROM allf f LEFT JOIN snap ON snap.url = f.url LEFT JOIN ch ON ch.page_id = snap.page_id
     LEFT JOIN cp ON cp.page_id = snap.page_id
WHERE f.rank < 10
""")
def q_crawl_pages_content(spark, sf):
    snap = site_snapshot(pages(spark, sf))
    cp = C.crawl_bfs(_seeds(snap, "max_pages", CRAWL_PAGES, CRAWL_DEPTH), snap)
    c = C.crawl_contents(cp, snap, ["headers", "paragraphs", "markdown"])
    return c.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url", "ok",
                    F.when(F.col("ok"), F.size("headers")).cast("bigint").alias("headers_count"),
                    F.when(F.col("ok"), F.size("paragraphs")).cast("bigint").alias("paragraphs_count"), "truncated")


#: Crawls start at the head of a page's alias chain, 0 to 6 redirects long; a third of the pages links to the http twins
#: of their neighbours; some hosts have no DNS answer, some a private one.
_NO_DNS = "length(host) % 6 = 1"


def _guarded_graph_sql(follow: bool) -> str:
    base = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    redirected = "a.h > 0" if follow else "false"
    stopped = "false" if follow else "a.h > 0"
    return _graph_sql().replace("edges AS (SELECT snap.url", "plain_edges AS (SELECT snap.url") + "," + DNS_VERDICT_SQL.strip() + f""",
red AS ({_duck(REDIRECT_SQL)}),
heads AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url ELSE {base} || '/r' || CAST(page_id AS VARCHAR) || '/' ||
                 CAST(page_id % 7 AS VARCHAR) END AS url FROM snap),
known AS (SELECT url FROM snap UNION SELECT url FROM red),
chain AS (SELECT url, url AS cur, 0 AS hops FROM known
          UNION ALL SELECT c.url, r.location, c.hops + 1 FROM chain c JOIN red r ON r.url = c.cur WHERE c.hops < 5),
hops AS (SELECT c.*, v.host IS NULL OR v.host IN (SELECT host FROM verdict WHERE {_NO_DNS}) OR v.private_ip IS NOT NULL AS bad
         FROM chain c LEFT JOIN verdict v ON v.host = lower({hostname('c.cur')})),
ag AS (SELECT url, max(hops) AS h, min(hops) FILTER (WHERE hops >= 1 AND bad) AS e, bool_or(bad) FILTER (WHERE hops = 0) AS own,
              arg_max(cur, hops) AS last FROM hops GROUP BY url),
served AS (
  SELECT a.url, s.page_id, NOT own AND NOT ({redirected} AND (coalesce(e, 9) <= 4 OR h >= 5)) AND NOT {stopped} AND s.url IS NOT NULL AS ok,
         CASE WHEN own OR ({redirected} AND (coalesce(e, 9) <= 4 OR h >= 5)) THEN 0
              WHEN {stopped} THEN (SELECT max(http_status) FROM red WHERE red.url = a.url)
              WHEN s.url IS NOT NULL THEN 200 ELSE 0 END AS http_status
  FROM ag a LEFT JOIN snap s ON s.url = {'a.last' if follow else 'a.url'}),
edges AS (
  SELECT v.url AS src_url, x.pos, x.link AS dst_url FROM served v JOIN (
    SELECT page_id, pos, NULL AS link, href FROM rh
    UNION ALL SELECT page_id, pos, CASE WHEN page_id % 3 = 0 AND link LIKE 'https://%' THEN 'http://' || substr(link, 9) ELSE link END, NULL FROM sl) y
    ON y.page_id = v.page_id, LATERAL (SELECT y.pos AS pos, coalesce(y.link, {origin('v.url')} || {escaped_path('y.href')}) AS link) x
  WHERE v.ok AND lower({hostname('x.link')}) = lower({hostname('v.url')}))"""


def _guarded(spark, sf, budget_col, budget, depth):
    p = pages(spark, sf)
    snap = site_snapshot(p)
    twins = F.when(F.col("page_id") % 3 == 0, F.replace("body", F.lit('href="https://'), F.lit('href="http://'))).otherwise(F.col("body"))
    snap = snap.withColumn("body", twins)
    heads = alias_chain_heads(spark, p).join(snap.select("page_id"), "page_id", "left_semi")
    return _seeds(heads, budget_col, budget, depth), snap, dns_snapshot(spark, p).where(f"NOT ({_NO_DNS})"), redirect_table(spark, p)


def _crawl_rows(cp):
    return cp.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url", F.col("depth").cast("bigint"), "ok",
                     F.col("http_status").cast("bigint"))


_CRAWL_ROWS = """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth, ok,
       CAST(http_status AS BIGINT) AS http_status
FROM allf WHERE rank < 10"""


@query("crawl_guarded", oracle=bfs_sql(CRAWL_PAGES, CRAWL_DEPTH, _guarded_graph_sql(True), "SELECT * FROM heads") + _CRAWL_ROWS)
def q_crawl_guarded(spark, sf):
    """Every page of a crawl behind scheme, DNS and private-address checks and redirects (G1 with P2, P8, G3)."""
    return _crawl_rows(C.crawl_guarded(*_guarded(spark, sf, "max_pages", CRAWL_PAGES, CRAWL_DEPTH)))


@query("crawl_guarded_no_redirects", oracle=bfs_sql(CRAWL_PAGES, CRAWL_DEPTH, _guarded_graph_sql(False), "SELECT * FROM heads") + _CRAWL_ROWS)
def q_crawl_guarded_no_redirects(spark, sf):
    return _crawl_rows(C.crawl_guarded(*_guarded(spark, sf, "max_pages", CRAWL_PAGES, CRAWL_DEPTH), follow_redirects=False))


@query("map_guarded", oracle=bfs_sql(MAP_URLS, MAP_DEPTH, _guarded_graph_sql(True), "SELECT * FROM heads") + """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth
FROM allf WHERE rank < 50
""")
def q_map_guarded(spark, sf):
    m = C.map_guarded(*_guarded(spark, sf, "max_urls", MAP_URLS, MAP_DEPTH))
    return m.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url", F.col("depth").cast("bigint"))


#: A quarter of the crawls runs to its end; others are cancelled after one page, after three, or before the first.
_STOP = "CASE crawl_id % 4 WHEN 0 THEN 2147483647 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END"


def _cancelled(spark, sf, budget_col, budget):
    snap = site_snapshot(pages(spark, sf))
    start = F.timestamp_seconds(1_700_000_000 + F.col("crawl_id"))
    crawls = _seeds(snap, budget_col, budget, 2).withColumn("started_at", start)
    # dated cancellations; one before the start of its crawl, which means nothing, and a second one that comes too late
    dated = crawls.where("crawl_id % 4 <> 0").select("crawl_id", F.explode(F.array(
        F.lit(-5.0), F.expr("CASE crawl_id % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 2.25 ELSE 0.0 END"), F.lit(60.0))).alias("after"), "started_at")
    dated = dated.select("crawl_id", F.timestamp_micros(((F.unix_micros("started_at")) + F.col("after") * 1_000_000).cast("long")).alias("cancelled_at"))
    return C.stop_ranks(crawls, dated), snap


@query("crawl_cancelled_midway", oracle=bfs_sql(CRAWL_PAGES, CRAWL_DEPTH, stop=_STOP) + _CRAWL_ROWS + f" AND rank < {_STOP}")
def q_crawl_cancelled_midway(spark, sf):
    """Crawls that are cancelled while they run (T8): pages visited before stay, no page after is fetched."""
    return _crawl_rows(C.crawl_bfs(*_cancelled(spark, sf, "max_pages", CRAWL_PAGES)))


@query("map_cancelled_midway", oracle=bfs_sql(MAP_URLS, MAP_DEPTH, stop=_STOP) + """
SELECT CAST(crawl_id AS BIGINT) AS crawl_id, CAST(rank AS BIGINT) AS rank, url, CAST(depth AS BIGINT) AS depth
FROM allf WHERE rank < 50
""")
def q_map_cancelled_midway(spark, sf):
    m = C.map_bfs(*_cancelled(spark, sf, "max_urls", MAP_URLS))
    return m.select(F.col("crawl_id").cast("bigint"), F.col("rank").cast("bigint"), "url", F.col("depth").cast("bigint"))
