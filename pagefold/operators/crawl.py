"""Bounded breadth-first crawl and URL map for many seeds at once.

Level-synchronous BFS: every level is one Spark job over all active crawls.

    frontier --left join--> snapshot (fetch: status, ok = 2xx)           J1
      ok & depth < max_depth & links followed
        --join--> edges (src_url -> dst_url, same host, normalised)      A12
        first occurrence per (crawl, dst) by (parent rank, link pos)     A9
        that is not among the URLs already seen by the crawl             J2
        rank = discovered-so-far + row_number(parent rank, pos)          W3
        keep rank < budget; a crawl that has its budget ends here       L3/L4

Ranks follow the reference's queue order (depth, parent order, link position), so
cutting each level at the budget visits exactly the pages the sequential queue
visits. Items beyond the budget are dropped early: they would never be visited and
every later discovery ranks after them. Per-crawl work per level is bounded by the
budget (at most 100 pages / 500 URLs), so windows keyed by crawl never grow with the
data; the number of crawls does, and they spread over partitions.

Each level's frontier is checkpointed (reliable checkpoint in the cluster's
``spark.checkpoint.dir``) so lineage does not grow and a lost executor only
recomputes one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import urls as U
from pagefold.operators.extract import extract_pages
from pagefold.operators.fetch import guarded_answers
from pagefold.operators.jobs import ERROR_MESSAGES
from pagefold.operators.links import exploded
from pagefold.session import cut_lineage

# ---- fixed values: crawl-layer defaults and the validated depth cap ---------------------
CRAWL_DEFAULT_PAGES, CRAWL_DEFAULT_DEPTH, CRAWL_DEFAULT_EXTRACT = 10, 2, "markdown"
MAP_DEFAULT_URLS, MAP_DEFAULT_DEPTH = 50, 2
# ------------------------------------------------------------------------------------------


def snapshot_edges(snapshot: DataFrame, *, same_host: bool = True) -> DataFrame:
    """(src_url, pos, dst_url) from the snapshot bodies: links resolved against the
    page URL, normalised (fragment dropped), kept when the hostname matches the
    source page's (case-insensitive). Computed once per snapshot, hash-partitioned by
    ``src_url`` so every level's join reuses the partitioning."""
    ext = extract_pages(snapshot, ["links"], url_col="url", body_col="body", keep=(), resolve=False)
    # one resolve per link gives the normalised URL and its host; the source host is
    # computed once per page, before the explode
    ext = ext.select(F.col("url").alias("src_url"), F.lower(U.hostname(F.col("url"))).alias("src_host"),
                     U.resolve_urls(F.col("url"), F.col("links"), keep_fragment=False, with_host=True).alias("l"))
    e = exploded(ext, "l", "d", "src_url", "src_host") \
        .select("src_url", "src_host", "pos", F.col("d.url").alias("dst_url"), F.col("d.host").alias("dst_host"))
    if same_host:
        e = e.where((F.col("src_host") == F.col("dst_host")) & (F.col("dst_host") != ""))
    return e.select("src_url", "pos", "dst_url")


def snapshot_hrefs(snapshot: DataFrame) -> DataFrame:
    """(final_url, hrefs): the unresolved links of every page, for pages that answer under several URLs."""
    ext = extract_pages(snapshot, ["links"], url_col="url", body_col="body", keep=(), resolve=False)
    return ext.select(F.col("url").alias("final_url"), F.col("links").alias("hrefs"))


def edges_of(parents: DataFrame, hrefs: DataFrame) -> DataFrame:
    """(src_url, pos, dst_url) of the pages that ``parents`` (url, final_url) were answered with: links are resolved
    against the URL that was asked for, not the one that a redirect led to. A URL in many crawls is resolved once."""
    asked = parents.select(F.col("url").alias("src_url"), "final_url").distinct().join(hrefs, "final_url")
    asked = asked.select("src_url", F.lower(U.hostname(F.col("src_url"))).alias("src_host"),
                         U.resolve_urls(F.col("src_url"), F.col("hrefs"), keep_fragment=False, with_host=True).alias("l"))
    found = exploded(asked, "l", "d", "src_url", "src_host")
    return found.where((F.col("src_host") == F.col("d.host")) & (F.col("src_host") != "")).select("src_url", "pos", F.col("d.url").alias("dst_url"))


def _fetch(frontier: DataFrame, answers: DataFrame) -> DataFrame:
    f = frontier.join(answers, "url", "left").withColumn("http_status", F.coalesce(F.col("http_status"), F.lit(0)))
    # behind the guard a URL that is not allowed has no answer, whatever the snapshot holds
    return f.withColumn("ok", F.coalesce("ok", F.lit(False)) if "ok" in answers.columns else F.col("http_status").between(200, 299))


def _expand(parents: DataFrame, edges: DataFrame, frontiers: list[DataFrame], budget_col: str):
    """Next frontier from fetched parents of crawls that are not full: what they link to and the crawl has not listed
    yet, up to the budget. All items of a crawl carry its options and, as ``next_rank``, how many it has listed."""
    options = (budget_col, "max_depth", "follow", "stop_rank", "next_rank", "depth")
    cand = parents.select("crawl_id", F.col("url").alias("src_url"), F.shiftleft(F.col("rank").cast("long"), 32).alias("at"), *options) \
        .join(edges, "src_url").select("crawl_id", F.col("dst_url").alias("url"), (F.col("at") + F.col("pos")).alias("at"), *options)
    seen = frontiers[0].select("crawl_id", "url")
    for f in frontiers[1:]:
        seen = seen.unionByName(f.select("crawl_id", "url"))
    if len(frontiers) > 2:  # by now many crawls are full: only the lists of those that go on are compared
        seen = seen.join(parents.select("crawl_id").distinct(), "crawl_id", "left_semi")
    # a crawl's finds and its list meet in one shuffle, by crawl as the ranks need it. One number stands for parent rank
    # and link position, -1 for what is listed; the rest is one value per crawl, so nothing is sorted by URL
    both = cand.unionByName(seen.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True).repartition("crawl_id")
    first = both.groupBy("crawl_id", "url").agg(F.min("at").alias("at"), *(F.max(c).alias(c) for c in options)).where("at >= 0")
    crawl = Window.partitionBy("crawl_id").orderBy("at")
    ranked = first.withColumn("rank", (F.col("next_rank") + F.row_number().over(crawl) - 1).cast("int"))
    ranked = ranked.where(F.col("rank") < F.col(budget_col))
    return ranked.select("crawl_id", "url", "rank", (F.col("depth") + 1).alias("depth"), *options[:4],
                         (F.max("rank").over(Window.partitionBy("crawl_id")) + 1).alias("next_rank"))


def _seeds(seeds: DataFrame, budget_col: str, default_budget: int, default_depth: int) -> DataFrame:
    budget = F.when(F.col(budget_col) > 0, F.col(budget_col)).otherwise(F.lit(default_budget))
    # not given is 0 below the request layer, which fills in its own default; negative asks for the default
    depth = F.when(F.col("max_depth") < 0, F.lit(default_depth)).otherwise(F.coalesce(F.col("max_depth"), F.lit(0)))
    return seeds.select("crawl_id", "seed_url", U.normalize_url(F.col("seed_url")).alias("url"), F.lit(0).alias("rank"),
                        F.lit(0).alias("depth"), budget.alias(budget_col), depth.alias("max_depth"),
                        F.coalesce(F.col("follow"), F.lit(True)).alias("follow"),
                        (F.col("stop_rank") if "stop_rank" in seeds.columns else F.lit(None)).cast("long").alias("stop_rank"),
                        F.lit(1).alias("next_rank"))


def stop_ranks(crawls: DataFrame, cancellations: DataFrame, page_seconds: float = 1.0) -> DataFrame:
    """``crawls`` (crawl_id, started_at, ...) with ``stop_rank``: the page before which the crawl's first cancellation
    after its start came, at ``page_seconds`` a page; NULL where there is none. A cancellation is dated
    (crawl_id, cancelled_at); the crawl asks before every page whether one has come."""
    dated = crawls.select("crawl_id", "started_at").join(cancellations, "crawl_id").where("cancelled_at >= started_at")
    seconds = F.col("cancelled_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    first = dated.groupBy("crawl_id").agg(F.min(F.ceil(seconds / page_seconds)).cast("long").alias("stop_rank"))
    return crawls.join(first, "crawl_id", "left")


def _bfs(seeds: DataFrame, snapshot: DataFrame, edges: DataFrame | None, active: DataFrame | None,
         budget_col: str, default_budget: int, default_depth: int, map_mode: bool, web: Web | None = None) -> DataFrame:
    if web is None:
        status = cut_lineage(snapshot.select("url", "http_status").repartition("url"))
        edges = edges if edges is not None else cut_lineage(snapshot_edges(snapshot).repartition("src_url"))
    else:
        status = web.answers
    start = cut_lineage(_seeds(seeds, budget_col, default_budget, default_depth))
    frontier = start.where(F.col("url").isNotNull()).drop("seed_url")
    frontiers = [frontier]
    # a seed that does not parse ends its crawl with an error and no page
    bad = start.where(F.col("url").isNull()).select("crawl_id", "rank", F.col("seed_url").alias("url"), "depth",
                                                    F.lit("invalid_url").alias("error"))
    out = [bad if map_mode else bad.withColumns({"ok": F.lit(False), "http_status": F.lit(0)})]
    none = F.lit(None).cast("string").alias("error")
    while True:                                     # each level is one deeper; max_depth ends it
        before_stop = frontier.where(F.col("stop_rank").isNull() | (F.col("rank") < F.col("stop_rank")))
        live = before_stop if active is None else before_stop.join(active.select("crawl_id").distinct(), "crawl_id", "left_semi")
        if map_mode:                                # what was found stays listed when a map is cancelled
            out.append(frontier.select("crawl_id", "rank", "url", "depth", none))
            parents = _fetch(live.where(F.col("depth") < F.col("max_depth")), status).where("ok")
        else:
            # materialised before the next level looks at ``active`` again: pages visited stay visited
            fetched = _fetch(live, status)
            fetched = fetched if active is None else cut_lineage(fetched)
            out.append(fetched.select("crawl_id", "rank", "url", "depth", none, "ok", "http_status"))
            parents = fetched.where(F.col("ok") & (F.col("depth") < F.col("max_depth")) & F.col("follow"))
        # whatever a full crawl still finds ranks behind its budget
        parents = parents.where(F.col("next_rank") < F.col(budget_col))
        onward = edges if web is None else edges_of(parents, web.hrefs)
        frontier = _expand(parents, onward, frontiers, budget_col)
        frontier = cut_lineage(frontier)            # one materialised table per level
        if frontier.isEmpty():
            break
        frontiers.append(frontier)
    res = out[0]
    for v in out[1:]:
        res = res.unionByName(v)
    return res


class Web:
    """What requests get, behind the guard: ``answers`` (url, final_url, http_status, ok, error) of every known URL and
    ``hrefs`` of every page, each written once and partitioned by the key that all levels join on."""

    def __init__(self, snapshot: DataFrame, dns: DataFrame, redirects: DataFrame, *, follow_redirects: bool = True, allow_private: bool = False):
        found = guarded_answers(snapshot, dns, redirects, follow_redirects=follow_redirects, allow_private=allow_private)
        self.answers = cut_lineage(found.select("url", "final_url", "http_status", F.col("error").isNull().alias("ok")).repartition("url"))
        self.hrefs = cut_lineage(snapshot_hrefs(snapshot).repartition("final_url"))


def crawl_guarded(seeds: DataFrame, snapshot: DataFrame, dns: DataFrame, redirects: DataFrame, *, follow_redirects: bool = True,
                  allow_private: bool = False, active: DataFrame | None = None) -> DataFrame:
    """``crawl_bfs`` with every page fetched as a scrape fetches it: scheme, DNS and private-address check of the URL
    and of every redirect, at most four redirects; a page that is refused is visited with status 0."""
    web = Web(snapshot, dns, redirects, follow_redirects=follow_redirects, allow_private=allow_private)
    return _bfs(seeds, snapshot, None, active, "max_pages", CRAWL_DEFAULT_PAGES, CRAWL_DEFAULT_DEPTH, False, web)


def map_guarded(seeds: DataFrame, snapshot: DataFrame, dns: DataFrame, redirects: DataFrame, *, follow_redirects: bool = True,
                allow_private: bool = False, active: DataFrame | None = None) -> DataFrame:
    """``map_bfs`` with the same guard: what a refused page links to is not found."""
    web = Web(snapshot, dns, redirects, follow_redirects=follow_redirects, allow_private=allow_private)
    return _bfs(seeds.withColumn("follow", F.lit(True)), snapshot, None, active, "max_urls", MAP_DEFAULT_URLS, MAP_DEFAULT_DEPTH, True, web)


def crawl_bfs(seeds: DataFrame, snapshot: DataFrame, edges: DataFrame | None = None, *,
              active: DataFrame | None = None) -> DataFrame:
    """Crawl many seeds at once.

    seeds: (crawl_id, seed_url, max_pages, max_depth, follow) -- ``follow`` is whether
    links are followed; the faithful value is "links was among the extract types".
    snapshot: (url, http_status, body) keyed by normalised URL.
    active: optional (crawl_id) of crawls still running; checked before every level.
    A seed column ``stop_rank`` (see ``stop_ranks``) ends a crawl before that page.
    Returns crawl_pages (crawl_id, rank, url, depth, error, ok, http_status), failed pages
    included (they count against max_pages but are not expanded). A seed that does not
    parse gives one row with error ``invalid_url`` and no page.
    """
    return _bfs(seeds, snapshot, edges, active, "max_pages", CRAWL_DEFAULT_PAGES, CRAWL_DEFAULT_DEPTH, False)


def map_bfs(seeds: DataFrame, snapshot: DataFrame, edges: DataFrame | None = None, *,
            active: DataFrame | None = None) -> DataFrame:
    """URL map for many seeds: (crawl_id, rank, url, depth, error) with the seed first.
    A cancelled map keeps what it has found; a seed that does not parse is an error row.
    Items at max_depth are listed but not fetched; failed fetches stay listed;
    the list stops at max_urls (seed included)."""
    return _bfs(seeds.withColumn("follow", F.lit(True)), snapshot, edges, active, "max_urls",
                MAP_DEFAULT_URLS, MAP_DEFAULT_DEPTH, True)


def crawl_contents(crawl_pages: DataFrame, snapshot: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Visited pages with their extracted content (F5 per page of G1): every URL is parsed once, however many crawls
    visit it, and only visited bodies are read. Failed pages have NULL contents."""
    visited = crawl_pages.where(F.col("ok")).select("url").distinct()
    bodies = snapshot.select("url", "body").join(visited, "url", "left_semi")
    parsed = extract_pages(bodies, types, url_col="url", body_col="body", keep=())
    joined = crawl_pages.join(parsed, "url", "left")
    # a page that failed in this crawl shows nothing, also if another crawl has its content
    return joined.select(*crawl_pages.columns, *[F.when(F.col("ok"), F.col(c)).alias(c) for c in parsed.columns if c != "url"])


def crawl_rollup(crawl_pages: DataFrame, page_extract: DataFrame | None = None) -> DataFrame:
    """Per-crawl result (A8): pages_crawled counts failures too, pages_skipped the
    failures, truncated is any page's, http_status the first page's."""
    cp = crawl_pages
    if page_extract is not None and "truncated" in page_extract.columns:
        cp = cp.join(page_extract.select("url", "truncated"), "url", "left")
    else:
        cp = cp.withColumn("truncated", F.lit(False))
    return cp.groupBy("crawl_id").agg(
        F.count_if(F.col("error").isNull()).alias("pages_crawled"),
        F.count_if(~F.col("ok") & F.col("error").isNull()).alias("pages_skipped"),
        F.max("error").alias("error"),
        F.coalesce(F.bool_or(F.col("ok") & F.coalesce(F.col("truncated"), F.lit(False))), F.lit(False))
        .alias("truncated"),
        F.min_by("http_status", "rank").alias("http_status"))


def map_result(map_urls: DataFrame) -> DataFrame:
    """Per-map result: ordered URL list (bounded by max_urls <= 500) and status 200."""
    return map_urls.where(F.col("error").isNull()).groupBy("crawl_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("urls"),
        F.lit(200).alias("http_status"))


def _job_seeds(jobs: DataFrame, budget: str) -> DataFrame:
    links = F.exists(F.coalesce("extract", F.array().cast("array<string>")), lambda x: F.lower(x).isin("links", "all"))
    return jobs.select(F.col("job_id").alias("crawl_id"), F.col("url").alias("seed_url"),
                       F.col("options")[budget].alias(budget), F.col("options")["max_depth"].alias("max_depth"),
                       links.alias("follow"))


def _job_rows(done: DataFrame, jobs: DataFrame, result) -> DataFrame:
    """Job rows from one row per crawl with ``error``: an error fails the job and uses its retry flag."""
    bad = F.col("error").isNotNull()
    msg = F.concat(F.lit(ERROR_MESSAGES["invalid_url"] + ": "), F.coalesce("url", F.lit("")))
    return done.withColumnRenamed("crawl_id", "job_id").join(jobs.select("job_id", "url"), "job_id").select(
        "job_id", F.when(bad, "failed").otherwise("completed").alias("status"), F.col("error").alias("error_type"),
        F.when(bad, msg).alias("error_msg"), F.when(~bad, F.col("http_status")).cast("int").alias("http_status"),
        F.when(bad, 1).otherwise(0).alias("retries_used"), F.when(~bad, result).alias("result"))


def crawl_job_results(jobs: DataFrame, snapshot: DataFrame, edges: DataFrame | None = None, *,
                      active: DataFrame | None = None) -> DataFrame:
    """Crawl jobs (job_id, url, extract, options) to their final row (G1 as a job): the result holds the visited
    pages in order with depth and status, and the roll-up. A job cancelled before its seed was visited has no row."""
    pages = cut_lineage(crawl_bfs(_job_seeds(jobs, "max_pages"), snapshot, edges, active=active))
    listed = pages.where(F.col("error").isNull()).groupBy("crawl_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "url", "depth", "http_status"))),  # max_pages at most
        lambda p: F.struct(p["url"].alias("url"), p["depth"].alias("depth"), p["http_status"].alias("http_status"))).alias("pages"))
    done = crawl_rollup(pages).join(listed, "crawl_id", "left")
    return _job_rows(done, jobs, F.struct("pages", "pages_crawled", "pages_skipped", "truncated", "http_status"))


def map_job_results(jobs: DataFrame, snapshot: DataFrame, edges: DataFrame | None = None, *,
                    active: DataFrame | None = None) -> DataFrame:
    """Map jobs to their final row (G2 as a job): the result is the ordered URL list, status 200."""
    found = cut_lineage(map_bfs(_job_seeds(jobs, "max_urls"), snapshot, edges, active=active))
    errors = found.groupBy("crawl_id").agg(F.max("error").alias("error"))
    done = errors.join(map_result(found), "crawl_id", "left")
    return _job_rows(done, jobs, F.struct("urls", "http_status"))
