"""Request validation, defaults and option resolution as Column expressions
(P1-P6, P12, F1-F4). One ``reject_reason`` column replaces early returns: the
first failing check in the reference's order wins, NULL means accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.urls import is_valid_api_url

# ---- fixed values: accepted extract types, messages, option bounds and defaults ----------
VALID_EXTRACT = ("links", "headers", "paragraphs", "markdown", "html", "raw_html")
EXTRACT_TYPES_MSG = "links, headers, paragraphs, markdown, html, raw_html"
MSG_BAD_BODY = "invalid request body"
MSG_BAD_URL = "url must be a valid http:// or https:// URL"
OPTION_BOUNDS = (  # checked in this order
    ("timeout_seconds", 1, 60, "timeout_seconds must be between 1 and 60"),
    ("max_retries", 0, 5, "max_retries must be between 0 and 5"),
    ("max_pages", 1, 100, "max_pages must be between 1 and 100"),
    ("max_depth", 0, 5, "max_depth must be between 0 and 5"),
    ("max_urls", 1, 500, "max_urls must be between 1 and 500"),
)
DEFAULT_EXTRACT = {"scrape": "links", "crawl": "markdown", "map": "links"}
CRAWL_DEFAULT_PAGES, CRAWL_DEFAULT_DEPTH = 10, 2
MAP_DEFAULT_URLS, MAP_DEFAULT_DEPTH = 50, 2
WORKER_DEFAULT_TIMEOUT_S, WORKER_DEFAULT_RETRIES = 10, 3
WORKER_DEFAULT_FOLLOW, WORKER_DEFAULT_MAX_BODY = True, 5 * 1024 * 1024
JOB_STATUSES = ("queued", "processing", "completed", "failed")
UUID_RE = (r"^(?:urn:uuid:)?(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
           r"|\{[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\}"
           r"|[0-9A-Fa-f]{32})$")
# -------------------------------------------------------------------------------------------


def go_quote(c: Column) -> Column:
    """Double-quoted string with backslash and quote escaped (the ``%q`` form for
    printable text)."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                    F.lit('"'))


def first_bad_extract(extract: Column) -> Column:
    """First element whose lower-case form is not a valid type (``all`` included)."""
    return F.try_element_at(F.filter(F.coalesce(extract, F.array().cast("array<string>")),
                                 lambda t: ~F.lower(t).isin(*VALID_EXTRACT)), F.lit(1))


def extract_reason(extract: Column) -> Column:
    bad = first_bad_extract(extract)
    return F.when(bad.isNotNull(), F.concat(F.lit("invalid extract type "), go_quote(bad),
                                            F.lit(": must be one of " + EXTRACT_TYPES_MSG)))


def options_reason(options: Column) -> Column:
    """First out-of-range option in the fixed order; NULL options pass."""
    checks = [F.when(~options[name].between(lo, hi), F.lit(msg)) for name, lo, hi, msg in OPTION_BOUNDS]
    return F.coalesce(*checks)


def reject_reason(kind: Column, bind_ok: Column, url: Column, extract: Column, options: Column) -> Column:
    """Router: binding -> url -> extract (not for map) -> options."""
    return F.when(~bind_ok, F.lit(MSG_BAD_BODY)) \
        .when(~is_valid_api_url(url), F.lit(MSG_BAD_URL)) \
        .when((kind != "map") & extract_reason(extract).isNotNull(), extract_reason(extract)) \
        .otherwise(options_reason(options))


def validate(requests: DataFrame) -> DataFrame:
    """Add ``reject_reason`` and ``accepted`` to a parsed request table with columns
    kind, bind_ok, url, extract, options."""
    out = requests.withColumn("reject_reason", reject_reason(
        F.col("kind"), F.col("bind_ok"), F.col("url"), F.col("extract"), F.col("options")))
    return out.withColumn("accepted", F.col("reject_reason").isNull())


def with_defaults(accepted: DataFrame) -> DataFrame:
    """Apply the API defaults per kind (F1): extract and crawl/map budgets."""
    kind, opts = F.col("kind"), F.col("options")
    empty = F.coalesce(F.size("extract"), F.lit(0)) <= 0
    extract = F.when(kind == "map", F.array(F.lit("links"))).when(
        empty, F.array(F.when(kind == "crawl", F.lit("markdown")).otherwise(F.lit("links")))
    ).otherwise(F.col("extract"))

    def opt(name, default_crawl=None, default_map=None):
        c = opts[name]
        if default_crawl is not None:
            c = F.when(kind == "crawl", F.coalesce(c, F.lit(default_crawl))).otherwise(c)
        if default_map is not None:
            c = F.when(kind == "map", F.coalesce(opts[name], F.lit(default_map))).otherwise(c)
        return c.alias(name)

    options = F.struct(
        opt("timeout_seconds"), opt("max_retries"), opt("follow_redirects"),
        opt("max_pages", CRAWL_DEFAULT_PAGES), opt("max_depth", CRAWL_DEFAULT_DEPTH, MAP_DEFAULT_DEPTH),
        opt("max_urls", None, MAP_DEFAULT_URLS), opt("render_js"))
    return accepted.withColumn("extract", extract).withColumn("options", options)


def effective_options(options: Column) -> Column:
    """Worker view of a job's options (F2): job value else worker default."""
    return F.struct(
        F.coalesce(options["timeout_seconds"], F.lit(WORKER_DEFAULT_TIMEOUT_S)).alias("timeout_seconds"),
        F.coalesce(options["max_retries"], F.lit(WORKER_DEFAULT_RETRIES)).alias("max_retries"),
        F.coalesce(options["follow_redirects"], F.lit(WORKER_DEFAULT_FOLLOW)).alias("follow_redirects"),
        F.coalesce(options["render_js"], F.lit(False)).alias("render_js"),
        F.lit(WORKER_DEFAULT_MAX_BODY).cast("bigint").alias("max_body_bytes"))


def extract_set_col(extract: Column) -> Column:
    """Scrape-time extract set (F4): lower-cased, de-duplicated; empty -> [links]."""
    s = F.array_distinct(F.transform(F.coalesce(extract, F.array().cast("array<string>")), F.lower))
    return F.when(F.size(s) == 0, F.array(F.lit("links"))).otherwise(s)


def is_valid_job_id(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID_RE), F.lit(False))


def deterministic_uuid(*parts: Column) -> Column:
    """A UUID-shaped id from a hash of the request key: stable across task retries,
    unlike ``uuid()``."""
    h = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)),
                       F.substr(h, F.lit(13), F.lit(4)), F.substr(h, F.lit(17), F.lit(4)),
                       F.substr(h, F.lit(21), F.lit(12)))
