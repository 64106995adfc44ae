"""Link tables derived from the extraction pass: exploded links, same-host edges,
first-seen normalised URLs and per-host counts.

All of it is narrow (no shuffle) except the explicit aggregations, which Spark
plans as partial (map-side) + final aggregates keyed by host or URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions import urls as U
from pagefold.operators.extract import extract_pages


def page_links_full(pages: DataFrame, *, url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, pos, link): every ``a[href]`` in document order, resolved against
    the page URL, duplicates kept, unparsable hrefs dropped (pos counts kept links).
    One narrow pass of Column expressions: cut, resolve, explode; no shuffle."""
    ext = extract_pages(pages, ["links"], url_col=url_col, body_col=body_col, keep=("page_id",))
    return exploded(ext, "links", "link", "page_id", F.col(url_col).alias("url"))


def exploded(df: DataFrame, array: str, value: str, *kept) -> DataFrame:
    """``kept`` columns with (pos, value) per element. A plain explode makes the optimiser filter on the array's size
    below the projection that computes it, so every page would be cut up twice; this one computes it once."""
    return df.select(*kept, F.posexplode_outer(array).alias("pos", value)).where(F.col("pos").isNotNull())


def page_links(pages: DataFrame, **kw) -> DataFrame:
    return page_links_full(pages, **kw).drop("url")


def page_texts(pages: DataFrame, kind: str, *, body_col: str = "html") -> DataFrame:
    """(page_id, pos, text) for ``headers`` or ``paragraphs``."""
    ext = extract_pages(pages, [kind], body_col=body_col, keep=("page_id",), resolve=False)
    return exploded(ext, kind, "text", "page_id")


def edges(pages: DataFrame, *, same_host_only: bool = True) -> DataFrame:
    """Edge table (src_page_id, src_url, pos, dst_url, src_host, dst_host): links
    normalised (fragment dropped) and, by default, kept only when the hostname equals
    the source page's (case-insensitive; scheme and port ignored; ``mailto:`` and
    ``javascript:`` have no host). Narrow: no join back to the page table."""
    ext = extract_pages(pages, ["links"], keep=("page_id",), resolve=False)
    # one resolve per link (normalised form + host); the source host once per page
    ext = ext.select("page_id", F.col("url").alias("src_url"), F.lower(U.hostname(F.col("url"))).alias("src_host"),
                     U.resolve_urls(F.col("url"), F.col("links"), keep_fragment=False, with_host=True).alias("l"))
    out = exploded(ext, "l", "d", F.col("page_id").alias("src_page_id"), "src_url", "src_host") \
        .select("src_page_id", "src_url", "pos", F.col("d.url").alias("dst_url"), "src_host",
                F.col("d.host").alias("dst_host"))
    if same_host_only:
        out = out.where((F.col("src_host") == F.col("dst_host")) & (F.col("dst_host") != ""))
    return out
