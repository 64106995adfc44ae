"""Page snapshot (the network stand-in) and a derived site graph over ``pages``.

The driver pages only link to URLs that are not in the table, so crawls over them
stop after one level. For deep crawls we derive a snapshot whose bodies are the
original HTML plus absolute links to other *real* pages of the same host: pages are
numbered inside (host, block of 1024 consecutive page ids) and page n links to
pages 2n and 2n+1 of its group, back to page 1 of the group, and to one off-host
URL. Numbering groups are at most 1024 rows, so a host holding a third of all
pages never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions import urls as U

BLOCK = 1024        # fixed value: numbering group size (page ids per block)
OFFSITE = "https://offsite.example.net/p/"


def page_snapshot(pages: DataFrame) -> DataFrame:
    """(url, page_id, http_status, body): the fetched form of ``pages``; the key is
    the normalised URL (fragments are never sent to a server). One row per URL:
    the smallest page id wins."""
    s = pages.select(U.normalize_url(F.col("url")).alias("url"), "page_id", F.lit(200).alias("http_status"),
                     F.col("html").alias("body"))
    first = s.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return s.join(first, ["url", "page_id"], "left_semi")


def site_snapshot(pages: DataFrame) -> DataFrame:
    """Snapshot whose bodies carry the derived same-host links (see module doc)."""
    p = pages.select("page_id", "url", "html",
                     U.normalize_url(F.col("url")).alias("nurl"),
                     F.lower(U.hostname(F.col("url"))).alias("host"),
                     F.floor(F.col("page_id") / BLOCK).cast("bigint").alias("blk"))
    w = Window.partitionBy("host", "blk").orderBy("page_id")
    n = p.withColumn("n", F.row_number().over(w))
    node = n.select("host", "blk", "n", "nurl")
    kids = n.select("page_id", "host", "blk", "n",
                    F.explode(F.array(
                        F.struct(F.lit(0).alias("k"), (F.col("n") * 2).alias("tn")),
                        F.struct(F.lit(1).alias("k"), (F.col("n") * 2 + 1).alias("tn")),
                        F.struct(F.lit(2).alias("k"), F.lit(1).alias("tn")))).alias("t"))
    kids = kids.where((F.col("t.k") < 2) | (F.col("n") > 1))
    tgt = kids.alias("a").join(
        node.select("host", "blk", F.col("n").alias("tn"), F.col("nurl").alias("target")).alias("b"),
        (F.col("a.host") == F.col("b.host")) & (F.col("a.blk") == F.col("b.blk")) & (F.col("a.t.tn") == F.col("b.tn")))
    anchors = tgt.groupBy(F.col("a.page_id").alias("page_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("a.t.k").alias("k"),
                                                                       F.col("b.target").alias("u")))),
                                 lambda x: F.concat(F.lit('<a href="'), F.replace(x["u"], F.lit("&"), F.lit("&amp;")),
                                                    F.lit('">n</a>'))), "").alias("anchors"))
    body = F.concat(F.col("html"), F.coalesce(F.col("anchors"), F.lit("")),
                    F.lit('<a href="' + OFFSITE), F.col("page_id").cast("string"), F.lit('">off</a>'))
    out = p.join(anchors, "page_id", "left").select(F.col("nurl").alias("url"), "page_id",
                                                     F.lit(200).alias("http_status"), body.alias("body"))
    first = out.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return out.join(first, ["url", "page_id"], "left_semi")
