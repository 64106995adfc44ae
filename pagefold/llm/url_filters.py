"""URL filters as of the fetch: a temporal list join in DataFrame functions only.

A list is a log of dated entries (list, verdict, kind, pattern, action, dated): on that
instant the pattern is added to the list or removed from it. Entries of one pattern become
validity intervals [added, next entry), and a capture is judged by the entries that were
active when it was fetched, not by today's lists.

Kinds of patterns: ``host`` (the exact host), ``domain`` (the host or any host below it),
``path`` (host and leading path, up to a slash or the end), ``word`` (a run of a-z and 0-9
in host or path). A capture is blocked when an entry of verdict ``block`` is active for it
and none of verdict ``allow``.

Plan: the distinct (url, time) pairs are exploded into their keys and equi-joined with the
intervals on (kind, pattern), the time range as a further condition. A host that a third of
all captures share meets its few intervals only, so its rows may be split freely by adaptive
execution; no window or group is keyed by a capture's host. Verdicts are summed up per pair
with partial aggregates.

Defined results: a null or unparsable url has no keys and is not blocked; a null time meets no
interval; entries with a null in list, kind, pattern, action or time are ignored; at one
instant a removal wins over an addition of the same pattern; repeated entries change nothing;
repeated captures are judged alike; no entries block nothing; all columns of the captures stay,
but for ones named like the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW = ("blocked", "n_active", "active_lists")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """Array of (kind, pattern) under which an entry may name this URL."""
    host, path = host_of(url), path_of(url)
    key = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern"))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)),
                           lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    words = F.filter(F.split(F.concat(host, F.lit("/"), F.lower(path)), "[^a-z0-9]+"), lambda x: x != "")
    keys = F.concat(F.array(key("host", host)), F.transform(domains, lambda x: key("domain", x)),
                    F.transform(prefixes, lambda x: key("path", x)), F.transform(words, lambda x: key("word", x)))
    return F.when(host.isNotNull(), F.array_distinct(keys))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, pattern, valid_from, valid_to): valid_to is null while the entry stands."""
    key = ("list", "verdict", "kind", "pattern")
    log = (entries.where("list IS NOT NULL AND kind IS NOT NULL AND pattern IS NOT NULL AND dated IS NOT NULL "
                         "AND action IN ('add', 'remove')")
           .groupBy(*key, "dated").agg(F.max(F.col("action") == "remove").alias("removed")))
    # one row per pattern and instant: as many as its list was edited, whatever the captures
    until = F.lead("dated").over(Window.partitionBy(*key).orderBy("dated"))
    return (log.withColumn("valid_to", until).where("NOT removed")
            .select(*key, F.col("dated").alias("valid_from"), "valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked``, ``n_active`` (list entries active for the URL at the fetch) and
    ``active_lists`` (their lists, sorted, comma-joined)."""
    captures = captures.drop(*NEW)
    pairs = captures.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_at")).distinct()
    keyed = (pairs.where("_at IS NOT NULL").select("_url", "_at", F.explode(url_keys(F.col("_url"))).alias("_k"))
             .select("_url", "_at", F.col("_k.kind").alias("kind"), F.col("_k.pattern").alias("pattern")))
    spans = validity_intervals(entries)
    met = keyed.join(spans, (keyed.kind == spans.kind) & (keyed.pattern == spans.pattern)
                     & (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    verdict = met.groupBy("_url", "_at").agg(
        F.max(F.col("verdict") == "block").alias("_block"), F.max(F.col("verdict") == "allow").alias("_allow"),
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("active_lists"))
    out = captures.join(verdict, captures[url_col].eqNullSafe(verdict["_url"]) & captures[time_col].eqNullSafe(verdict["_at"]), "left")
    return out.select(*[captures[c] for c in captures.columns],
                      (F.coalesce("_block", F.lit(False)) & ~F.coalesce("_allow", F.lit(False))).alias("blocked"),
                      F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
                      F.coalesce("active_lists", F.lit("")).alias("active_lists"))
