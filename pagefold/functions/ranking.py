"""Global ordering helpers that never funnel the data through one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.session import cut_lineage


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "rn", partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``order_cols`` order (the order must be
    total, e.g. end with a unique id).

    Two levels: a range partitioning deals the data out in order, once (it is written to
    the checkpoint folder); each task numbers its own rows; a table with one row per partition (broadcast: its size is the
    partition count) gives every partition its offset."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    # both uses below must see the same range bounds, which are sampled anew each time the plan runs
    r = cut_lineage(df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()))
    local = r.withColumn("_lrn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn("_off", F.coalesce(
        F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(offs.select("_pid", "_off")), "_pid") \
        .withColumn(out, (F.col("_off") + F.col("_lrn")).cast("bigint")).drop("_pid", "_lrn", "_off")


def carry(df: DataFrame, key: str, order_cols: list[str], chunk: str, items: dict[str, tuple], *,
          include_current: bool = True) -> DataFrame:
    """Running last or first non-NULL values per ``key`` in ``order_cols`` order: ``items`` maps an output column to
    (value, "last" or "first"). Computed in two levels, so a key holding a third of all rows is still spread over
    tasks: inside each (key, chunk) a window; across the chunk rows of a key (one row per chunk) the values carried in
    from earlier chunks; then one join, whatever the number of items.
    ``chunk`` must be monotone in the order (e.g. a time bucket of the first order column)."""
    frame_end = 0 if include_current else -1
    w = Window.partitionBy(key, chunk).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, frame_end)
    fn = {"last": F.last, "first": F.first}
    x = df.withColumns({f"_v_{o}": v for o, (v, _) in items.items()})
    o_ = F.struct(*order_cols)
    pick = {"last": F.max_by, "first": F.min_by}
    per = x.groupBy(key, chunk).agg(*[
        pick[how](f"_v_{o}", F.when(F.col(f"_v_{o}").isNotNull(), o_)).alias(f"_c_{o}") for o, (_, how) in items.items()])
    wc = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, chunk, *[fn[how](f"_c_{o}", True).over(wc).alias(f"_c_{o}") for o, (_, how) in items.items()])
    y = x.withColumns({f"_l_{o}": fn[how](f"_v_{o}", True).over(w) for o, (_, how) in items.items()}).join(per, [key, chunk], "left")
    out = {o: F.coalesce(f"_l_{o}", f"_c_{o}") if how == "last" else F.coalesce(f"_c_{o}", f"_l_{o}") for o, (_, how) in items.items()}
    return y.withColumns(out).drop(*[f"_{k}_{o}" for o in items for k in "vlc"])


def row_number_in_key(df: DataFrame, key: str, order_cols: list[str], chunk: str, out: str = "rn") -> DataFrame:
    """1-based number of every row of a ``key`` in ``order_cols`` order, in two levels like ``carry``: rows are
    numbered inside (key, chunk), and a prefix sum over the key's chunks, one row each, gives the offset."""
    local = df.withColumn("_lrn", F.row_number().over(Window.partitionBy(key, chunk).orderBy(*order_cols)))
    per = df.groupBy(key, chunk).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(key, chunk, F.coalesce(before, F.lit(0)).alias("_off"))
    return local.join(per, [key, chunk]).withColumn(out, F.col("_lrn") + F.col("_off")).drop("_lrn", "_off")


def exact_percentiles(df: DataFrame, col: str, qs: tuple[float, ...]) -> list[float | None]:
    """Exact percentiles (interpolated between neighbouring ranks) of a column, nulls left out; None without rows.

    Counts per distinct value are range-partitioned once and summed up in two levels, inside a partition and over
    one row per partition; the ranks wanted are then picked by a one-row aggregate. No task holds all values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = df.sparkSession.sparkContext.defaultParallelism
    r = cut_lineage(counts.repartitionByRange(n, "v").withColumn("_pid", F.spark_partition_id()))
    parts = r.groupBy("_pid").agg(F.sum("n").alias("c"))
    offs = parts.select("_pid", F.coalesce(F.sum("c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    total = parts.agg(F.sum("c")).first()[0]
    if not total:
        return [None] * len(qs)
    upto = F.col("off") + F.sum("n").over(Window.partitionBy("_pid").orderBy("v"))
    x = r.join(F.broadcast(offs), "_pid").withColumn("hi", upto)  # as many rows as partitions are broadcast
    at = lambda k: F.max(F.when((F.col("hi") > k) & (F.col("hi") - F.col("n") <= k), F.col("v")))
    ranks = [q * (total - 1) for q in qs]
    row = x.agg(*[at(f(p)).alias(f"{name}{i}") for i, p in enumerate(ranks) for name, f in (("lo", math.floor), ("hi", math.ceil))]).first()
    return [float(row[f"lo{i}"]) + (p - math.floor(p)) * (float(row[f"hi{i}"]) - float(row[f"lo{i}"])) for i, p in enumerate(ranks)]
