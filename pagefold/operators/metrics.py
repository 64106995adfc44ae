"""Metric families as aggregates over the job log.

Counters become grouped counts, rates become counts per event-time window divided
by the window length, the queue-depth gauge becomes a running sum over a per-minute
grid, and the histogram becomes one pass of conditional sums (one per bucket bound).
Every aggregate here is partial + final (map-side combine), keyed by window or
label; the only un-keyed windows run over per-minute rows or bucket rows, whose
count grows with the time span or the bucket list, never with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.ranking import exact_percentiles

# ---- fixed values: default histogram buckets (seconds scale, used for millisecond values) --
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
HIGH_THRESHOLD, HIGH_PERIODS = 10, 2
LOW_THRESHOLD, LOW_PERIODS = 5, 5
SLO_P95_MS, SLO_MAX_FAILURE_RATE = 5000, 0.01
STATUS_OF_OP = {"create": "queued", "complete": "completed", "fail": "failed"}
# ---------------------------------------------------------------------------------------------


def _status_of_op() -> Column:
    return F.create_map(*[x for kv in STATUS_OF_OP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("op")]


def jobs_total(log: DataFrame) -> DataFrame:
    """scraper_jobs_total{status}: queued on accept, completed / failed on result."""
    return log.select(_status_of_op().alias("status")).where(F.col("status").isNotNull()) \
        .groupBy("status").agg(F.count(F.lit(1)).alias("total"))


def http_errors_total(log: DataFrame) -> DataFrame:
    """scraper_http_errors_total{error_type}: only http_failed is ever counted."""
    return log.where((F.col("op") == "fail") & (F.col("error_type") == "http_failed")) \
        .groupBy("error_type").agg(F.count(F.lit(1)).alias("total"))


def duration_histogram(log: DataFrame, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """scraper_job_duration_ms: cumulative ``le`` buckets (+Inf last), sum and count,
    observed for completed jobs. Returns (le, le_value, cum_count) plus sum/count rows
    as le 'sum'/'count'."""
    d = log.where(F.col("op") == "complete").select("duration_ms")
    aggs = [F.count_if(F.col("duration_ms") <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(F.lit(1)).alias("binf"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("dsum")]
    row = d.agg(*aggs)
    pairs = [F.struct(F.lit(_fmt(b)).alias("le"), F.lit(float(b)).alias("le_value"),
                      F.col(f"b{i}").cast("bigint").alias("value")) for i, b in enumerate(buckets)]
    pairs += [F.struct(F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("le_value"),
                       F.col("binf").cast("bigint").alias("value")),
              F.struct(F.lit("sum").alias("le"), F.lit(None).cast("double").alias("le_value"),
                       F.col("dsum").cast("bigint").alias("value")),
              F.struct(F.lit("count").alias("le"), F.lit(None).cast("double").alias("le_value"),
                       F.col("binf").cast("bigint").alias("value"))]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def _fmt(b: float) -> str:
    return format(b, "g")


def histogram_quantile(hist: DataFrame, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Quantile from cumulative buckets with linear interpolation inside the bucket;
    a rank in the +Inf bucket returns the last finite bound; no data gives NaN."""
    b = hist.where(F.col("le_value").isNotNull())
    w = Window.orderBy("le_value")   # bucket rows only: a dozen rows
    b = b.withColumn("prev_le", F.coalesce(F.lag("le_value").over(w), F.lit(0.0))) \
        .withColumn("prev_cum", F.coalesce(F.lag("value").over(w), F.lit(0))) \
        .withColumn("last_finite", F.max(F.when(F.col("le_value") != float("inf"), F.col("le_value"))).over(
            Window.partitionBy(F.lit(1))))
    total = b.agg(F.max("value").alias("total"))
    qdf = hist.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    x = qdf.crossJoin(total).crossJoin(b)   # |q| x 1 x |buckets| rows
    x = x.withColumn("rank", F.col("q") * F.col("total")).where(F.col("value") >= F.col("rank"))
    first = x.groupBy("q", "total").agg(F.min_by(F.struct("le_value", "prev_le", "prev_cum", "value",
                                                          "last_finite", "rank"), "le_value").alias("b"))
    bb = F.col("b")
    interp = bb["prev_le"] + (bb["le_value"] - bb["prev_le"]) * \
        ((bb["rank"] - bb["prev_cum"]) / (bb["value"] - bb["prev_cum"]))
    val = F.when(F.col("total") == 0, F.lit(float("nan"))).when(
        bb["le_value"] == float("inf"), bb["last_finite"]).otherwise(interp)
    return first.select("q", val.alias("histogram_quantile"))


def rate_per_window(log: DataFrame, window: str = "1 minute", slide: str | None = None,
                    seconds: float = 60.0) -> DataFrame:
    """rate(scraper_jobs_total[1m]) per status: increase per window / window seconds."""
    s = log.select("ts", _status_of_op().alias("status")).where(F.col("status").isNotNull())
    win = F.window("ts", window, slide) if slide else F.window("ts", window)
    return s.groupBy(win.alias("w"), "status").agg((F.count(F.lit(1)) / F.lit(seconds)).alias("rate"))


def minute_grid(log: DataFrame) -> DataFrame:
    """Every minute from the first to the last event (a gauge is sampled each minute
    whether or not anything happened)."""
    b = log.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return b.select(F.explode(F.sequence(F.date_trunc("minute", "lo"), F.date_trunc("minute", "hi"),
                                         F.expr("INTERVAL 1 MINUTE"))).alias("minute"))


def queue_depth_per_minute(log: DataFrame) -> DataFrame:
    """scraper_queue_depth sampled at each minute end (W9, A7): pushes (accepted jobs)
    minus pops (claim attempts), summed over the minute grid.

    The prefix sum is two-level so no window sees more than one day of minutes:
    running sums inside each day, plus the total of all earlier days (a window over
    the per-day table, one row per day)."""
    d = log.select(F.date_trunc("minute", "ts").alias("minute"),
                   F.when(F.col("op") == "create", 1).when(F.col("op") == "claim", -1).otherwise(0).alias("d"))
    net = d.groupBy("minute").agg(F.sum("d").alias("net"))
    g = minute_grid(log).join(net, "minute", "left").fillna(0, ["net"]) \
        .withColumn("day", F.date_trunc("day", "minute"))
    in_day = g.withColumn("cum", F.sum("net").over(
        Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)))
    days = g.groupBy("day").agg(F.sum("net").alias("day_net"))
    days = days.withColumn("before", F.coalesce(F.sum("day_net").over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return in_day.join(days.select("day", "before"), "day").select(
        "minute", (F.col("cum") + F.col("before")).alias("depth"))


def queue_alarm(depth: DataFrame, high=HIGH_THRESHOLD, high_periods=HIGH_PERIODS,
                low=LOW_THRESHOLD, low_periods=LOW_PERIODS) -> DataFrame:
    """Scale-out / scale-in alarms: Maximum per 60 s period; high when > high for the
    last ``high_periods`` periods, low when < low for the last ``low_periods``.
    A period with too little history does not alarm. The look-back is an equi-join
    of each minute with its previous minutes (keyed, no global ordering)."""
    n = max(high_periods, low_periods)
    back = depth.select(F.col("minute").alias("at"),
                        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    back = back.withColumn("minute", F.col("at") - F.make_dt_interval(mins=F.col("i")))
    j = back.join(depth, "minute")
    g = j.groupBy("at").agg(
        F.count_if((F.col("i") < high_periods) & (F.col("depth") > high)).alias("n_high"),
        F.count_if(F.col("i") < high_periods).alias("h_hist"),
        F.count_if((F.col("i") < low_periods) & (F.col("depth") < low)).alias("n_low"),
        F.count_if(F.col("i") < low_periods).alias("l_hist"),
        F.max_by("depth", F.when(F.col("i") == 0, F.lit(1))).alias("depth"))
    return g.select(F.col("at").alias("minute"), "depth",
                    ((F.col("n_high") == high_periods) & (F.col("h_hist") == high_periods)).alias("alarm_high"),
                    ((F.col("n_low") == low_periods) & (F.col("l_hist") == low_periods)).alias("alarm_low"))


def error_rate(log: DataFrame, window: str = "5 minutes") -> DataFrame:
    """100 * http errors / job transitions per window (NULL when no transitions)."""
    s = log.select("ts", _status_of_op().alias("status"),
                   ((F.col("op") == "fail") & (F.col("error_type") == "http_failed")).alias("is_err"))
    g = s.groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if(F.col("is_err")).alias("errors"), F.count(F.col("status")).alias("jobs"))
    return g.select("w", "errors", "jobs", (F.try_divide(F.col("errors") * 100.0, F.col("jobs"))).alias("error_pct"))


def slo_summary(jobs: DataFrame) -> DataFrame:
    """Load-run verdict over finished jobs: p95 queue time (submit -> finish, ms),
    mean polls (one per second), failure rate, and pass/fail against thresholds."""
    fin = jobs.where(F.col("status").isin("completed", "failed") & F.col("completed_at").isNotNull())
    qt = (F.unix_micros("completed_at") - F.unix_micros("created_at")) / 1000.0
    fin = fin.select(qt.alias("queue_ms"), (F.col("status") == "failed").alias("failed"))
    p95 = exact_percentiles(fin, "queue_ms", (0.95,))[0]
    s = fin.agg(F.count(F.lit(1)).alias("finished"), F.lit(p95).cast("double").alias("p95_queue_ms"),
                F.avg(F.ceil(F.col("queue_ms") / 1000.0)).alias("mean_polls"),
                F.avg(F.col("failed").cast("double")).alias("failure_rate"))
    return s.withColumn("pass", (F.col("failure_rate") < SLO_MAX_FAILURE_RATE) &
                        (F.col("p95_queue_ms") < SLO_P95_MS))


def exposition(log: DataFrame, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """The metric families as one table (metric, labels, value), like a scrape of
    the metrics endpoint. Labels are rendered ``k="v"``."""
    jt = jobs_total(log).select(F.lit("scraper_jobs_total").alias("metric"),
                                F.concat(F.lit('status="'), "status", F.lit('"')).alias("labels"),
                                F.col("total").cast("double").alias("value"))
    he = http_errors_total(log).select(F.lit("scraper_http_errors_total").alias("metric"),
                                       F.concat(F.lit('error_type="'), "error_type", F.lit('"')).alias("labels"),
                                       F.col("total").cast("double").alias("value"))
    h = duration_histogram(log, buckets)
    hb = h.select(
        F.when(F.col("le") == "sum", F.lit("scraper_job_duration_ms_sum"))
         .when(F.col("le") == "count", F.lit("scraper_job_duration_ms_count"))
         .otherwise(F.lit("scraper_job_duration_ms_bucket")).alias("metric"),
        F.when(F.col("le").isin("sum", "count"), F.lit('extract_type="all"'))
         .otherwise(F.concat(F.lit('extract_type="all",le="'), "le", F.lit('"'))).alias("labels"),
        F.col("value").cast("double").alias("value"))
    rt = log.sparkSession.range(1).select(F.lit("scraper_retries_total").alias("metric"), F.lit("").alias("labels"),
                                          F.lit(0.0).alias("value"))
    qd = queue_depth_per_minute(log).agg(F.max_by("depth", "minute").alias("v")).select(
        F.lit("scraper_queue_depth").alias("metric"), F.lit("").alias("labels"), F.col("v").cast("double").alias("value"))
    return jt.unionByName(he).unionByName(hb).unionByName(rt).unionByName(qd)


def retries_total(attempts: DataFrame) -> DataFrame:
    """scraper_retries_total as its help text means it (A5): attempts beyond the first,
    summed over jobs (the reference declares the counter but never increments it, so
    ``declared_total`` is 0). ``attempts`` has one row per job with ``attempts_used``."""
    return attempts.agg(F.lit(0).cast("bigint").alias("declared_total"),
                        F.coalesce(F.sum(F.greatest(F.col("attempts_used") - 1, F.lit(0))), F.lit(0))
                        .cast("bigint").alias("derived_total"))
