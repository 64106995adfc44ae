"""Metric queries over the job log (A2-A11, W1, W6, W9, S11). Floats are rounded
to 6 decimals and times leave as epoch microseconds on both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import jobs as J
from pagefold.functions.ranking import exact_percentiles
from pagefold.operators import metrics as M
from pagefold.plans.catalog import query
from pagefold.plans.job_queries import FOLD_SQL, JOB_LOG_SQL
from pagefold.sources.tables import events

MS_BUCKETS = (1000.0, 2500.0, 5000.0, 10000.0, 25000.0, 50000.0, 100000.0, 250000.0)


def _log(spark, sf):
    return J.job_log_from_events(events(spark, sf))


def _r(c):
    return F.round(c, 6)


_STATUS_SQL = "CASE op WHEN 'create' THEN 'queued' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' END"


@query("metrics_jobs_total", oracle=f"WITH {JOB_LOG_SQL}\n" + f"""
SELECT {_STATUS_SQL} AS status, CAST(count(*) AS BIGINT) AS total FROM l
WHERE op IN ('create', 'complete', 'fail') GROUP BY 1
""")
def q_metrics_jobs_total(spark, sf):
    return M.jobs_total(_log(spark, sf)).select("status", F.col("total").cast("bigint"))


@query("metrics_http_errors", oracle=f"WITH {JOB_LOG_SQL}\n" + """
SELECT error_type, CAST(count(*) AS BIGINT) AS total FROM l WHERE op = 'fail' AND error_type = 'http_failed'
GROUP BY 1
""")
def q_metrics_http_errors(spark, sf):
    return M.http_errors_total(_log(spark, sf)).select("error_type", F.col("total").cast("bigint"))


def _hist_sql(buckets, sfx: str = "") -> str:
    rows = ", ".join(f"('{format(b, 'g')}', {float(b)})" for b in buckets)
    d, bk, h = "d" + sfx, "bk" + sfx, "h" + sfx
    return f"""
{d} AS (SELECT duration_ms FROM l WHERE op = 'complete'),
{bk} AS (SELECT * FROM (VALUES {rows}) t(le, le_value)),
{h} AS (SELECT b.le, b.le_value, (SELECT count(*) FROM {d} WHERE duration_ms <= b.le_value) AS value FROM {bk} b
      UNION ALL SELECT '+Inf', 'inf'::DOUBLE, (SELECT count(*) FROM {d})
      UNION ALL SELECT 'sum', NULL, (SELECT coalesce(sum(duration_ms), 0) FROM {d})
      UNION ALL SELECT 'count', NULL, (SELECT count(*) FROM {d}))"""


@query("metrics_duration_histogram", oracle=f"WITH {JOB_LOG_SQL},{_hist_sql(M.DEFAULT_BUCKETS)}\n" + """
SELECT le, CAST(value AS BIGINT) AS value FROM h
""")
def q_metrics_duration_histogram(spark, sf):
    return M.duration_histogram(_log(spark, sf)).select("le", F.col("value").cast("bigint"))


def _quantile_sql(buckets, name) -> str:
    return _hist_sql(buckets, "_" + name) + f""",
hb_{name} AS (SELECT le_value, value, coalesce(lag(le_value) OVER (ORDER BY le_value), 0) AS prev_le,
                  coalesce(lag(value) OVER (ORDER BY le_value), 0) AS prev_cum
           FROM h_{name} WHERE le_value IS NOT NULL),
t_{name} AS (SELECT max(value) AS total, max(le_value) FILTER (WHERE le_value <> 'inf'::DOUBLE) AS last_finite
             FROM hb_{name}),
x_{name} AS (SELECT q.q, t.total, t.last_finite, arg_min(hb.le_value, hb.le_value) AS le_value,
                    arg_min(hb.prev_le, hb.le_value) AS prev_le, arg_min(hb.prev_cum, hb.le_value) AS prev_cum,
                    arg_min(hb.value, hb.le_value) AS value
             FROM qs q CROSS JOIN t_{name} t JOIN hb_{name} hb ON hb.value >= q.q * t.total
             GROUP BY q.q, t.total, t.last_finite),
r_{name} AS (SELECT q, CASE WHEN total = 0 THEN 'nan'::DOUBLE WHEN le_value = 'inf'::DOUBLE THEN last_finite
                       ELSE prev_le + (le_value - prev_le) * ((q * total - prev_cum) / (value - prev_cum)) END AS v
             FROM x_{name})"""


@query("metrics_quantiles", oracle=f"WITH {JOB_LOG_SQL},\nqs AS (SELECT * FROM (VALUES (0.5), (0.95), (0.99)) t(q)),"
       + _quantile_sql(M.DEFAULT_BUCKETS, "def").lstrip() + ","
       + _quantile_sql(MS_BUCKETS, "ms").lstrip() + """,
ex AS (SELECT unnest([0.5, 0.95, 0.99]) AS q, unnest(quantile_cont(duration_ms, [0.5, 0.95, 0.99])) AS exact_ms
       FROM l WHERE op = 'complete')
SELECT CAST(qs.q AS DOUBLE) AS q, round(a.v, 6) AS histogram_quantile, round(b.v, 6) AS histogram_quantile_ms,
       round(ex.exact_ms, 6) AS exact_ms
FROM qs JOIN r_def a ON a.q = qs.q JOIN r_ms b ON b.q = qs.q JOIN ex ON ex.q = qs.q
""")
def q_metrics_quantiles(spark, sf):
    log = _log(spark, sf)
    a = M.histogram_quantile(M.duration_histogram(log))
    b = M.histogram_quantile(M.duration_histogram(log, MS_BUCKETS)).withColumnRenamed(
        "histogram_quantile", "histogram_quantile_ms")
    done = log.where(F.col("op") == "complete")
    qs = (0.5, 0.95, 0.99)
    exact = dict(zip(qs, exact_percentiles(done, "duration_ms", qs)))
    out = a.join(b, "q").withColumn("exact_ms", F.create_map(*[F.lit(x).cast("double") for kv in exact.items() for x in kv])[F.col("q")])
    return out.select("q", _r(F.col("histogram_quantile")).alias("histogram_quantile"),
                      _r(F.col("histogram_quantile_ms")).alias("histogram_quantile_ms"),
                      _r(F.col("exact_ms")).alias("exact_ms"))


@query("metrics_rate_1m", oracle=f"WITH {JOB_LOG_SQL}\n" + f"""
SELECT CAST(floor(epoch_us(ts) / 60000000) * 60000000 AS BIGINT) AS window_start_us, {_STATUS_SQL} AS status,
       round(count(*) / 60.0, 6) AS rate
FROM l WHERE op IN ('create', 'complete', 'fail') GROUP BY 1, 2
""")
def q_metrics_rate_1m(spark, sf):
    r = M.rate_per_window(_log(spark, sf))
    return r.select(F.unix_micros("w.start").alias("window_start_us"), "status", _r(F.col("rate")).alias("rate"))


_DEPTH_SQL = """,
g AS (SELECT unnest(generate_series(date_trunc('minute', min(ts)), date_trunc('minute', max(ts)), INTERVAL 1 MINUTE))
             AS minute FROM l),
nt AS (SELECT date_trunc('minute', ts) AS minute,
              sum(CASE WHEN op = 'create' THEN 1 WHEN op = 'claim' THEN -1 ELSE 0 END) AS net FROM l GROUP BY 1),
dp AS (SELECT g.minute, sum(coalesce(nt.net, 0)) OVER (ORDER BY g.minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS depth FROM g LEFT JOIN nt ON nt.minute = g.minute)"""


@query("metrics_queue_depth", oracle=f"WITH {JOB_LOG_SQL}{_DEPTH_SQL}\n" + """
SELECT epoch_us(minute) AS minute_us, CAST(depth AS BIGINT) AS depth FROM dp
""")
def q_metrics_queue_depth(spark, sf):
    d = M.queue_depth_per_minute(_log(spark, sf))
    return d.select(F.unix_micros("minute").alias("minute_us"), F.col("depth").cast("bigint"))


@query("queue_alarm", oracle=f"WITH {JOB_LOG_SQL}{_DEPTH_SQL}\n" + f"""
SELECT epoch_us(minute) AS minute_us, CAST(depth AS BIGINT) AS depth,
       count(*) FILTER (WHERE depth > {M.HIGH_THRESHOLD}) OVER (ORDER BY minute ROWS BETWEEN {M.HIGH_PERIODS - 1} PRECEDING AND CURRENT ROW) = {M.HIGH_PERIODS}
         AS alarm_high,
       count(*) FILTER (WHERE depth < {M.LOW_THRESHOLD}) OVER (ORDER BY minute ROWS BETWEEN {M.LOW_PERIODS - 1} PRECEDING AND CURRENT ROW) = {M.LOW_PERIODS}
         AS alarm_low
FROM dp
""")
def q_queue_alarm(spark, sf):
    a = M.queue_alarm(M.queue_depth_per_minute(_log(spark, sf)))
    return a.select(F.unix_micros("minute").alias("minute_us"), F.col("depth").cast("bigint"), "alarm_high",
                    "alarm_low")


@query("error_rate", oracle=f"WITH {JOB_LOG_SQL}\n" + """
SELECT CAST(floor(epoch_us(ts) / 300000000) * 300000000 AS BIGINT) AS window_start_us,
       CAST(count(*) FILTER (WHERE op = 'fail' AND error_type = 'http_failed') AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE op IN ('create', 'complete', 'fail')) AS BIGINT) AS jobs,
       round(CASE WHEN count(*) FILTER (WHERE op IN ('create', 'complete', 'fail')) = 0 THEN NULL ELSE
             100.0 * count(*) FILTER (WHERE op = 'fail' AND error_type = 'http_failed')
             / count(*) FILTER (WHERE op IN ('create', 'complete', 'fail')) END, 6) AS error_pct
FROM l GROUP BY 1
""")
def q_error_rate(spark, sf):
    e = M.error_rate(_log(spark, sf))
    return e.select(F.unix_micros("w.start").alias("window_start_us"), F.col("errors").cast("bigint"),
                    F.col("jobs").cast("bigint"), _r(F.col("error_pct")).alias("error_pct"))


@query("slo_summary", oracle="WITH " + FOLD_SQL + """,
fin AS (SELECT (epoch_us(completed_at) - epoch_us(created_at)) / 1000.0 AS queue_ms, status = 'failed' AS failed
        FROM f WHERE status IN ('completed', 'failed') AND completed_at IS NOT NULL),
sm AS (SELECT count(*) AS finished, quantile_cont(queue_ms, 0.95) AS p95, avg(ceil(queue_ms / 1000.0)) AS polls,
             avg(CAST(failed AS DOUBLE)) AS fr FROM fin)
SELECT CAST(finished AS BIGINT) AS finished, round(p95, 6) AS p95_queue_ms, round(polls, 6) AS mean_polls,
       round(fr, 6) AS failure_rate, (fr < 0.01 AND p95 < 5000) AS pass
FROM sm
""")
def q_slo_summary(spark, sf):
    s = M.slo_summary(J.fold_jobs(_log(spark, sf)))
    return s.select(F.col("finished").cast("bigint"), _r(F.col("p95_queue_ms")).alias("p95_queue_ms"),
                    _r(F.col("mean_polls")).alias("mean_polls"), _r(F.col("failure_rate")).alias("failure_rate"),
                    "pass")


@query("metrics_exposition", oracle=f"WITH {JOB_LOG_SQL},{_hist_sql(M.DEFAULT_BUCKETS)}{_DEPTH_SQL}\n" + f"""
SELECT 'scraper_jobs_total' AS metric, 'status="' || {_STATUS_SQL} || '"' AS labels, CAST(count(*) AS DOUBLE) AS value
FROM l WHERE op IN ('create', 'complete', 'fail') GROUP BY 2
UNION ALL
SELECT 'scraper_http_errors_total', 'error_type="http_failed"', CAST(count(*) AS DOUBLE)
FROM l WHERE op = 'fail' AND error_type = 'http_failed' HAVING count(*) > 0
UNION ALL
SELECT CASE le WHEN 'sum' THEN 'scraper_job_duration_ms_sum' WHEN 'count' THEN 'scraper_job_duration_ms_count'
               ELSE 'scraper_job_duration_ms_bucket' END,
       CASE WHEN le IN ('sum', 'count') THEN 'extract_type="all"' ELSE 'extract_type="all",le="' || le || '"' END,
       CAST(value AS DOUBLE) FROM h
UNION ALL SELECT 'scraper_retries_total', '', 0.0
UNION ALL SELECT 'scraper_queue_depth', '', CAST(arg_max(depth, minute) AS DOUBLE) FROM dp
""")
def q_metrics_exposition(spark, sf):
    return M.exposition(_log(spark, sf))
