"""Streaming operators run by replay (T1-T3, T6, T7): every query deals a whole table into slices, streams them through
the operator with a restart between slices, and returns what its sink holds in the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import jobs as J
from pagefold.plans.catalog import query
from pagefold.plans.job_queries import FOLD_SQL, JOB_LOG_SQL, _us
from pagefold.plans.metric_queries import _STATUS_SQL
from pagefold.plans.network_queries import _SCRAPE_CTES
from pagefold.plans.request_queries import VALIDATION_ORACLE
from pagefold.sources.network import dns_snapshot, redirect_table
from pagefold.sources.requests import derived_request_bodies
from pagefold.sources.sitegraph import page_snapshot
from pagefold.sources.tables import events, pages
from pagefold.streaming import pipelines as P
from pagefold.streaming.replay import BATCH, latest, replay, written


def _log(spark, sf):
    log = J.job_log_from_events(events(spark, sf)).where("job_id IS NOT NULL")
    return log.select(*[f.name for f in P.JOB_LOG_SCHEMA.fields])


@query("stream_job_state", oracle="WITH " + FOLD_SQL + """
SELECT CAST(job_id AS BIGINT) AS job_id, status, error_msg, CAST(http_status AS BIGINT) AS http_status,
       duration_ms, CAST(retries_used AS BIGINT) AS retries_used, epoch_us(created_at) AS created_at_us,
       epoch_us(updated_at) AS updated_at_us, epoch_us(completed_at) AS completed_at_us,
       CAST(n_events AS BIGINT) AS n_events
FROM f
""")
def q_stream_job_state(spark, sf):
    """The job state machine (T3), its events dealt by id: many come before their job's creation."""
    out = replay(_log(spark, sf), F.pmod(F.hash("event_id"), F.lit(1000)), P.job_state_stream, mode="update")
    f = latest(written(spark, out), "job_id")
    return f.select(F.col("job_id").cast("bigint").alias("job_id"), "status", "error_msg",
                    F.col("http_status").cast("bigint").alias("http_status"), "duration_ms",
                    F.col("retries_used").cast("bigint").alias("retries_used"), _us("created_at"), _us("updated_at"), _us("completed_at"),
                    F.col("n_events").cast("bigint").alias("n_events"))


@query("stream_jobs_total", oracle=f"WITH {JOB_LOG_SQL}\n" + f"""
SELECT CAST(floor(epoch_us(ts) / 60000000) * 60000000 AS BIGINT) AS window_start_us, {_STATUS_SQL} AS status,
       CAST(count(*) AS BIGINT) AS total, round(count(*) / 60.0, 6) AS rate
FROM l WHERE job_id IS NOT NULL AND op IN ('create', 'complete', 'fail') GROUP BY 1, 2
""")
def q_stream_jobs_total(spark, sf):
    """Counter increments per minute (T6), in event-time order."""
    out = replay(_log(spark, sf), F.unix_micros("ts"), P.jobs_total_stream, mode="update")
    r = latest(written(spark, out).select(F.unix_micros("w.start").alias("window_start_us"), "status", "total", "rate", BATCH), "window_start_us", "status")
    return r.select("window_start_us", "status", F.col("total").cast("bigint").alias("total"), F.round("rate", 6).alias("rate"))


@query("stream_delivery_dedupe", oracle="WITH " + JOB_LOG_SQL + """
SELECT CAST(job_id AS BIGINT) AS job_id, CAST(1 AS BIGINT) AS claims FROM l WHERE op = 'create'
""")
def q_stream_delivery_dedupe(spark, sf):
    """Deliveries (T7): every third job is delivered again five minutes later, and claimed once."""
    made = _log(spark, sf).where("op = 'create'").select("job_id", "ts")
    again = made.where("job_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    out = replay(made.unionByName(again), F.unix_micros("ts"), P.dedupe_deliveries)
    return written(spark, out).groupBy(F.col("job_id").cast("bigint").alias("job_id")).agg(F.count("*").cast("bigint").alias("claims"))


def _intake(spark, sf) -> str:
    return replay(derived_request_bodies(spark, pages(spark, sf)), F.col("req_id"), P.validated_requests, write=P.intake_writer)


@query("stream_intake", oracle=VALIDATION_ORACLE + """
SELECT CAST(req_id AS BIGINT) AS req_id, kind, reject_reason IS NULL AS accepted, reject_reason FROM v
""")
def q_stream_intake(spark, sf):
    """Request intake (T1): accepted requests become jobs, the others are kept with their reason."""
    out = _intake(spark, sf)
    jobs = written(spark, out, "jobs").select("req_id", "kind", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reject_reason"))
    refused = written(spark, out, "rejected").select("req_id", "kind", F.lit(False).alias("accepted"), "reject_reason")
    return jobs.unionByName(refused).withColumn("req_id", F.col("req_id").cast("bigint"))


@query("stream_worker", oracle=_SCRAPE_CTES + """
SELECT CAST(req_id AS BIGINT) AS req_id, CASE WHEN error_type IS NULL THEN 'completed' ELSE 'failed' END AS status, error_type,
       CAST(CASE WHEN error_type IS NULL THEN 200 WHEN error_type = 'request_failed' THEN 0 END AS BIGINT) AS http_status,
       CAST(CASE WHEN error_type IS NULL THEN 0 ELSE 1 END AS BIGINT) AS retries_used FROM fx
""")
def q_stream_worker(spark, sf):
    """Intake, queue and worker in a row (T1, T2): scrape jobs that the intake wrote are taken from its queue folder."""
    p, out = pages(spark, sf), _intake(spark, sf)
    jobs = written(spark, out, "jobs").select("req_id", "job_id")
    queue = written(spark, out, "queue").drop(BATCH).where("kind = 'scrape'")
    done = replay(queue, F.pmod(F.xxhash64("job_id"), F.lit(1000)), slices=2,
                  write=lambda folder: P.worker_writer(folder, page_snapshot(p), dns_snapshot(spark, p), redirect_table(spark, p)))
    r = written(spark, done, "results").join(jobs, "job_id")
    return r.select(F.col("req_id").cast("bigint").alias("req_id"), "status", "error_type",
                    F.col("http_status").cast("bigint").alias("http_status"), F.col("retries_used").cast("bigint").alias("retries_used"))
