"""Queries over the job log derived from ``events``.

Timestamps leave as BIGINT epoch microseconds (``*_us``) so both engines print the
same values regardless of session time zone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import jobs as J
from pagefold.plans.catalog import query
from pagefold.sources.tables import events

_MSG_CASE = "CASE " + " ".join(f"WHEN et = '{k}' THEN '{v}'" for k, v in J.ERROR_MESSAGES.items()) + " END"

JOB_LOG_SQL = f"""
e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, value,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'complete'
                             WHEN 'error' THEN 'fail' WHEN 'view' THEN 'cancel' END AS op
      FROM events),
j AS (SELECT *, last_value(CASE WHEN op = 'create' THEN event_id END IGNORE NULLS)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS job_id,
             CASE WHEN op = 'fail' THEN CASE WHEN k < 40 THEN 'http_failed' WHEN k < 60 THEN 'timeout'
                  WHEN k < 75 THEN 'dns' WHEN k < 90 THEN 'private_ip' ELSE 'invalid_url' END END AS et
      FROM e),
l AS (SELECT event_id, job_id, user_id, ts, op, et AS error_type,
             CASE WHEN op = 'fail' THEN {_MSG_CASE} END AS error_msg,
             CASE WHEN op = 'complete' THEN 200 WHEN et = 'http_failed' THEN 400 + k WHEN et = 'timeout' THEN 0 END
               AS http_status,
             CASE WHEN op = 'complete' OR et IN ('http_failed', 'timeout') THEN CAST(floor(value * 1000) AS BIGINT) END
               AS duration_ms,
             CASE WHEN op = 'complete' THEN 0 WHEN op = 'fail' THEN 1 END AS retries,
             row_number() OVER (ORDER BY ts, event_id) AS ord
      FROM j)"""

FOLD_SQL = JOB_LOG_SQL + """,
a AS (SELECT job_id,
        min(ts) FILTER (WHERE op = 'create') AS created_at,
        arg_min(op, ord) FILTER (WHERE op IN ('claim', 'cancel')) AS g_op,
        min(ord) FILTER (WHERE op IN ('claim', 'cancel')) AS g_ord,
        arg_min(ts, ord) FILTER (WHERE op IN ('claim', 'cancel')) AS g_ts,
        min(ord) FILTER (WHERE op IN ('complete', 'fail')) AS first_u,
        arg_max(op, ord) FILTER (WHERE op IN ('complete', 'fail')) AS lu_op,
        arg_max(ts, ord) FILTER (WHERE op IN ('complete', 'fail')) AS lu_ts,
        arg_max(retries, ord) FILTER (WHERE op IN ('complete', 'fail')) AS lu_retries,
        arg_max(error_msg, ord) FILTER (WHERE op = 'fail') AS lf_msg,
        max(ord) FILTER (WHERE op = 'fail') AS lf_ord,
        arg_max(http_status, ord) FILTER (WHERE op IN ('complete', 'fail') AND http_status IS NOT NULL) AS http_status,
        arg_max(duration_ms, ord) FILTER (WHERE op IN ('complete', 'fail') AND duration_ms IS NOT NULL) AS duration_ms,
        count(*) AS n_events
      FROM l WHERE job_id IS NOT NULL GROUP BY job_id),
s AS (SELECT *, g_op IS NOT NULL AND (first_u IS NULL OR g_ord < first_u) AS g_applied FROM a),
f AS (SELECT job_id,
        CASE WHEN lu_op IS NOT NULL THEN CASE WHEN lu_op = 'complete' THEN 'completed' ELSE 'failed' END
             WHEN g_applied THEN CASE WHEN g_op = 'claim' THEN 'processing' ELSE 'failed' END
             ELSE 'queued' END AS status,
        CASE WHEN g_applied AND g_op = 'cancel' AND (lf_ord IS NULL OR g_ord > lf_ord) THEN 'cancelled'
             ELSE lf_msg END AS error_msg,
        http_status, duration_ms, coalesce(lu_retries, 0) AS retries_used, created_at,
        greatest(created_at, coalesce(lu_ts, created_at), CASE WHEN g_applied THEN g_ts ELSE created_at END)
          AS updated_at,
        lu_ts AS completed_at, n_events,
        CASE WHEN g_applied AND g_op = 'claim' THEN g_ts END AS claimed_at
      FROM s)"""


def _jobs(spark, sf):
    return J.fold_jobs(J.job_log_from_events(events(spark, sf)))


def _us(c):
    return F.unix_micros(F.col(c)).alias(c + "_us")


@query("job_state", oracle="WITH " + FOLD_SQL + """
SELECT CAST(job_id AS BIGINT) AS job_id, status, error_msg, CAST(http_status AS BIGINT) AS http_status,
       duration_ms, CAST(retries_used AS BIGINT) AS retries_used, epoch_us(created_at) AS created_at_us,
       epoch_us(updated_at) AS updated_at_us, epoch_us(completed_at) AS completed_at_us,
       CAST(n_events AS BIGINT) AS n_events
FROM f
""")
def q_job_state(spark, sf):
    f = _jobs(spark, sf)
    return f.select(F.col("job_id").cast("bigint").alias("job_id"), "status", "error_msg",
                    F.col("http_status").cast("bigint").alias("http_status"), "duration_ms",
                    F.col("retries_used").cast("bigint").alias("retries_used"),
                    _us("created_at"), _us("updated_at"), _us("completed_at"),
                    F.col("n_events").cast("bigint").alias("n_events"))


@query("job_event_outcomes", oracle="WITH " + JOB_LOG_SQL + """,
w AS (SELECT *, last_value(CASE WHEN op IN ('complete', 'fail') THEN op END IGNORE NULLS)
                  OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  AS lu_op,
             first_value(CASE WHEN op IN ('claim', 'cancel') THEN op END IGNORE NULLS)
                  OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  AS fg_op
      FROM l WHERE job_id IS NOT NULL),
sb AS (SELECT *, CASE WHEN lu_op IS NOT NULL THEN CASE WHEN lu_op = 'complete' THEN 'completed' ELSE 'failed' END
                      WHEN fg_op = 'claim' THEN 'processing' WHEN fg_op = 'cancel' THEN 'failed'
                      ELSE 'queued' END AS status_before FROM w),
o AS (SELECT event_id, job_id, op, status_before,
             CASE WHEN op IN ('claim', 'cancel') THEN status_before = 'queued' ELSE true END AS applied FROM sb)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(job_id AS BIGINT) AS job_id, op, status_before, applied,
       CASE WHEN op = 'cancel' THEN CASE WHEN applied THEN 'ok' ELSE 'cannot cancel job with status: ' || status_before END
            WHEN op = 'claim' THEN CASE WHEN applied THEN 'claimed' ELSE 'skipped' END
            ELSE 'ok' END AS outcome
FROM o
UNION ALL
SELECT CAST(event_id AS BIGINT), NULL, op, NULL, false, 'not_found' FROM l WHERE job_id IS NULL
""")
def q_job_event_outcomes(spark, sf):
    o = J.event_outcomes(J.job_log_from_events(events(spark, sf)))
    return o.select(F.col("event_id").cast("bigint").alias("event_id"),
                    F.col("job_id").cast("bigint").alias("job_id"), "op", "status_before", "applied", "outcome")


@query("job_count_by_status", oracle="WITH " + FOLD_SQL + """
SELECT status, CAST(count(*) AS BIGINT) AS total FROM f GROUP BY status
UNION ALL SELECT '' AS status, CAST(count(*) AS BIGINT) AS total FROM f
""")
def q_job_count_by_status(spark, sf):
    f = _jobs(spark, sf)
    by = f.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("total"))
    allj = J.count_jobs(f).select(F.lit("").alias("status"), F.col("total").cast("bigint").alias("total"))
    return by.unionByName(allj)


def _page_sql(where: str, limit: int, offset: int) -> str:
    return "WITH " + FOLD_SQL + f"""
SELECT CAST(job_id AS BIGINT) AS job_id, status, epoch_us(created_at) AS created_at_us,
       epoch_us(updated_at) AS updated_at_us
FROM f {where} ORDER BY created_at DESC, job_id LIMIT {limit} OFFSET {offset}
"""


def _page(spark, sf, page, limit, status):
    f = _jobs(spark, sf).withColumn("url", F.lit(None).cast("string"))
    p = J.list_jobs(f, page=page, limit=limit, status=status)
    return p.select(F.col("job_id").cast("bigint").alias("job_id"), "status", _us("created_at"), _us("updated_at"))


@query("job_list_page", oracle=_page_sql("", 20, 20))
def q_job_list_page(spark, sf):
    return _page(spark, sf, 2, 20, None)


@query("job_list_failed_page", oracle=_page_sql("WHERE status = 'failed'", 20, 0))
def q_job_list_failed_page(spark, sf):
    # limit above 100 falls back to 20, page below 1 to 1
    return _page(spark, sf, 0, 500, "failed")


@query("job_list_deep_page", oracle="WITH " + FOLD_SQL + """,
n AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id) AS rn, (ceil(count(*) OVER () / 20.0) - 2) * 20 AS skip FROM f)
SELECT CAST(job_id AS BIGINT) AS job_id, status, epoch_us(created_at) AS created_at_us, epoch_us(updated_at) AS updated_at_us
FROM n WHERE rn > skip AND rn <= skip + 20
""")
def q_job_list_deep_page(spark, sf):
    """The last page but one, located by counts instead of sorting all rows before it."""
    f = _jobs(spark, sf).withColumn("url", F.lit(None).cast("string"))
    pages = -(-J.count_jobs(f).first()["total"] // 20)
    p = J.list_jobs(f, page=pages - 1, limit=20, shallow=0)
    return p.select(F.col("job_id").cast("bigint").alias("job_id"), "status", _us("created_at"), _us("updated_at"))


@query("retry_schedule", oracle="WITH " + FOLD_SQL + """,
r AS (SELECT job_id, CAST(n_events % 7 AS BIGINT) AS max_retries FROM f),
x AS (SELECT job_id, max_retries, unnest(range(max_retries)) AS attempt FROM r)
SELECT CAST(job_id AS BIGINT) AS job_id, max_retries, CAST(attempt AS BIGINT) AS attempt,
       CAST(CASE WHEN attempt = 0 THEN 0 ELSE 100 * (1 << (attempt - 1)) END AS BIGINT) AS backoff_ms
FROM x
""")
def q_retry_schedule(spark, sf):
    f = _jobs(spark, sf).select("job_id", (F.col("n_events") % 7).cast("bigint").alias("max_retries"))
    s = J.retry_schedule(f, F.col("max_retries"))
    return s.select(F.col("job_id").cast("bigint").alias("job_id"), "max_retries",
                    F.col("attempt").cast("bigint").alias("attempt"), F.col("backoff_ms").cast("bigint"))


def _attempts(spark, sf):
    """Attempts of every job: its finishes in order; the job's own option, derived from its id, limits them."""
    return J.numbered_attempts(J.job_log_from_events(events(spark, sf)), 1 + F.col("job_id") % 5)


@query("attempt_outcome", oracle="WITH " + JOB_LOG_SQL + """,
a AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS attempt, op = 'complete' AS ok,
             error_type, http_status, 1 + job_id % 5 AS max_retries
      FROM l WHERE job_id IS NOT NULL AND op IN ('complete', 'fail')),
b AS (SELECT * FROM a WHERE attempt < max_retries),
g AS (SELECT job_id, min(attempt) FILTER (WHERE ok) AS first_ok, max(attempt) AS last_attempt,
             arg_max(error_type, attempt) AS l_et, arg_max_null(http_status, attempt) AS l_hs
      FROM b GROUP BY job_id)
SELECT CAST(job_id AS BIGINT) AS job_id, first_ok IS NOT NULL AS succeeded,
       CAST(CASE WHEN first_ok IS NOT NULL THEN first_ok + 1 ELSE last_attempt + 1 END AS BIGINT) AS attempts_used,
       CAST(CASE WHEN first_ok IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS retries_flag,
       CASE WHEN first_ok IS NULL THEN l_et END AS error_type,
       CAST(CASE WHEN first_ok IS NULL THEN l_hs END AS BIGINT) AS http_status
FROM g
""")
def q_attempt_outcome(spark, sf):
    o = J.attempt_outcome(_attempts(spark, sf))
    return o.select(F.col("job_id").cast("bigint").alias("job_id"), "succeeded",
                    F.col("attempts_used").cast("bigint").alias("attempts_used"),
                    F.col("retries_flag").cast("bigint").alias("retries_flag"), "error_type",
                    F.col("http_status").cast("bigint").alias("http_status"))


@query("queue_fifo_position", oracle="WITH " + JOB_LOG_SQL + """
SELECT CAST(job_id AS BIGINT) AS job_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS position
FROM l WHERE op = 'create'
""")
def q_queue_fifo_position(spark, sf):
    from pagefold.functions.ranking import global_row_number
    log = J.job_log_from_events(events(spark, sf)).where(F.col("op") == "create")
    r = global_row_number(log.select("job_id", "ts", "event_id"), ["ts", "event_id"], out="position")
    return r.select(F.col("job_id").cast("bigint"), "position")


@query("job_queue_delay", oracle="WITH " + FOLD_SQL + """
SELECT CAST(job_id AS BIGINT) AS job_id, epoch_us(claimed_at) - epoch_us(created_at) AS claim_wait_us,
       epoch_us(completed_at) - epoch_us(created_at) AS finish_us
FROM f
""")
def q_job_queue_delay(spark, sf):
    f = _jobs(spark, sf)
    return f.select(F.col("job_id").cast("bigint"),
                    (F.unix_micros("claimed_at") - F.unix_micros("created_at")).alias("claim_wait_us"),
                    (F.unix_micros("completed_at") - F.unix_micros("created_at")).alias("finish_us"))


@query("metrics_retries_total", oracle="WITH " + JOB_LOG_SQL + """,
a AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS attempt, op = 'complete' AS ok
      FROM l WHERE job_id IS NOT NULL AND op IN ('complete', 'fail')),
g AS (SELECT job_id, min(attempt) FILTER (WHERE ok AND attempt < 1 + job_id % 5) AS first_ok,
             max(attempt) FILTER (WHERE attempt < 1 + job_id % 5) AS last_attempt FROM a GROUP BY job_id),
u AS (SELECT CASE WHEN first_ok IS NOT NULL THEN first_ok + 1 ELSE last_attempt + 1 END AS attempts_used FROM g)
SELECT CAST(0 AS BIGINT) AS declared_total, CAST(coalesce(sum(greatest(attempts_used - 1, 0)), 0) AS BIGINT) AS derived_total
FROM u
""")
def q_metrics_retries_total(spark, sf):
    from pagefold.operators.metrics import retries_total
    return retries_total(J.attempt_outcome(_attempts(spark, sf)))


@query("stuck_jobs", oracle="WITH " + FOLD_SQL + """
SELECT CAST(job_id AS BIGINT) AS job_id, epoch_us(updated_at) AS updated_at_us
FROM f WHERE status = 'processing' AND updated_at < (SELECT max(ts) FROM l) - INTERVAL 10 MINUTE
""")
def q_stuck_jobs(spark, sf):
    from pagefold.streaming.pipelines import stuck_jobs
    log = J.job_log_from_events(events(spark, sf))
    now = log.agg(F.max("ts")).first()[0]
    return stuck_jobs(J.fold_jobs(log), F.lit(now)).select(F.col("job_id").cast("bigint").alias("job_id"), _us("updated_at"))


@query("job_id_validity", oracle="""
WITH h AS (SELECT page_id, md5(CAST(page_id AS VARCHAR)) AS h FROM pages),
u AS (SELECT page_id, h, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS u FROM h),
i AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN u WHEN 1 THEN upper(u) WHEN 2 THEN 'urn:uuid:' || u WHEN 3 THEN '{' || u || '}'
                      WHEN 4 THEN h WHEN 5 THEN u || '0' WHEN 6 THEN replace(u, '-', '_') ELSE '{' || u END AS id FROM u)
SELECT page_id, id, page_id % 8 <= 4 AS valid FROM i
""")
def q_job_id_validity(spark, sf):
    from pagefold.functions.validate import is_valid_job_id
    from pagefold.sources.tables import pages
    h = F.md5(F.col("page_id").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    u = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    k = F.col("page_id") % 8
    i = F.when(k == 0, u).when(k == 1, F.upper(u)).when(k == 2, F.concat(F.lit("urn:uuid:"), u)) \
        .when(k == 3, F.concat(F.lit("{"), u, F.lit("}"))).when(k == 4, h).when(k == 5, F.concat(u, F.lit("0"))) \
        .when(k == 6, F.replace(u, F.lit("-"), F.lit("_"))).otherwise(F.concat(F.lit("{"), u))
    return pages(spark, sf).select("page_id", i.alias("id")).withColumn("valid", is_valid_job_id(F.col("id")))


@query("delivery_dedupe", oracle="WITH " + JOB_LOG_SQL + """,
d AS (SELECT job_id, ts FROM l WHERE op = 'create' UNION ALL SELECT job_id, ts FROM l WHERE op = 'create' AND job_id % 3 = 0)
SELECT CAST(job_id AS BIGINT) AS job_id, epoch_us(min(ts)) AS delivered_us, CAST(count(*) AS BIGINT) AS deliveries
FROM d GROUP BY job_id
""")
def q_delivery_dedupe(spark, sf):
    # batch twin of the streaming de-duplication: every third job is delivered twice and claimed once
    made = J.job_log_from_events(events(spark, sf)).where(F.col("op") == "create").select("job_id", "ts")
    sent = made.unionByName(made.where(F.col("job_id") % 3 == 0))
    once = sent.groupBy("job_id").agg(F.min("ts").alias("delivered"), F.count(F.lit(1)).alias("deliveries"))
    return once.select(F.col("job_id").cast("bigint").alias("job_id"), _us("delivered"), F.col("deliveries").cast("bigint"))
