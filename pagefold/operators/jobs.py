"""Jobs as tables: accept, event log, state fold, claim/cancel/update outcomes,
paging, counts and the per-status response projection.

The reference mutates one database row per job. Here a job is the fold of its
event log ordered by (ts, event_id):

* create opens the job in ``queued``;
* claim applies only in ``queued`` (-> ``processing``); the first claim wins;
* cancel applies only in ``queued`` (-> ``failed``, error 'cancelled', no completed_at);
* complete / fail are *unguarded* updates: status, last non-null result fields,
  retries (0 on success, 1 on failure) and completed_at are overwritten.

So after the first unguarded update no guarded event applies, and before it only
the first guarded event can. The final state is therefore a plain grouped
aggregate (``min_by``/``max_by`` with FILTER), which Spark computes with partial
(map-side) aggregation: a job with millions of events never gathers in one task.
Per-event outcomes (was this claim first? what status did this cancel see?) use a
running window over the job's ordered log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.ranking import carry, row_number_in_key
from pagefold.functions.validate import JOB_STATUSES, deterministic_uuid, with_defaults
from pagefold.session import cut_lineage

# ---- fixed values: statuses, messages and the error classes of a failed scrape ------------
MSG_CANCELLED = "cancelled"
MSG_NOT_FOUND = "job not found"
MSG_CANNOT_CANCEL = "cannot cancel job with status"
MSG_BAD_STATUS_FILTER = "invalid status filter: must be queued, processing, completed, or failed"
ERROR_MESSAGES = {
    "invalid_url": "invalid URL: must be http:// or https://",
    "http_failed": "HTTP request failed with non-2xx status",
    "parse_failure": "failed to parse response body",
    "timeout": "request timed out",
    "private_ip": "request refused: target resolves to a private IP",
    "too_many_redirects": "too many redirects",
    "dns": "dns lookup failed",
}
POLL_PREFIX = "/api/v1/jobs/"
DEFAULT_PAGE_LIMIT, MAX_PAGE_LIMIT = 20, 100
CHUNK_SECONDS = 3600            # time chunk of the two-level running windows
# -------------------------------------------------------------------------------------------


def accept_requests(accepted: DataFrame) -> DataFrame:
    """Accepted requests -> job rows (S8/S9): defaults applied, deterministic id,
    status queued, poll url. ``req_id`` keys the id so a retried task writes the
    same ids."""
    d = with_defaults(accepted)
    job_id = deterministic_uuid(F.col("req_id"))
    return d.select("req_id", job_id.alias("job_id"), "kind", "url", "extract", "options",
                    F.lit("queued").alias("status"), F.concat(F.lit(POLL_PREFIX), job_id).alias("poll_url"))


# ---- event log derived from the driver's events table --------------------------------------
OP_OF_EVENT = {"signup": "create", "click": "claim", "purchase": "complete", "error": "fail", "view": "cancel"}


def error_type_of(k: Column) -> Column:
    return F.when(k < 40, "http_failed").when(k < 60, "timeout").when(k < 75, "dns") \
        .when(k < 90, "private_ip").otherwise("invalid_url")


def job_log_from_events(events: DataFrame) -> DataFrame:
    """(event_id, job_id, ts, op, error_type, error_msg, http_status, duration_ms, retries).

    Every ``signup`` opens a job for its user; the user's later events belong to the
    latest job opened at or before them (an as-of assignment by running window).
    Events before a user's first signup have job_id NULL (job not found)."""
    op = F.create_map(*[x for kv in OP_OF_EVENT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").try_cast("int")
    ev = events.select("event_id", "ts", "user_id", op.alias("op"), "value", k.alias("k"),
                       F.floor(F.unix_seconds("ts") / CHUNK_SECONDS).alias("_chunk"))
    ev = carry(ev, "user_id", ["ts", "event_id"], "_chunk",
               {"job_id": (F.when(F.col("op") == "create", F.col("event_id")), "last")})
    et = F.when(F.col("op") == "fail", error_type_of(F.col("k")))
    msgs = F.create_map(*[x for kv in ERROR_MESSAGES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    dur = F.floor(F.col("value") * 1000).cast("bigint")
    return ev.select(
        "event_id", "job_id", "user_id", "ts", "op",
        et.alias("error_type"),
        F.when(F.col("op") == "fail", msgs[et]).alias("error_msg"),
        F.when(F.col("op") == "complete", F.lit(200))
         .when(et == "http_failed", F.lit(400) + F.col("k"))
         .when(et == "timeout", F.lit(0)).cast("int").alias("http_status"),
        F.when((F.col("op") == "complete") | et.isin("http_failed", "timeout"), dur).alias("duration_ms"),
        F.when(F.col("op") == "complete", F.lit(0)).when(F.col("op") == "fail", F.lit(1)).cast("int")
         .alias("retries"))


# ---- fold ----------------------------------------------------------------------------------
def _ord() -> Column:
    return F.struct(F.col("ts"), F.col("event_id"))


def fold_jobs(log: DataFrame) -> DataFrame:
    """Current state of every job (W2/T3 batch twin) as one grouped aggregate."""
    o = _ord()
    is_u = F.col("op").isin("complete", "fail")
    is_g = F.col("op").isin("claim", "cancel")
    agg = log.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(
        F.min(F.when(F.col("op") == "create", F.col("ts"))).alias("created_at"),
        F.min_by(F.struct("op", "ts", "event_id"), F.when(is_g, o)).alias("g"),
        F.min(F.when(is_u, o)).alias("first_u"),
        F.max_by(F.struct("op", "ts", "retries"), F.when(is_u, o)).alias("last_u"),
        F.max_by(F.struct("error_msg", "ts", "event_id"), F.when(F.col("op") == "fail", o)).alias("last_fail"),
        F.max_by(F.col("http_status"), F.when(is_u & F.col("http_status").isNotNull(), o)).alias("http_status"),
        F.max_by(F.col("duration_ms"), F.when(is_u & F.col("duration_ms").isNotNull(), o)).alias("duration_ms"),
        F.count(F.lit(1)).alias("n_events"))
    g_applied = F.col("g").isNotNull() & (F.col("first_u").isNull() |
                                          (F.struct(F.col("g.ts"), F.col("g.event_id")) < F.col("first_u")))
    cancel_applied = g_applied & (F.col("g.op") == "cancel")
    status = F.when(F.col("last_u").isNotNull(),
                    F.when(F.col("last_u.op") == "complete", "completed").otherwise("failed")) \
        .when(g_applied, F.when(F.col("g.op") == "claim", "processing").otherwise("failed")) \
        .otherwise("queued")
    cancel_later = cancel_applied & (F.col("last_fail").isNull() | (
        F.struct(F.col("g.ts"), F.col("g.event_id")) > F.struct(F.col("last_fail.ts"), F.col("last_fail.event_id"))))
    error_msg = F.when(cancel_later, F.lit(MSG_CANCELLED)).otherwise(F.col("last_fail.error_msg"))
    updated_at = F.greatest(F.col("created_at"), F.col("last_u.ts"), F.when(g_applied, F.col("g.ts")))
    return agg.select(
        "job_id", status.alias("status"), error_msg.alias("error_msg"), "http_status", "duration_ms",
        F.coalesce(F.col("last_u.retries"), F.lit(0)).alias("retries_used"),
        "created_at", updated_at.alias("updated_at"), F.col("last_u.ts").alias("completed_at"), "n_events",
        F.when(g_applied & (F.col("g.op") == "claim"), F.col("g.ts")).alias("claimed_at"))


def event_outcomes(log: DataFrame) -> DataFrame:
    """Status each event saw and whether it applied (claim/cancel/update outcomes:
    J4, J5, J6, W7). Events without a job are ``not_found``."""
    is_u = F.col("op").isin("complete", "fail")
    is_g = F.col("op").isin("claim", "cancel")
    # events without a job skip the window (they would all share the NULL key)
    x = log.where(F.col("job_id").isNotNull()).withColumn("_chunk", F.floor(F.unix_seconds("ts") / CHUNK_SECONDS))
    x = carry(x, "job_id", ["ts", "event_id"], "_chunk", {
        "last_u_op": (F.when(is_u, F.col("op")), "last"),
        "first_g_op": (F.when(is_g, F.col("op")), "first")}, include_current=False).drop("_chunk")
    status_before = F.when(F.col("last_u_op").isNotNull(),
                           F.when(F.col("last_u_op") == "complete", "completed").otherwise("failed")) \
        .when(F.col("first_g_op") == "claim", "processing").when(F.col("first_g_op") == "cancel", "failed") \
        .otherwise("queued")
    x = x.withColumn("status_before", status_before)
    applied = F.when(is_g, F.col("status_before") == "queued").otherwise(F.lit(True))
    outcome = F.when(F.col("op") == "cancel", F.when(applied, F.lit("ok")).otherwise(
        F.concat(F.lit(MSG_CANNOT_CANCEL + ": "), F.col("status_before")))
    ).when(F.col("op") == "claim", F.when(applied, F.lit("claimed")).otherwise(F.lit("skipped"))) \
        .otherwise(F.lit("ok"))
    found = x.select("event_id", "job_id", "op", "ts", "status_before", applied.alias("applied"),
                     outcome.alias("outcome"))
    missing = log.where(F.col("job_id").isNull()).select(
        "event_id", "job_id", "op", "ts", F.lit(None).cast("string").alias("status_before"),
        F.lit(False).alias("applied"), F.lit("not_found").alias("outcome"))
    return found.unionByName(missing)


# ---- paging and counts ---------------------------------------------------------------------
def normalize_paging(page: int | None, limit: int | None) -> tuple[int, int]:
    page = page if page is not None and page >= 1 else 1
    limit = limit if limit is not None and 1 <= limit <= MAX_PAGE_LIMIT else DEFAULT_PAGE_LIMIT
    return page, limit


def check_status_filter(status: str | None) -> str | None:
    if status in (None, ""):
        return None
    if status not in JOB_STATUSES:
        raise ValueError(MSG_BAD_STATUS_FILTER)
    return status


SHALLOW = 10_000  # rows up to which a page is a top-k of every task


def _located(jobs: DataFrame, unit: str, skip: int, limit: int) -> tuple[DataFrame, int]:
    """The rows of those time buckets that the page lies in, newest first, and what is left to skip among them. Buckets
    are counted with partial sums; their running total is a table of one row per bucket. Runs one job."""
    bucket = F.date_trunc(unit, F.col("created_at"))
    counts = jobs.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    hit = upto.where((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + limit)).agg(
        F.min("b").alias("lo"), F.max("b").alias("hi"), F.min(F.col("upto") - F.col("n")).alias("before")).first()
    if hit["lo"] is None:
        return jobs.where(F.lit(False)), 0
    return jobs.where(bucket.between(F.lit(hit["lo"]), F.lit(hit["hi"]))), skip - hit["before"]


def list_jobs(jobs: DataFrame, page: int | None = 1, limit: int | None = DEFAULT_PAGE_LIMIT,
              status: str | None = None, shallow: int = SHALLOW) -> DataFrame:
    """One page of job summaries, newest first (L1). ``job_id`` breaks ties on
    created_at so pages are deterministic. Up to ``shallow`` rows from the top the plan is a
    top-k (TakeOrderedAndProject): each task keeps at most offset + limit rows. A page further down is located by
    counts, per day and then per second of the days it lies in, so that no task sorts more than the seconds of the page;
    the narrow job rows are written once for that, and two small jobs run while the query is built."""
    page, limit = normalize_paging(page, limit)
    status = check_status_filter(status)
    src = jobs if status is None else jobs.where(F.col("status") == status)
    src, skip = src.select("job_id", "url", "status", "created_at", "updated_at"), (page - 1) * limit
    if skip + limit > shallow:
        src = cut_lineage(src)
        for unit in ("day", "second"):
            src, skip = _located(src, unit, skip, limit)
    return src.orderBy(F.col("created_at").desc(), F.col("job_id")).offset(skip).limit(limit)


def count_jobs(jobs: DataFrame, status: str | None = None) -> DataFrame:
    status = check_status_filter(status)
    src = jobs if status is None else jobs.where(F.col("status") == status)
    return src.agg(F.count(F.lit(1)).alias("total"))


# ---- response projection -------------------------------------------------------------------
def job_meta(result: Column, status: Column, retries_used: Column) -> Column:
    """Counts shown with a completed job (F19); NULL arrays count 0, markdown in bytes."""
    def n(c):
        return F.coalesce(F.size(c), F.lit(0)).cast("int")
    return F.when(status == "completed", F.struct(
        n(result["links"]).alias("links_count"), n(result["headers"]).alias("headers_count"),
        n(result["paragraphs"]).alias("paragraphs_count"),
        F.coalesce(F.octet_length(result["markdown"]), F.lit(0)).alias("markdown_length"),
        F.coalesce(result["pages_crawled"], F.lit(0)).alias("pages_crawled"),
        n(result["urls"]).alias("url_count"),
        F.coalesce(result["http_status"], F.lit(0)).alias("http_status"),
        retries_used.alias("retries_used"),
        F.coalesce(result["truncated"], F.lit(False)).alias("truncated")))


def job_response(jobs: DataFrame) -> DataFrame:
    """Per-status projection (F20): completed -> results + meta; failed -> error;
    otherwise neither. ``updated_at`` is not part of the response."""
    st = F.col("status")
    return jobs.select(
        "job_id", "status", "url", "created_at", "completed_at", "duration_ms",
        F.when(st == "completed", F.col("result")).alias("results"),
        job_meta(F.col("result"), st, F.col("retries_used")).alias("meta"),
        F.when(st == "failed", F.col("error_msg")).alias("error"))


# ---- retries --------------------------------------------------------------------------------
def retry_schedule(jobs: DataFrame, max_retries: Column) -> DataFrame:
    """One row per attempt (F22): attempt k>=1 waits 100*2^(k-1) ms first;
    max_retries attempts in total (0 -> none)."""
    seq = F.when(max_retries > 0, F.sequence(F.lit(0), (max_retries - 1).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))
    att = jobs.select("*", F.explode(seq).alias("attempt"))
    return att.where(F.col("attempt") >= 0).withColumn(
        "backoff_ms", F.when(F.col("attempt") == 0, F.lit(0).cast("bigint"))
        .otherwise(F.expr("shiftleft(CAST(100 AS BIGINT), attempt - 1)")))


def numbered_attempts(log: DataFrame, max_retries: Column) -> DataFrame:
    """Attempts table of a job log: every finish of a job is one attempt, numbered from 0 in two levels, so that a
    job with a third of all events is spread over tasks."""
    done = log.where(F.col("job_id").isNotNull() & F.col("op").isin("complete", "fail")) \
        .withColumn("_chunk", F.floor(F.unix_seconds("ts") / CHUNK_SECONDS))
    att = row_number_in_key(done, "job_id", ["ts", "event_id"], "_chunk", "_n")
    return att.select("job_id", (F.col("_n") - 1).alias("attempt"), (F.col("op") == "complete").alias("ok"),
                      "error_type", "http_status", max_retries.alias("max_retries"))


def attempt_outcome(attempts: DataFrame, key: str = "job_id") -> DataFrame:
    """Fold an attempts table (F23/F24): the first success within max_retries wins,
    else the last attempt; ``retries_flag`` is 0 on success and 1 on failure, and
    ``attempts_used`` is the true count. Jobs with max_retries 0 have no attempt and
    fail with 'no attempts'."""
    a = attempts.where(F.col("attempt") < F.col("max_retries"))
    agg = a.groupBy(key).agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"),
        F.max("attempt").alias("last_attempt"),
        F.max_by(F.struct("error_type", "http_status"), F.col("attempt")).alias("last"))
    ok = F.col("first_ok").isNotNull()
    return agg.select(
        key, ok.alias("succeeded"),
        F.when(ok, F.col("first_ok") + 1).otherwise(F.col("last_attempt") + 1).alias("attempts_used"),
        F.when(ok, F.lit(0)).otherwise(F.lit(1)).alias("retries_flag"),
        F.when(~ok, F.col("last.error_type")).alias("error_type"),
        F.when(~ok, F.col("last.http_status")).alias("http_status"))
