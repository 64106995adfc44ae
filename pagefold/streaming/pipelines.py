"""Streaming twins of the batch operators.

Sources are file streams (new files in a folder are new micro-batches); sinks are
``foreachBatch`` writers so each micro-batch can run the batch operators unchanged
and write several tables at once. Keyed state is a mergeable aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.functions.validate import validate
from pagefold.operators import metrics as M
from pagefold.operators.jobs import accept_requests, fold_jobs
from pagefold.session import cut_lineage
from pagefold.sources.requests import parse_requests

REQUEST_FILE_SCHEMA = T.StructType([
    T.StructField("req_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("body", T.StringType())])

JOB_LOG_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("job_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("op", T.StringType()),
    T.StructField("error_msg", T.StringType()), T.StructField("http_status", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()), T.StructField("retries", T.IntegerType())])


# ---- T1: request intake ---------------------------------------------------------------------
def request_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """JSON-lines request files (req_id, kind, body) -> parsed and validated rows."""
    raw = spark.readStream.schema(REQUEST_FILE_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)
    return validated_requests(raw)


def validated_requests(raw: DataFrame) -> DataFrame:
    """Request rows (req_id, kind, body) of any stream, parsed and validated."""
    return validate(parse_requests(raw))


def intake_writer(out_folder: str):
    """foreachBatch sink: accepted -> jobs and queue tables, rejected -> rejects.
    Writes are keyed by batch id, so a replayed micro-batch overwrites its own
    output instead of duplicating it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        jobs = accept_requests(batch.where("accepted"))
        jobs.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{out_folder}/jobs/batch_id={batch_id}")
        jobs.select("job_id", "kind", "url", "extract", "options").write.mode("overwrite") \
            .parquet(f"{out_folder}/queue/batch_id={batch_id}")
        batch.where(~F.col("accepted")).select("req_id", "kind", "reject_reason").write.mode("overwrite") \
            .parquet(f"{out_folder}/rejected/batch_id={batch_id}")
        batch.unpersist()
    return write


# ---- T2: worker -----------------------------------------------------------------------------
RESULT_COLUMNS = ("job_id", "kind", "status", "error_type", "error_msg", "http_status", "retries_used", "result_json")


def worker_writer(out_folder: str, snapshot: DataFrame, dns: DataFrame, redirects: DataFrame):
    """foreachBatch sink running queued jobs of every kind against the snapshot tables."""
    from pagefold.operators.crawl import crawl_job_results, map_job_results, snapshot_edges
    from pagefold.operators.fetch import scrape_jobs

    edges = None

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal edges
        batch = batch.persist()
        of = lambda kind: batch.where(F.col("kind") == kind)
        done = [(scrape_jobs(of("scrape"), snapshot, dns, redirects), "scrape")]
        if not batch.where(F.col("kind").isin("crawl", "map")).isEmpty():
            # the snapshot is cut up once, at the first batch that follows links
            edges = cut_lineage(snapshot_edges(snapshot).repartition("src_url")) if edges is None else edges
            done += [(crawl_job_results(of("crawl"), snapshot, edges), "crawl"),
                     (map_job_results(of("map"), snapshot, edges), "map")]
        rows = None
        for frame, kind in done:
            frame = frame.withColumns({"kind": F.lit(kind), "result_json": F.to_json("result")}).select(*RESULT_COLUMNS)
            rows = frame if rows is None else rows.unionByName(frame)
        rows.write.mode("overwrite").parquet(f"{out_folder}/results/batch_id={batch_id}")
        batch.unpersist()
    return write


# ---- T3: job state machine ------------------------------------------------------------------
def job_state_stream(log_stream: DataFrame) -> DataFrame:
    """Current state of every job touched by a micro-batch (update mode).

    The state is the batch fold itself, one mergeable aggregate per job: its parts are earliest and latest events by
    event time, so events may come in any order and over any micro-batches, also before their job's ``create`` -
    they wait in the aggregate, and the job shows up once it is created. A job's state is one row, whatever the
    number of its events; a job with many events is pre-aggregated before the shuffle."""
    return fold_jobs(log_stream).where(F.col("created_at").isNotNull())


def stuck_jobs(jobs: DataFrame, now_col, minutes: int = 10) -> DataFrame:
    """Jobs still ``processing`` whose last update is older than ``minutes``."""
    return jobs.where((F.col("status") == "processing") &
                      (F.col("updated_at") < now_col - F.make_dt_interval(mins=F.lit(minutes))))


# ---- T6 / T7: counters and de-duplication ------------------------------------------------------
def jobs_total_stream(log_stream: DataFrame, watermark: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """scraper_jobs_total increments and rate per second of each event-time window
    (append mode emits a window once the watermark passes it)."""
    s = log_stream.select("ts", M._status_of_op().alias("status")).where(F.col("status").isNotNull())
    counted = s.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "status") \
        .agg(F.count(F.lit(1)).alias("total"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return counted.withColumn("rate", F.col("total") / seconds)


def dedupe_deliveries(queue_stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A job delivered twice within the watermark is claimed once."""
    return queue_stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job_id"])
