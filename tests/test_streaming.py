"""Streaming twins: file-stream sources, availableNow triggers, batch equivalence."""
import os

from pyspark.sql import functions as F

from pagefold.operators import jobs as J
from pagefold.operators import metrics as M
from pagefold.sources.requests import derived_request_bodies
from pagefold.sources.tables import events, pages
from pagefold.streaming import pipelines as P

from conftest import SF001


def _run(query):
    query.awaitTermination(240)
    assert query.exception() is None


def test_job_state_stream_matches_batch(spark, scratch):
    """Events dealt over files at random: many come before their job's creation, in an earlier micro-batch."""
    log = J.job_log_from_events(events(spark, SF001)).where("job_id is not null")
    src = os.path.join(scratch, "log")
    log.select(*[f.name for f in P.JOB_LOG_SCHEMA.fields]).repartition(4, F.hash("event_id")).write.parquet(src)
    stream = spark.readStream.schema(P.JOB_LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(scratch, "state")

    def keep(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")
    q = P.job_state_stream(stream).writeStream.outputMode("update").foreachBatch(keep) \
        .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start()
    _run(q)
    batch = J.fold_jobs(log)
    rows = spark.read.parquet(out)
    assert rows.agg(F.max("batch_id")).first()[0] >= 3
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*batch.columns), "batch_id").alias("s")).select("s.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_intake_foreach_batch(spark, scratch):
    bodies = derived_request_bodies(spark, pages(spark, SF001))
    src = os.path.join(scratch, "req")
    bodies.repartition(2).write.json(src)
    out = os.path.join(scratch, "out")
    q = P.request_stream(spark, src, max_files=1).writeStream.foreachBatch(P.intake_writer(out)) \
        .option("checkpointLocation", os.path.join(scratch, "ck4")).trigger(availableNow=True).start()
    _run(q)
    jobs = spark.read.parquet(os.path.join(out, "jobs"))
    rej = spark.read.parquet(os.path.join(out, "rejected"))
    assert jobs.count() + rej.count() == bodies.count()
    assert jobs.select("job_id").distinct().count() == jobs.count()


def test_counters_and_dedupe(spark, scratch):
    log = J.job_log_from_events(events(spark, SF001))
    src = os.path.join(scratch, "log")
    log.select(*[f.name for f in P.JOB_LOG_SCHEMA.fields]).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(P.JOB_LOG_SCHEMA).parquet(src)
    q = P.jobs_total_stream(stream, watermark="0 seconds").writeStream.outputMode("append").format("memory") \
        .queryName("jt").option("checkpointLocation", os.path.join(scratch, "ck5")).trigger(availableNow=True).start()
    _run(q)
    # append mode emits closed windows only; those must equal the batch windows, all but the last ones
    got = {(r["w"]["start"], r["status"]): (r["total"], r["rate"]) for r in spark.table("jt").collect()}
    batch = M.rate_per_window(log).collect()
    want = {(r["w"]["start"], r["status"]): (round(r["rate"] * 60), r["rate"]) for r in batch}
    assert all(want[k] == v for k, v in got.items())
    open_from = max(w for w, _ in got)
    assert {k for k in want if k[0] < open_from} <= got.keys()
    q2 = P.dedupe_deliveries(spark.readStream.schema(P.JOB_LOG_SCHEMA).parquet(src).where("job_id is not null")) \
        .writeStream.format("memory").queryName("dd").option("checkpointLocation", os.path.join(scratch, "ck6")) \
        .trigger(availableNow=True).start()
    _run(q2)
    assert spark.table("dd").count() == spark.table("dd").select("job_id").distinct().count()
