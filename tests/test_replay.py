"""Replay: slices in order, restarts between them, batches that are run twice, empty tables."""
import glob

from pyspark.sql import functions as F

from pagefold.streaming import pipelines as P
from pagefold.streaming.replay import BATCH, latest, replay, written


def test_slices_restart_and_keep_their_state(spark):
    table = spark.createDataFrame([(i, i % 3) for i in range(40)], "n int, k int").repartition(3)
    out = replay(table, F.col("n"), lambda s: s.groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("top")), slices=4, mode="update")
    rows = written(spark, out)
    per_batch = {r[BATCH]: r["top"] for r in rows.groupBy(BATCH).agg(F.max("top").alias("top")).collect()}
    assert len(per_batch) >= 4 and list(dict(sorted(per_batch.items())).values()) == sorted(per_batch.values())
    assert sorted(map(tuple, latest(rows, "k").collect())) == [(0, 14, 39), (1, 13, 37), (2, 13, 38)]


def test_nulls_ties_and_one_slice(spark):
    table = spark.createDataFrame([(None,), (1,), (1,), (1,)], "n int")
    for slices in (1, 3):
        assert sorted(str(r["n"]) for r in written(spark, replay(table, F.col("n"), slices=slices)).collect()) == ["1", "1", "1", "None"]


def test_a_batch_that_runs_twice_replaces_itself(spark, scratch):
    write = P.intake_writer(scratch)
    batch = P.validated_requests(spark.createDataFrame([(1, "scrape", '{"url": "http://e.com/"}'), (2, "scrape", "{")], "req_id long, kind string, body string"))
    for _ in range(2):
        write(batch, 7)
    assert written(spark, scratch, "jobs").count() == 1 and written(spark, scratch, "rejected").count() == 1
    assert [r[BATCH] for r in written(spark, scratch, "jobs").select(BATCH).collect()] == [7]


def test_empty_table(spark):
    out = replay(spark.createDataFrame([], "n int"), F.col("n"))
    assert all(written(spark, out).count() == 0 for _ in glob.glob(f"{out.removeprefix('file:')}/rows"))
