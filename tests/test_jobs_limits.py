"""Job fold vs a sequential state machine; rate limiters vs sequential buckets."""
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from pagefold.operators import jobs as J
from pagefold.operators import ratelimit as R
from pagefold.sources.tables import events

from conftest import SF001


def _apply_event(st, ev):
    """One event of a job, in time order, on its state."""
    if ev.op == "create":
        if st["status"] is None:
            st.update(status="queued", created_at=ev.ts, updated_at=ev.ts, retries_used=0)
    elif ev.op == "claim" and st["status"] == "queued":
        st.update(status="processing", updated_at=ev.ts)
    elif ev.op == "cancel" and st["status"] == "queued":
        st.update(status="failed", error_msg="cancelled", updated_at=ev.ts)
    elif ev.op in ("complete", "fail"):
        st.update(status="completed" if ev.op == "complete" else "failed", retries_used=ev.retries, completed_at=ev.ts,
                  updated_at=ev.ts)
        st.update({k: getattr(ev, k) for k in ("error_msg", "http_status", "duration_ms") if getattr(ev, k) is not None})


def test_fold_matches_sequential(spark):
    log = J.job_log_from_events(events(spark, SF001))
    fold = {r["job_id"]: r for r in J.fold_jobs(log).collect()}
    rows = sorted(log.where("job_id is not null").collect(), key=lambda r: (r["ts"], r["event_id"]))
    states = {}
    for ev in rows:
        st = states.setdefault(ev["job_id"], {k: None for k in ("status", "error_msg", "http_status", "duration_ms",
                                                                 "retries_used", "created_at", "updated_at", "completed_at")})
        _apply_event(st, SimpleNamespace(**ev.asDict()))
    assert set(states) == set(fold)
    for k, st in states.items():
        f = fold[k]
        assert (f["status"], f["error_msg"], f["http_status"], f["duration_ms"], f["retries_used"]) == \
            (st["status"], st["error_msg"], st["http_status"], st["duration_ms"], st["retries_used"]), k


def test_claim_cancel_outcomes(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = [(1, 1, t0, "create"), (2, 1, t0 + timedelta(seconds=1), "claim"), (3, 1, t0 + timedelta(seconds=2), "claim"),
            (4, 1, t0 + timedelta(seconds=3), "cancel"), (5, 2, t0, "create"), (6, 2, t0 + timedelta(seconds=1), "cancel"),
            (7, 2, t0 + timedelta(seconds=2), "claim"), (8, None, t0, "cancel")]
    log = spark.createDataFrame([(e, j, ts, op, None, None, None, None) for e, j, ts, op in rows],
                                "event_id long, job_id long, ts timestamp, op string, error_msg string, "
                                "http_status int, duration_ms long, retries int")
    out = {r["event_id"]: r["outcome"] for r in J.event_outcomes(log).collect()}
    assert out[2] == "claimed" and out[3] == "skipped" and out[4] == "cannot cancel job with status: processing"
    assert out[6] == "ok" and out[7] == "skipped" and out[8] == "not_found"
    st = {r["job_id"]: r for r in J.fold_jobs(log).collect()}
    assert st[1]["status"] == "processing" and st[2]["status"] == "failed" and st[2]["error_msg"] == "cancelled"
    assert st[2]["completed_at"] is None


def test_paging_rules():
    assert J.normalize_paging(0, 500) == (1, 20) and J.normalize_paging(3, 100) == (3, 100)
    try:
        J.check_status_filter("bogus")
        raise AssertionError
    except ValueError:
        pass


def test_host_schedule_matches_bucket(spark):
    rnd = random.Random(3)
    rows, expect = [], {}
    for k in range(6):
        t, arr = 0, []
        for i in range(rnd.randint(5, 60)):
            t += rnd.choice([0, 1000, 50_000, 200_000, 900_000, 3_000_000])
            arr.append(t)
        for i, a in enumerate(arr):
            rows.append((f"k{k}", k * 1000 + i, a))
        expect.update({(f"k{k}", k * 1000 + i): s for i, s in enumerate(R.simulate_token_bucket(arr, 2.0, 2))})
    df = spark.createDataFrame(rows, "key string, seq long, arrival_us long")
    got = {(r["key"], r["seq"]): r["start_us"] for r in R.host_schedule(df, "key", "arrival_us", "seq",
                                                                         chunk_us=1_000_000).collect()}
    assert all(abs(got[k] - v) <= 1 for k, v in expect.items())


def test_ip_admission_matches_bucket(spark):
    rnd = random.Random(5)
    rows = []
    t = 0
    for i in range(300):
        t += rnd.choice([0, 10_000, 100_000, 1_500_000])
        rows.append(("ip", i, t))
    df = spark.createDataFrame(rows, "key string, seq long, arrival_us long")
    got = [r["admitted"] for r in R.ip_admission(df, "key", "arrival_us", "seq", reset_us=10**15).orderBy("seq").collect()]
    exp = R.admission_pandas(pd.DataFrame({"arrival_us": [r[2] for r in rows]})).tolist()
    assert got == exp


def test_attempt_numbers_and_percentiles_in_two_levels(spark):
    import numpy as np
    from pagefold.functions.ranking import exact_percentiles, global_row_number, row_number_in_key
    rng = np.random.default_rng(4)
    rows = [(int(i), int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 400), rng.permutation(400)))]
    df = spark.createDataFrame(rows, "id long, k long, t long").withColumn("chunk", F.floor(F.col("t") / 50)).repartition(5)
    got = {r["id"]: r["rn"] for r in row_number_in_key(df, "k", ["t"], "chunk").collect()}
    for key in range(3):
        order = [i for i, k, _ in sorted(rows, key=lambda r: r[2]) if k == key]
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    for parts in ("4", "8", "50"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            numbered = global_row_number(df, ["t"]).collect()
            assert all(r["rn"] == r["t"] + 1 for r in numbered)
            values = df.select(F.when(F.col("id") > 5, F.col("t") % 37).alias("v"))
            want = np.percentile([t % 37 for i, _, t in rows if i > 5], [0, 50, 95, 99, 100])
            assert np.allclose(exact_percentiles(values, "v", (0.0, 0.5, 0.95, 0.99, 1.0)), want)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert exact_percentiles(values.where("false"), "v", (0.5,)) == [None]


def test_deep_pages_are_located_by_counts(spark):
    import datetime as dt
    from pagefold.operators import jobs as J
    day, rows = dt.datetime(2024, 1, 1), []
    for i in range(300):  # many jobs in one second, seconds and days without any
        rows.append((i, day + dt.timedelta(days=i // 90 * 3, seconds=min(i % 90, 40) // 7, milliseconds=i % 3)))
    jobs = spark.createDataFrame([(i, "u", "failed" if i % 4 else "queued", t, t) for i, t in rows],
                                 "job_id int, url string, status string, created_at timestamp, updated_at timestamp")
    for status in (None, "failed"):
        want = [i for i, t in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])) if status is None or i % 4]
        for page in (1, 2, 7, 14, 15, 30, 31, 99):
            got = [r["job_id"] for r in J.list_jobs(jobs, page, 20, status, shallow=0).collect()]
            assert got == want[(page - 1) * 20:page * 20], (status, page)
