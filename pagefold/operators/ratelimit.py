"""Rate limiters as batch operators.

W4 -- per-host delay (token bucket with reservation, every request eventually
runs). With period T = 1/rate, burst b and arrivals a_0 <= a_1 <= ... of one key:

    start_0 = a_0
    start_i = max(a_i, T*i + max_{k<i}(a_k - k*T) - (b-1)*T)

so the schedule is a row number plus a running max. It is computed in two levels
so a key with a third of all rows is still spread over tasks: inside each
(key, time chunk) a local row number and local running max; across the chunks of a
key (one row per chunk) the row offset and the carried max; then one join. All
times are integer microseconds, so results are exact.

W5 -- per-IP admit/deny (``Allow``): a request is admitted iff a token is
available; denied requests take none; every bucket is reset at each ``reset``
boundary. Equivalently (policing GCRA): admit iff t >= TAT - (b-1)*T, then
TAT = max(t, TAT) + T. This has no closed form, so it runs as a sorted stream:
rows are hash-partitioned by (key, epoch), sorted inside the partition, and walked
by ``mapInPandas`` with O(1) state -- no group is ever collected in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: limiter defaults --------------------------------------------------------
HOST_RATE, HOST_BURST = 2.0, 2             # per-host requests/s and burst (worker default)
IP_RATE, IP_BURST = 1.0, 10                # per-IP requests/s and burst (API default)
IP_RESET_US = 10 * 60 * 1_000_000          # visitor buckets are cleared every 10 minutes
# ---------------------------------------------------------------------------------------------


def host_schedule(df: DataFrame, key: str, arrival_us: str, seq: str, rate: float = HOST_RATE,
                  burst: int = HOST_BURST, chunk_us: int = 60_000_000) -> DataFrame:
    """Add ``start_us`` and ``wait_us`` to every request.

    df: one row per request with ``key`` (host, or worker+host), ``arrival_us``
    (bigint microseconds) and ``seq`` (tie-break for equal arrivals)."""
    t = int(round(1_000_000 / rate))
    tau = (burst - 1) * t
    x = df.withColumn("_chunk", F.floor(F.col(arrival_us) / chunk_us).cast("bigint"))
    wl = Window.partitionBy(key, "_chunk").orderBy(arrival_us, seq)
    x = x.withColumn("_j", F.row_number().over(wl) - 1) \
        .withColumn("_v", F.col(arrival_us) - F.col("_j") * t) \
        .withColumn("_lmax", F.max("_v").over(wl.rowsBetween(Window.unboundedPreceding, -1)))
    per_chunk = x.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_cmax"))
    wc = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (key, chunk): offsets and carried max of a_k - k*T in global index terms
    per_chunk = per_chunk.withColumn("_off", F.coalesce(F.sum("_n").over(wc), F.lit(0)).cast("bigint"))
    per_chunk = per_chunk.withColumn("_gmax_chunk", F.col("_cmax") - F.col("_off") * t)
    per_chunk = per_chunk.withColumn("_carry", F.max("_gmax_chunk").over(wc))
    y = x.join(per_chunk.select(key, "_chunk", "_off", "_carry"), [key, "_chunk"])
    i = F.col("_off") + F.col("_j")
    local = F.col("_lmax") - F.col("_off") * t            # local max in global index terms
    m = F.greatest(F.col("_carry"), local)                # NULL when nothing came before
    start = F.when(m.isNull(), F.col(arrival_us)).otherwise(
        F.greatest(F.col(arrival_us), i * t + m - tau))
    y = y.withColumn("start_us", start.cast("bigint")).withColumn("wait_us", (F.col("start_us") - F.col(arrival_us)))
    return y.drop("_chunk", "_j", "_v", "_lmax", "_off", "_carry")


def ip_admission(df: DataFrame, key: str, arrival_us: str, seq: str, rate: float = IP_RATE,
                 burst: int = IP_BURST, reset_us: int = IP_RESET_US, origin_us: int = 0) -> DataFrame:
    """Add ``epoch`` and ``admitted`` to every request."""
    t = int(round(1_000_000 / rate))
    tau = (burst - 1) * t
    x = df.withColumn("epoch", F.floor((F.col(arrival_us) - origin_us) / reset_us).cast("bigint"))
    x = x.repartition(key, "epoch").sortWithinPartitions(key, "epoch", arrival_us, seq)
    out_schema = T.StructType(x.schema.fields + [T.StructField("admitted", T.BooleanType())])

    def walk(batches):
        cur_key, tat = None, None
        for pdf in batches:
            keys = list(zip(pdf[key].tolist(), pdf["epoch"].tolist()))
            arr = pdf[arrival_us].to_numpy(dtype=np.int64)
            adm = np.empty(len(pdf), dtype=bool)
            for n in range(len(pdf)):
                if keys[n] != cur_key:            # new bucket: full
                    cur_key, tat = keys[n], None
                a = int(arr[n])
                if tat is None or a >= tat - tau:
                    adm[n] = True
                    tat = (a if tat is None else max(a, tat)) + t
                else:
                    adm[n] = False
            yield pdf.assign(admitted=adm)

    return x.mapInPandas(walk, out_schema)


def simulate_token_bucket(arrivals_us, rate: float, burst: int) -> list[int]:
    """Sequential reference of W4 (reservation semantics) for tests."""
    t = 1_000_000 / rate
    tokens, last, out = float(burst), None, []
    for a in arrivals_us:
        if last is not None:
            tokens = min(burst, tokens + (a - last) / t)
        last = a
        tokens -= 1
        out.append(a if tokens >= 0 else int(round(a + (-tokens) * t)))
    return out


def admission_pandas(pdf: pd.DataFrame, rate: float = IP_RATE, burst: int = IP_BURST) -> pd.Series:
    """Sequential token-bucket Allow() for one key, in exact rational arithmetic (tests)."""
    from fractions import Fraction
    t = Fraction(1_000_000) / Fraction(rate)
    tokens, last, out = Fraction(burst), None, []
    for a in pdf["arrival_us"]:
        if last is not None:
            tokens = min(burst, tokens + (a - last) / t)
        last = a
        if tokens >= 1:
            tokens -= 1
            out.append(True)
        else:
            out.append(False)
    return pd.Series(out)
