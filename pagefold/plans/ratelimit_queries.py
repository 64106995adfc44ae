"""Rate-limit queries over ``events``.

The event log stands in for request arrivals: user_id is the host (W4) or client
IP (W5), and time is compressed so the limits bind (30 days of events fall into
seconds): arrival_us = floor(unix_micros(ts) / factor).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import ratelimit as R
from pagefold.plans.catalog import query
from pagefold.sources.tables import events

HOST_FACTOR = 200_000     # 30 days -> ~13 s
IP_FACTOR = 100_000       # 30 days -> ~26 s


def _arrivals(spark, sf, factor):
    e = events(spark, sf)
    return e.select("event_id", F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("key"),
                    F.floor(F.unix_micros("ts") / factor).cast("bigint").alias("arrival_us"))


_T = int(1_000_000 / R.HOST_RATE)
_TAU = (R.HOST_BURST - 1) * _T

HOST_SQL = f"""
WITH a AS (SELECT event_id, 'h' || CAST(user_id AS VARCHAR) AS key,
                  CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / {HOST_FACTOR}) AS BIGINT) AS arrival_us FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY arrival_us, event_id) - 1 AS i FROM a),
m AS (SELECT *, max(arrival_us - i * {_T}) OVER (PARTITION BY key ORDER BY arrival_us, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM n),
s AS (SELECT event_id, key, arrival_us,
             CASE WHEN mx IS NULL THEN arrival_us ELSE greatest(arrival_us, i * {_T} + mx - {_TAU}) END AS start_us
      FROM m)
"""


@query("rate_limit_schedule", oracle=HOST_SQL + """
SELECT CAST(event_id AS BIGINT) AS event_id, key, CAST(arrival_us AS BIGINT) AS arrival_us,
       CAST(start_us AS BIGINT) AS start_us, CAST(start_us - arrival_us AS BIGINT) AS wait_us FROM s
""")
def q_rate_limit_schedule(spark, sf):
    s = R.host_schedule(_arrivals(spark, sf, HOST_FACTOR), "key", "arrival_us", "event_id",
                        chunk_us=1_000_000)
    return s.select(F.col("event_id").cast("bigint"), "key", "arrival_us", "start_us", "wait_us")


@query("rate_limit_summary", oracle=HOST_SQL + """
SELECT key, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE start_us > arrival_us) AS BIGINT) AS waited,
       CAST(sum(start_us - arrival_us) AS BIGINT) AS total_wait_us, CAST(max(start_us - arrival_us) AS BIGINT) AS max_wait_us
FROM s GROUP BY key
""")
def q_rate_limit_summary(spark, sf):
    s = R.host_schedule(_arrivals(spark, sf, HOST_FACTOR), "key", "arrival_us", "event_id",
                        chunk_us=1_000_000)
    return s.groupBy("key").agg(F.count(F.lit(1)).cast("bigint").alias("requests"),
                                F.count_if(F.col("wait_us") > 0).cast("bigint").alias("waited"),
                                F.sum("wait_us").cast("bigint").alias("total_wait_us"),
                                F.max("wait_us").cast("bigint").alias("max_wait_us"))


_IT = int(1_000_000 / R.IP_RATE)
_ITAU = (R.IP_BURST - 1) * _IT


@query("ip_rate_limit", oracle=f"""
WITH RECURSIVE a AS (
  SELECT event_id, 'h' || CAST(user_id AS VARCHAR) AS key,
         CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / {IP_FACTOR}) AS BIGINT) AS arrival_us FROM events),
n AS (SELECT *, CAST(floor(arrival_us / {R.IP_RESET_US}) AS BIGINT) AS epoch,
             row_number() OVER (PARTITION BY key, CAST(floor(arrival_us / {R.IP_RESET_US}) AS BIGINT)
                                ORDER BY arrival_us, event_id) AS rn FROM a),
rec AS (
  SELECT key, epoch, rn, event_id, true AS admitted, arrival_us + {_IT} AS tat FROM n WHERE rn = 1
  UNION ALL
  SELECT n.key, n.epoch, n.rn, n.event_id, n.arrival_us >= rec.tat - {_ITAU},
         CASE WHEN n.arrival_us >= rec.tat - {_ITAU} THEN greatest(n.arrival_us, rec.tat) + {_IT} ELSE rec.tat END
  FROM rec JOIN n ON n.key = rec.key AND n.epoch = rec.epoch AND n.rn = rec.rn + 1)
SELECT CAST(event_id AS BIGINT) AS event_id, key, epoch, admitted FROM rec
""")
def q_ip_rate_limit(spark, sf):
    a = R.ip_admission(_arrivals(spark, sf, IP_FACTOR), "key", "arrival_us", "event_id")
    return a.select(F.col("event_id").cast("bigint"), "key", "epoch", "admitted")
