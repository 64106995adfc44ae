"""Replay of a table as a stream.

``replay`` deals a table into slices of its order column, hands them one after the other to a streaming query as files
in the shared folder, and lets the query work off each slice with ``availableNow``. The query stops after every slice
and starts again from its checkpoint, as after the loss of a driver, so state and offsets have to survive. What the
query writes is kept by batch number; a batch that is run twice replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.session import checkpoint_dir

BATCH = "batch_id"


def _cuts(table: DataFrame, order: Column, slices: int) -> list:
    """Upper ends of all slices but the last, at equal shares of the rows."""
    number = order.cast("double")
    shares = [i / slices for i in range(1, slices)]
    found = table.select(F.percentile_approx(number, shares, 10_000)).first()[0] if shares else []
    return sorted(set(found or []))


def replay(table: DataFrame, order: Column, build: Callable[[DataFrame], DataFrame] | None = None, *, slices: int = 4,
           mode: str = "append", write: Callable[[str], Callable] | None = None) -> str:
    """Stream ``table`` in ``slices`` by ``order`` through ``build`` and return the folder of what was written.

    ``write(folder)`` gives a ``foreachBatch`` sink of its own; by default every batch's rows go to ``rows/batch_id=n``."""
    spark = table.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/replay_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/rows/{BATCH}={batch_id}")
    sink = keep if write is None else write(f"{base}/out")
    cuts = _cuts(table, order, slices)
    number = order.cast("double")
    for i in range(len(cuts) + 1):
        part = table
        if i:
            part = part.where(number > cuts[i - 1])
        if i < len(cuts):
            part = part.where((number <= cuts[i]) if i else (number <= cuts[i]) | number.isNull())
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{base}/in")
        running = (stream if build is None else build(stream)).writeStream.outputMode(mode).foreachBatch(sink) \
            .option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    return f"{base}/out"


def written(spark, folder: str, name: str = "rows") -> DataFrame:
    """All rows of all batches, with their batch number."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of its last batch: what a sink that updates in place would hold."""
    others = [c for c in rows.columns if c not in (*keys, BATCH)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), BATCH).alias("r"))
    return best.select(*keys, "r.*")
