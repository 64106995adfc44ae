"""Spark session and checkpoint helpers.

Library code never builds its own session; it receives one. ``get_session`` is
for tests, the bench and command-line use. Sizes here are local-mode defaults;
on a cluster the submitter's settings win because ``getOrCreate`` reuses the
active session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages can be megabytes each: keep Arrow batches small so a batch of raw
    # HTML plus its parse tree stays far below the Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.python.worker.reuse": "true",
    # URL expressions are large trees; inferring IsNotNull constraints over them costs planning time and adds no
    # filter the scan could use. Only sessions built here get this, never one that is handed in.
    "spark.sql.constraintPropagation.enabled": "false",
    # checkpoint files go when the frame that reads them is collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "pagefold", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("PAGEFOLD_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("PAGEFOLD_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset and
    the master is local (tests, bench) do we create a private folder; on a
    cluster an unset value is an error, because a machine-local folder would be
    lost together with the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running "
                               "iterative operators on a cluster")
        configured = tempfile.mkdtemp(prefix="pagefold-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data is written to the shared checkpoint folder,
    so a lost executor does not force recomputation of earlier loop rounds."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
