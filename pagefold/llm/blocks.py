"""Blocks of documents as a bucketed table in the shared folder.

Several operators look at every text more than once: first to send hashes out, later to
act on what came back. ``pack`` writes the rows once, some megabytes of text per row, as
compressed Arrow bytes, bucketed by block number. What the later passes get back is keyed
by block number too, so joining it shuffles only the returned bits; the texts stay where
they are. The written table also cuts the lineage: a lost executor costs a re-read.

A row is known by ``ref = block << 20 | place in block``, whatever its columns hold, so
repeated or null ids need no special treatment here.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.words import give_back, text_buffer
from pagefold.session import checkpoint_dir

BLOCK_BYTES = 4 << 20
PLACE_BITS = 20
SCHEMA = "block long, rows int, bytes long, payload binary"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def encode_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode_batch(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as src:
        return src.read_next_batch()


def cut(batch: pa.RecordBatch, text_col: str, target: int):
    """Slices of a batch with about ``target`` bytes of text; a longer text is one slice."""
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + target, "right")) - 1
        j = min(max(j, i + 1), n, i + (1 << PLACE_BITS))
        yield batch.slice(i, j - i), int(offs[j] - offs[i])
        i = j


def _packer(text_col: str, target: int):
    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_pydict(
                {"block": [part << 22 | seq], "rows": [whole.num_rows], "bytes": [size],
                 "payload": [encode_batch(whole)]},
                schema=pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("bytes", pa.int64()),
                                  ("payload", pa.binary())]))
            seq, held, size = seq + 1, [], 0
            give_back()
            return out

        for batch in batches:
            for piece, n in cut(batch, text_col, target):
                if held and (size + n > target or sum(b.num_rows for b in held) + piece.num_rows >= 1 << PLACE_BITS):
                    yield flush()
                held.append(piece)
                size += n
        if held:
            yield flush()
    return run


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Blocks:
    """A packed table. ``release()`` deletes its files; otherwise that happens at exit."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame, schema):
        self.spark, self.path, self.df, self.schema = spark, path, df, schema
        totals = df.agg(F.sum("bytes"), F.sum("rows")).first()
        self.bytes, self.rows = int(totals[0] or 0), int(totals[1] or 0)
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        sc = self.spark.sparkContext
        if getattr(sc, "_jsc", None) is not None and not sc._jsc.sc().isStopped():
            self.release()

    def release(self) -> None:
        atexit.unregister(self._at_exit)
        remove_folder(self.spark, self.path)

    def visit(self, fn, schema, returned: DataFrame | None = None) -> DataFrame:
        """``fn(block, batch, returned value or None)`` yields record batches of ``schema``.
        ``returned`` has one row per block: (block, back)."""
        table = self.df.select("block", "payload")
        if returned is not None:
            table = table.join(returned.select("block", "back").hint("shuffle_hash"), "block", "left")

        def run(batches):
            for b in batches:
                back = b.column("back") if "back" in b.schema.names else None
                for i in range(b.num_rows):
                    yield from fn(b.column("block")[i].as_py(), decode_batch(b.column("payload")[i].as_py()),
                                  back[i].as_py() if back is not None else None)
                    give_back()
        return table.mapInArrow(run, schema)


def pack(df: DataFrame, text_col: str, target: int = BLOCK_BYTES) -> Blocks:
    """Write all rows and columns of ``df`` as blocks under ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    name = f"llm_blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    (df.mapInArrow(_packer(text_col, target), SCHEMA)
       .write.format("parquet").option("path", path).option("compression", "none")
       .bucketBy(min(shuffle_partitions(spark), 100_000), "block").saveAsTable(name))
    table = spark.table(name)
    table.schema  # resolve before the catalog entry goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return Blocks(spark, path, table, df.schema)


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def per_block(df: DataFrame, *cols: str) -> DataFrame:
    """(block, back): what belongs to each block, as one array of structs."""
    return df.groupBy("block").agg(F.collect_list(F.struct(*cols)).alias("back"))
