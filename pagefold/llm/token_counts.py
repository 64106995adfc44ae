"""Token counts without token ids.

1. Every block sends the distinct pre-tokens of its texts, once each.
2. Pre-tokens meet by hash range; each distinct one is cut into pieces once, and only the
   number of its pieces goes back to the blocks that hold it.
3. In the block those numbers join the pre-token frequencies of each document and are summed.

A pre-token in every document costs one entry per block, and texts are not shuffled. Special
tokens inside a text count one each, as the library takes them by default.

Defined results: null counts like the empty text (0 bytes, 0 tokens); repeated rows count
alike; texts of any length are counted whole; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagefold.llm import blocks
from pagefold.llm.bpe import Tokenizer, in_worker, load
from pagefold.llm.repeats import bucket_count
from pagefold.llm.words import hashed_words, byte_values, range_bucket, space_rule

SENT = "bucket int, block long, pretokens string"
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("pretokens", pa.string())])
COUNTED = "block long, bucket int, pieces binary"
_COUNTED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("pieces", pa.binary())])


def _frequencies(tok: Tokenizer, texts):
    """Per text its pre-tokens with their frequencies, and its special tokens."""
    rows = []
    for t in texts:
        pretokens, special = [], 0
        for token, raw in tok.parts(t.as_py() or ""):
            if token is None:
                pretokens += tok.pretokens(raw)
            else:
                special += 1
        rows.append((Counter(pretokens), special))
    return rows


def _distinct(rows, buckets: int) -> tuple[list[str], np.ndarray]:
    """The block's distinct pre-tokens in order of bucket and first use, and their buckets."""
    names = list(dict.fromkeys(chain.from_iterable(r[0] for r in rows)))
    h, offs = hashed_words(pa.array(names, pa.string()), space_rule(), byte_values(lower=False))
    bucket = range_bucket(h[offs[:-1]], buckets) if names else np.zeros(0, np.int64)
    order = np.argsort(bucket, kind="stable")
    return [names[i] for i in order.tolist()], bucket[order]


def _counter(data):
    def run(batches):
        tok, pieces = in_worker(data), {}
        for b in batches:
            for i in range(b.num_rows):
                names = b.column("pretokens")[i].as_py().split(" ")
                for p in names:
                    if p not in pieces:
                        pieces[p] = len(tok.ids(p))
                counts = np.array([pieces[p] for p in names], np.uint32)
                wide = counts.max() > 255
                yield pa.RecordBatch.from_pydict(
                    {"block": [b.column("block")[i].as_py()], "bucket": [b.column("bucket")[i].as_py()],
                     "pieces": [(counts if wide else counts.astype(np.uint8)).tobytes()]}, schema=_COUNTED)
    return run


def token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text",
                 block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``df`` with ``n_bytes`` (of the text as UTF-8) and ``n_tokens``."""
    df = df.drop("n_bytes", "n_tokens")
    spark = df.sparkSession
    packed = blocks.pack(df, text_col, block_bytes)
    buckets = bucket_count(packed.bytes / 50, blocks.shuffle_partitions(spark))
    data = spark.sparkContext.broadcast(load(tokenizer_path))  # a file of fixed size

    def texts_of(batch):
        return batch.column(batch.schema.get_field_index(text_col))

    def send(block, batch, _):
        names, bucket = _distinct(_frequencies(in_worker(data), texts_of(batch)), buckets)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        if len(full):
            yield pa.RecordBatch.from_pydict(
                {"bucket": full, "block": [block] * len(full),
                 "pretokens": [" ".join(names[cuts[b]:cuts[b + 1]]) for b in full]}, schema=_SENT)

    schema = T.StructType(packed.schema.fields + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    arrow = to_arrow_schema(schema)

    def add_up(block, batch, back):
        texts = texts_of(batch)
        rows = _frequencies(in_worker(data), texts)
        names, bucket = _distinct(rows, buckets)
        pieces, at = {}, np.searchsorted(bucket, np.arange(buckets + 1))
        for x in back or ():
            own = names[at[x["bucket"]]:at[x["bucket"] + 1]]
            counts = np.frombuffer(x["pieces"], np.uint8 if len(x["pieces"]) == len(own) else np.uint32)
            pieces.update(zip(own, counts.tolist()))
        tokens = [sum([n * pieces[p] for p, n in found.items()]) + special for found, special in rows]
        size = [len((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts]
        cols = [*batch.columns, pa.array(size, pa.int64()), pa.array(tokens, pa.int64())]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    counted = blocks.saved(packed.visit(send, SENT).repartition(buckets, "bucket").mapInArrow(_counter(data), COUNTED))
    return packed.visit(add_up, schema, blocks.per_block(counted, "bucket", "pieces"))
