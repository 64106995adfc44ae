"""Quality classifier by importance resampling.

Word uni- and bigrams, as written, are hashed into ``BUCKETS`` counts, beside the counts of
trigrams that are new in their document and that it repeats. Two bag-of-n-grams models are
made: one of target text (labelled good documents) and one of all raw text. A document's
importance weight is the log ratio of its probability under the two. Gumbel noise is added
and the k largest sums are kept: a draw of k documents without replacement, in proportion to
their weights. k is the share of good documents among all labelled ones, unless given.

The raw model counts all documents; the target model is fitted on a bounded sample of
``SAMPLE`` labelled rows. The noise of a row comes from its id and a seed, so a rerun draws
the same rows. The cut between kept and other rows is the exact k-th largest sum, found on
the weights' 64-bit order by counting leading digits in four passes; no rows are sorted or
collected.

Defined results: null and empty texts have weight 0; rows that tie at the cut are all kept
(so repeated rows stay together); rows with equal id and text get equal sums; a null id has
noise of its own value; without good labels both models are the raw one, all weights are 0
and the draw is uniform; k beyond the rows keeps all; an empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagefold.llm import words as W
from pagefold.llm.blocks import saved

BUCKETS = 1 << 14
SAMPLE = 20_000
SEED = 7


def _grams(texts):
    """(bucket of every gram, its document, number of documents). Buckets 0 and 1 count the trigrams that are new in
    their document and those that it has held before; the others are hashed words and word pairs."""
    h, offs = W.hashed_words(texts, W.space_rule(), W.byte_values(lower=False))
    doc = W.in_document(offs, len(h))
    pairs, triples = W.window_hashes(h, 2), W.window_hashes(h, 3)
    in2 = np.flatnonzero(doc[:len(pairs)] == doc[1:len(pairs) + 1])
    in3 = np.flatnonzero(doc[:len(triples)] == doc[2:len(triples) + 2])
    again = np.ones(len(in3), np.int64)
    again[np.unique(W.mix(triples[in3] ^ W.mix(doc[in3].astype(np.uint64))), return_index=True)[1]] = 0
    hashed = np.concatenate([W.mix(h ^ np.uint64(1)), pairs[in2]]) % np.uint64(BUCKETS - 2)
    return np.concatenate([hashed.astype(np.int64) + 2, again]), np.concatenate([doc, doc[in2], doc[in3]]), len(offs) - 1


def _text(batch, name: str = "_text"):
    return batch.column(batch.schema.get_field_index(name))


def _parts(batch, name: str):
    """Slices of some megabytes of text."""
    _, offs = W.text_buffer(_text(batch, name))
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + (4 << 20), "right")) - 1), batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in _parts(batch, "_text"):
            total += np.bincount(_grams(_text(part))[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts per bucket over all rows of a one-column frame ``_text``."""
    out = np.zeros(BUCKETS, np.float64)
    for r in texts.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # BUCKETS rows at most
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log probability per bucket under the smoothed target model less that under the raw one."""
    if not target.any():
        return np.zeros(BUCKETS)
    share = raw + 1
    share /= share.sum()
    like = target + share * max(1.0, BUCKETS / 16)  # the raw model is the prior of the target's
    return np.log(like / like.sum()) - np.log(share)


def weigh(df: DataFrame, ratio: np.ndarray, text_col: str = "text", weight_col: str = "log_weight") -> DataFrame:
    df = df.drop(weight_col)
    schema = T.StructType(df.schema.fields + [T.StructField(weight_col, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    held = df.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            for part in _parts(batch, text_col):
                ids, doc, n = _grams(_text(part, text_col))
                cols = [*part.columns, pa.array(np.bincount(doc, held.value[ids], minlength=n))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return df.mapInArrow(run, schema)


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise from the hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def ordered_bits(value: float) -> int:
    """Unsigned 64-bit number that sorts like the value."""
    bits = struct.unpack(">Q", struct.pack(">d", value))[0]
    return bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63)


def _digits(batches):
    """Four 16-bit digits of each sum's place in the order of all doubles."""
    for batch in batches:
        bits = batch.column("sum").to_numpy(zero_copy_only=False).view(np.uint64)
        key = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
        cols = [pa.array(((key >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int32)) for s in (48, 32, 16, 0)]
        yield pa.RecordBatch.from_arrays(cols, names=["d0", "d1", "d2", "d3"])


def kth_largest(sums: DataFrame, k: int) -> float | None:
    """The exact k-th largest of the one column ``sum``; None if there are fewer rows."""
    left = saved(sums.mapInArrow(_digits, "d0 int, d1 int, d2 int, d3 int"))
    key = 0
    for i in range(4):
        counts = sorted(((r[f"d{i}"], r["n"]) for r in left.groupBy(f"d{i}").agg(F.count("*").alias("n")).collect()), reverse=True)
        for digit, n in counts:  # 65,536 at most
            if k <= n:
                break
            k -= n
        else:
            return None
        key = key << 16 | digit
        left = left.where(F.col(f"d{i}") == digit)
    bits = key ^ (1 << 63) if key >> 63 else key ^ 0xFFFFFFFFFFFFFFFF
    return struct.unpack(">d", struct.pack(">Q", bits))[0]


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             learn_from: Column | None = None, k: int | None = None, sample: int = SAMPLE, seed: int = SEED,
             keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``df`` with ``log_weight``, ``noisy_weight`` and ``kept``."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if learn_from is not None:
        usable = usable.where(learn_from)
    labelled = usable.groupBy(id_col).agg(F.max(label_col).alias("_y"))
    usable = labelled.orderBy(F.xxhash64(id_col), id_col).limit(sample).withColumnRenamed(id_col, "_id")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    good = texts.join(F.broadcast(usable.where("_y > 0")), "_id")  # ``sample`` rows at most
    raw = gram_counts(texts.select("_text"))
    ratio = log_ratio(gram_counts(good.select("_text")), raw)
    keep = [c for c in (keep or df.columns) if c not in ("log_weight", "noisy_weight", "kept")]
    scored = weigh(df.select(*dict.fromkeys([*keep, id_col, text_col])), ratio, text_col)
    scored = saved(scored.withColumn("noisy_weight", F.col("log_weight") + gumbel(id_col, seed))
                   .select(*dict.fromkeys([*keep, id_col]), "log_weight", "noisy_weight"))
    if k is None:
        rate = labelled.agg(F.avg((F.col("_y") > 0).cast("double"))).first()[0]
        k = round(scored.count() * (1.0 if rate is None else rate))
    cut = kth_largest(scored.select(F.col("noisy_weight").alias("sum")), k) if k > 0 else float("inf")
    kept = F.lit(True) if cut is None else F.col("noisy_weight") >= cut
    return scored.withColumn("kept", kept).select(*keep, "log_weight", "noisy_weight", "kept")
