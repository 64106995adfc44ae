"""Which of a block's hashes occur anywhere else.

Each block sends a hash once, however often it holds it, with a bit that says whether it
holds it repeatedly: a hash that a third of all rows share costs one entry per block.
Entries travel as packed arrays, one row per (bucket, block); a bucket is a range of the
hash space, and the number of buckets follows the number of hashes. Back come bits, one
per entry in the order sent, so a block needs no hash again to read its answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagefold.llm.words import range_bucket

SENT = "bucket int, block long, hashes binary, more binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary())])
FOUND = "block long, bucket int, bits binary"
FOUND_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
BUCKET_HASHES = 1 << 20


def distinct(hi: np.ndarray, lo: np.ndarray | None):
    """Sorted distinct hashes, how many of each, and the place of every input among them.
    With ``lo`` the hash is the 128-bit pair."""
    if lo is None:
        u, inv, cnt = np.unique(hi, return_inverse=True, return_counts=True)
        return u, None, cnt, inv
    order = np.lexsort((lo, hi))
    h, l = hi[order], lo[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    place = np.cumsum(new) - 1
    inv = np.empty(len(h), np.int64)
    inv[order] = place
    starts = np.flatnonzero(new)
    return h[starts], l[starts], np.diff(np.append(starts, len(h))), inv


def send(block: int, hi: np.ndarray, lo: np.ndarray | None, cnt: np.ndarray, buckets: int):
    """Rows of SENT for sorted distinct hashes."""
    cuts = np.searchsorted(range_bucket(hi, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    if not len(full):
        return
    rows = {"bucket": [], "block": [], "hashes": [], "more": []}
    for b in full:
        s = slice(cuts[b], cuts[b + 1])
        rows["bucket"].append(int(b))
        rows["block"].append(block)
        rows["hashes"].append((hi[s] if lo is None else np.concatenate([hi[s], lo[s]])).tobytes())
        rows["more"].append(np.packbits(cnt[s] > 1).tobytes())
    yield pa.RecordBatch.from_pydict(rows, schema=SENT_ARROW)


def received(back, hi: np.ndarray, buckets: int) -> np.ndarray:
    """Bit per sorted distinct hash of the block: it occurs more than once overall."""
    out = np.zeros(len(hi), bool)
    if back:
        cuts = np.searchsorted(range_bucket(hi, buckets), np.arange(buckets + 1))
        for x in back:
            i, j = cuts[x["bucket"]], cuts[x["bucket"] + 1]
            out[i:j] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=j - i)
    return out


def _finder(wide: bool):
    def run(batches):
        keys, hi, lo, more = [], [], [], []
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column("hashes")[i].as_py(), np.uint64)
                if wide:
                    h, low = h[:len(h) // 2], h[len(h) // 2:]
                    lo.append(low)
                hi.append(h)
                more.append(np.unpackbits(np.frombuffer(b.column("more")[i].as_py(), np.uint8), count=len(h)))
                keys.append((b.column("block")[i].as_py(), b.column("bucket")[i].as_py()))
        if not keys:
            return
        h, m = np.concatenate(hi), np.concatenate(more)
        lens = [len(x) for x in hi]
        if wide:
            low = np.concatenate(lo)
            order = np.lexsort((low, h))
            a, c = h[order], low[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        else:
            order = np.argsort(h, kind="stable")
            a = h[order]
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(a))) + np.maximum.reduceat(m[order], starts)
        again = np.empty(len(a), bool)
        again[order] = np.repeat(times > 1, np.diff(np.append(starts, len(a))))
        at = 0
        for (block, bucket), n in zip(keys, lens):
            bits = again[at:at + n]
            at += n
            if bits.any():
                yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [bucket],
                                                  "bits": [np.packbits(bits).tobytes()]}, schema=FOUND_ARROW)
    return run


def find(sent: DataFrame, buckets: int, wide: bool) -> DataFrame:
    """Rows of SENT from all blocks -> rows of FOUND for blocks that hold a repeated hash."""
    return sent.repartition(buckets, "bucket").mapInArrow(_finder(wide), FOUND)


def bucket_count(entries: float, partitions: int) -> int:
    """As many buckets as keep each to about a million entries, and as many as the shuffle has partitions where
    there is work for them."""
    return max(int(entries / BUCKET_HASHES) + 1, min(partitions, int(entries / (1 << 15)) + 1))
