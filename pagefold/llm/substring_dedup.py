"""Substring dedup with difference-cover anchors.

A window of ``window_words`` consecutive words is repeated when its word sequence also
starts anywhere else, in the same or another document. Every word under a repeated window
is removed; windows are judged on the input.

Method: let D be a difference cover modulo v. For any two positions i, j some shift d < v
puts both i+d and j+d on cover positions, so two equal windows share an aligned anchor of
``window_words - v + 1`` words that starts at a cover position in both. Only those anchors
(|D| of v positions) are hashed and compared across the corpus. Around anchors that occur
more than once the match is extended: the full windows that hold such an anchor in reach
are compared by 128-bit hashes, and only windows found twice count.

Passes: pack the rows into blocks; send anchor hashes, get bits back; send the window
hashes of the extensions, get bits back; rewrite the texts. Texts are not shuffled. A hash
is sent once per block whatever its count, so a passage in a third of all rows costs one
entry per block.

Defined results: null text has no words and stays without kept text (empty string); an
empty text likewise; a repeated row is a repetition like any other, whatever its ids; an
empty table gives no rows; columns named like the new ones are replaced, all others pass.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagefold.llm import blocks, repeats
from pagefold.llm.words import byte_values, hashed_words, in_document, make_room, space_rule, window_hashes

WINDOW_WORDS = 35
#: Perfect difference sets: every residue modulo v is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves the anchor two fifths of the window or more."""
    v = max(v for v in COVERS if v == 1 or window - v + 1 >= 0.4 * window)
    return v, COVERS[v]


class _Words:
    """Word hashes of one block, with the places of anchors and windows in it."""

    def __init__(self, texts, window: int):
        self.window = window
        make_room()
        self.h, self.offs = hashed_words(texts, space_rule(), byte_values(lower=False))
        self.n = np.diff(self.offs)
        doc = in_document(self.offs, len(self.h))
        self.place = np.arange(len(self.h)) - self.offs[doc]
        self.left = self.n[doc] - self.place  # words from here to the document's end

    def anchors(self, v: int, cover: tuple[int, ...]):
        """(word index, hash) of each anchor inside a document that holds a window."""
        size = self.window - v + 1
        full = window_hashes(self.h, size)
        m = len(full)
        on = np.zeros(v, bool)
        on[list(cover)] = True
        ok = on[self.place[:m] % v] & (self.left[:m] >= size) & (self.place[:m] + self.left[:m] >= self.window)
        at = np.flatnonzero(ok)
        return at, full[at]

    def extensions(self, at: np.ndarray, v: int):
        """Start positions of the windows that hold one of these anchors within v words."""
        step = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(step, at - np.minimum(self.place[at], v - 1), 1)
        np.add.at(step, at + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= self.window))

    def windows(self, starts: np.ndarray):
        return (window_hashes(self.h, self.window, 1)[starts], window_hashes(self.h, self.window, 2)[starts])

    def covered(self, starts: np.ndarray) -> np.ndarray:
        step = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def dedup_substrings(df: DataFrame, text_col: str = "text", window_words: int = WINDOW_WORDS,
                     block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` (long) and ``kept_text`` (kept words joined by one space)."""
    if window_words < 2:
        raise ValueError("window_words must be 2 or more")
    new = ("n_words", "n_removed", "kept_text")
    df = df.drop(*new)
    packed = blocks.pack(df, text_col, block_bytes)
    v, cover = cover_for(window_words)
    parts = blocks.shuffle_partitions(df.sparkSession)
    words = packed.bytes / 6  # only sizes the buckets
    b1 = repeats.bucket_count(words * len(cover) / v, parts)
    b2 = repeats.bucket_count(words / 2, parts)

    def texts_of(batch):
        return batch.column(batch.schema.get_field_index(text_col))

    def send_anchors(block, batch, _):
        at, h = _Words(texts_of(batch), window_words).anchors(v, cover)
        u, _, cnt, _ = repeats.distinct(h, None)
        yield from repeats.send(block, u, None, cnt, b1)

    def extended(block, batch, back):
        """Words, and start and hashes of the windows around repeated anchors."""
        w = _Words(texts_of(batch), window_words)
        at, h = w.anchors(v, cover)
        u, _, _, inv = repeats.distinct(h, None)
        starts = w.extensions(at[repeats.received(back, u, b1)[inv]], v)
        return w, starts, repeats.distinct(*w.windows(starts)) if len(starts) else None

    def send_windows(block, batch, back):
        if back:
            _, _, found = extended(block, batch, back)
            if found:
                yield from repeats.send(block, found[0], found[1], found[2], b2)

    out_schema = T.StructType(packed.schema.fields + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType())])
    arrow = to_arrow_schema(out_schema)

    def rewrite(block, batch, back):
        texts = texts_of(batch)
        gone, offs = None, None
        first = [x for x in back or () if x["phase"] == 1]
        second = [x for x in back or () if x["phase"] == 2]
        if second:
            w, starts, (hi, _, _, inv) = extended(block, batch, first)
            gone, offs = w.covered(starts[repeats.received(second, hi, b2)[inv]]), w.offs
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(texts):
            got = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(got))
            drop = gone[offs[i]:offs[i + 1]] if gone is not None else None
            if drop is not None and drop.any():
                got = list(compress(got, ~drop))
            n_removed.append(n_words[-1] - len(got))
            kept.append(b" ".join(got).decode("utf-8", "surrogatepass"))
        columns = list(batch.columns) + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                         pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    from pyspark.sql import functions as F
    one = blocks.saved(repeats.find(packed.visit(send_anchors, repeats.SENT), b1, wide=False))
    two = blocks.saved(repeats.find(packed.visit(send_windows, repeats.SENT, blocks.per_block(one, "bucket", "bits")),
                                    b2, wide=True))
    both = one.withColumn("phase", F.lit(1)).unionByName(two.withColumn("phase", F.lit(2)))
    return packed.visit(rewrite, out_schema, blocks.per_block(both, "phase", "bucket", "bits"))
