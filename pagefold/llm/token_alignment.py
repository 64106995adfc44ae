"""Alignment of two tokenizers' ids over a corpus.

A text's tokens of both tokenizers cover the same bytes (a space and the text). Byte offsets
where a token of each ends cut them into groups; all tokens of one side of a group are linked
with all of the other. How strong a link of two ids is, the corpus says: the number of
documents that hold it.

1. Documents are encoded and aligned once; what stays is their ids, in blocks.
2. Every block sends its distinct linked pairs, with the number of its documents that hold
   each, to the pairs' segments (``SEGMENTS`` ranges of a hash).
3. A segment's distinct pairs get a minimal perfect hash: levels of bit arrays, about three
   bits a pair. Its number is the pair's place in a dense vector of counts. Tasks add up
   vectors of their share of the blocks, the vectors of a segment are summed after that.
4. Blocks ask for their pairs again: hash, check against the pair kept at that place, read
   the count. The answer goes back to the block, which is aligned anew from its ids.

What meets in a task is streamed, sorted by segment: besides the row at hand it holds one
segment's hash and vector. A segment has |A| * |B| / SEGMENTS pairs at most, 26 million for
vocabularies of 50,257 and 32,000. A pair in every document costs an entry per block. The
only thing that all tasks get is the highest count per A id, bounded by the vocabulary.

Defined results: texts that are null, empty, or that one of the tokenizers does not give
back byte by byte have no tokens (zeros, empty digest); repeated rows count as documents of
their own; null and repeated ids need no care; a group of any size is linked whole, counted
by distinct ids; texts of any length are encoded whole; columns named like the new ones are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagefold.llm import blocks
from pagefold.llm.bpe import byte_characters
from pagefold.llm.words import give_back, mix, range_bucket, worker_store

SEGMENTS = 64
#: Text encoded at a time, and ids in a block, in bytes.
ENCODE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
#: Links spelt out at a time; a group of more than ``WIDE`` is counted by distinct ids.
LINKS = 1 << 20
WIDE = 64
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_U = np.uint64
#: Texts of ASCII without control characters and of letters from U+00C0 to U+017F, in which the classes of the byte-level
#: pattern are plain: letters, digits, white space, the rest.
PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u017f]*\\Z").match
#: Runs that go to the library whatever they hold: some versions of the fast encoder take the square of their length.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
#: How a byte-level file without a pattern of its own cuts texts, fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """The two tokenizers, with the bytes of every id."""

    def __init__(self, a_file: str, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        # the same merges by rank: ids are in the order of the merges, and every entry is what its own bytes merge to
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.fast = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL, special_tokens={}, mergeable_ranks={
            self.a_bytes[i]: i for s, i in vocab.items() if s not in special})
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else
                        self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_b = len(self.b_bytes)
        if len(self.a_bytes) * self.size_b >= 1 << 32:
            raise ValueError("a pair of ids must fit 32 bits")
        self.kind = "<u2" if max(len(self.a_bytes), self.size_b) <= 1 << 16 else "<u4"  # of the ids in blocks
        self.len_a = np.array([len(x) for x in self.a_bytes], np.int64)
        self.len_b = np.array([len(x) for x in self.b_bytes], np.int64)
        # ids as text, with what follows them inside a group and at the end of one side of it
        self.shown = np.array([f"{i}{s}".encode() for i in range(len(self.a_bytes)) for s in ",|"]
                              + [f"{i}{s}".encode() for i in range(self.size_b) for s in ",;"], object)

    def _a_ids(self, text: str) -> list[int]:
        if PLAIN(text) and LONG_RUN.search(text) is None:
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Packed ids of both tokenizers."""
        out = []
        for t, y in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            x, want = self._a_ids(" " + t) if t else [], b" " + (t or "").encode()
            same = t and b"".join([self.a_bytes[i] for i in x]) == want and b"".join([self.b_bytes[i] for i in y]) == want
            out.append((np.array(x, self.kind).tobytes(), np.array(y, self.kind).tobytes()) if same else (b"", b""))
        return out


class Aligned:
    """Groups of a block of documents, from their ids."""

    def __init__(self, pair: Pair, a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray):
        self.pair, self.a, self.b, self.a_offs, self.b_offs = pair, a, b, a_offs, b_offs
        ends_a, ends_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
        self.common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(self.common, ends_a), np.searchsorted(self.common, ends_b)
        n = len(self.common)
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.first_a, self.first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        # a document's groups are those up to its last token
        done = np.concatenate([[0], self.group_a + 1]) if len(a) else np.zeros(1, np.int64)
        self.g_offs = done[a_offs]

    def _per_document(self, per_group: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(per_group)])[self.g_offs])

    def counts(self):
        """(tokens of A, of B, groups, links) per document."""
        return np.diff(self.a_offs), np.diff(self.b_offs), np.diff(self.g_offs), self._per_document(self.size_a * self.size_b)

    def digests(self) -> list[str]:
        """Of ``a1,a2|b1;a3|b2,b3``; empty for a document without tokens."""
        n_a, n_b = len(self.a), len(self.b)
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True) if n_a else np.zeros(0, bool)
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True) if n_b else np.zeros(0, bool)
        code = np.empty(n_a + n_b, np.int64)
        code[np.arange(n_a) + self.first_b[self.group_a]] = self.a.astype(np.int64) * 2 + last_a
        code[np.arange(n_b) + (self.first_a + self.size_a)[self.group_b]] = (self.b.astype(np.int64) + len(self.pair.a_bytes)) * 2 + last_b
        cuts, out = self.a_offs + self.b_offs, []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out.append(hashlib.sha256(b"".join(self.pair.shown[code[s:e]].tolist())[:-1]).hexdigest() if e > s else "")
        return out

    def _spelt(self, s: int, e: int):
        """(document, pair, times) of the groups s to e of few links: each token of A with the tokens of B."""
        i = np.arange(self.first_a[s], self.first_a[e - 1] + self.size_a[e - 1])
        i = i[(self.size_a * self.size_b)[self.group_a[i]] <= WIDE]
        g = self.group_a[i]
        times = self.size_b[g]
        at = np.repeat(self.first_b[g] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        key = np.repeat(self.a[i].astype(np.uint64), times) * _U(self.pair.size_b) + self.b[at]
        doc = np.searchsorted(self.g_offs, g, "right") - 1
        return np.repeat(doc, times), key

    def links(self):
        """(document, pair, times) of all links, a pair once per document, by document and pair."""
        n = len(self.common)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        each = self.size_a * self.size_b
        narrow = np.concatenate([[0], np.cumsum(np.where(each <= WIDE, each, 0))])
        found, s = [], 0
        while s < n:
            e = max(s + 1, int(np.searchsorted(narrow, narrow[s] + LINKS, "right")) - 1)
            doc, key = self._spelt(s, min(e, n))
            found.append(_counted(doc, key, np.ones(len(key), np.int64)))
            s = e
        wide = np.flatnonzero(each > WIDE)
        held: list = []
        for g in wide.tolist():
            a, n_a = np.unique(self.a[self.first_a[g]:self.first_a[g] + self.size_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[self.first_b[g]:self.first_b[g] + self.size_b[g]], return_counts=True)
            key = (a.astype(np.uint64)[:, None] * _U(self.pair.size_b) + b[None]).ravel()
            doc = int(np.searchsorted(self.g_offs, g, "right")) - 1
            held.append((np.full(len(key), doc), key, (n_a[:, None] * n_b[None]).ravel()))
            if sum(len(x[1]) for x in held) > LINKS or len(held) > 4096:
                found.append(_counted(*map(np.concatenate, zip(*held))))
                held = []
        if held:
            found.append(_counted(*map(np.concatenate, zip(*held))))
        return found[0] if len(found) == 1 else _counted(*map(np.concatenate, zip(*found)))


def _counted(doc, key, times):
    """Sums of ``times`` by (document, pair), in that order."""
    both = doc.astype(np.uint64) << _U(32) | key
    order = np.argsort(both, kind="stable")
    both, times = both[order], times[order]
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    both = both[starts]
    return (both >> _U(32)).astype(np.int64), both & _U(0xFFFFFFFF), np.add.reduceat(times, starts) if len(starts) else times


def _segment(key: np.ndarray) -> np.ndarray:
    return range_bucket(mix(key + _U(1)), SEGMENTS)


def _by_segment(key: np.ndarray):
    """Distinct pairs ordered by segment and pair, where each segment's begin."""
    u = np.unique(key)
    seg = _segment(u)
    order = np.argsort(seg, kind="stable")
    return u[order], np.searchsorted(seg[order], np.arange(SEGMENTS + 1))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys. At each level a key that has a bit of the level's array for itself gets
    it; the others go on to the next. The number is the rank of the bit; the few keys left after ``LEVELS`` are listed."""

    LEVELS = 24

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ _U((level + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(cls.LEVELS):
            if not len(keys):
                break
            size = 2 * len(keys) + 1
            place = cls._place(keys, level, size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *bits]), np.sort(keys))

    def __len__(self):
        return int(self.rank[-1]) + len(self.rest)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Of keys that were not hashed, any number."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                return out
            place = self._place(keys[left], level, size) + self.starts[level]
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            out[left] = self.rank[-1] + np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.rest), *self.sizes], np.int64)
        return head.tobytes() + self.rest.astype(np.uint64).tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n, m = np.frombuffer(data, np.int64, 2).tolist()
        sizes = np.frombuffer(data, np.int64, n, 16)
        rest = np.frombuffer(data, np.uint64, m, 16 + 8 * n)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=16 + 8 * (n + m)), count=int(sizes.sum())).astype(bool)
        return cls(sizes, bits, rest)


class Segment:
    """A segment's hash, the pair kept at each number, and its counts."""

    def __init__(self, hashed: bytes, pairs: bytes, counts: bytes | None):
        self.hash, self.pairs = PerfectHash.from_bytes(hashed), np.frombuffer(pairs, np.uint32)
        self.counts = np.zeros(len(self.pairs), np.int64) if counts is None else np.frombuffer(counts, np.int64)

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        at = self.hash.numbers(pairs.astype(np.uint64))
        if not np.array_equal(self.pairs[at], pairs):
            raise RuntimeError("a pair is not in its segment's hash")
        return at


SENT = "seg int, share int, block long, pairs binary, docs binary"
HASHED = "seg int, hashed binary, pairs binary"


def _grouped(batches, *keys):
    """(key, rows) per run of equal keys; the rows are read one by one."""
    def rows():
        for b in batches:
            names = b.schema.names
            for i in range(b.num_rows):
                yield {n: b.column(k)[i].as_py() for k, n in enumerate(names)}
    return groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


def _union(pairs) -> np.ndarray:
    """Distinct pairs of a stream of arrays, merged when as many have come as are held."""
    held, fresh, n = np.zeros(0, np.uint32), [], 0
    for p in pairs:
        fresh.append(p)
        n += len(p)
        if n > max(len(held), 1 << 18):
            held, fresh, n = np.unique(np.concatenate([held, *fresh])), [], 0
    return np.unique(np.concatenate([held, *fresh]))


def _hash_segments(sent: DataFrame, tasks: int) -> DataFrame:
    """HASHED rows from all SENT rows: shares of a segment first, then the segment."""
    def share(batches):
        for (seg, s), rows in _grouped(batches, "seg", "share"):
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "pairs": [_union(np.frombuffer(r["pairs"], np.uint32) for r in rows).tobytes()]})

    def whole(batches):
        for (seg,), rows in _grouped(batches, "seg"):
            keys = _union(np.frombuffer(r["pairs"], np.uint32) for r in rows)
            hashed = PerfectHash.build(keys.astype(np.uint64))
            kept = np.empty(len(keys), np.uint32)
            kept[hashed.numbers(keys.astype(np.uint64))] = keys
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "hashed": [hashed.to_bytes()], "pairs": [kept.tobytes()]})
            give_back()
    shares = (sent.select("seg", "share", "pairs").repartition(tasks, "seg", "share").sortWithinPartitions("seg", "share")
              .mapInArrow(share, "seg int, pairs binary"))
    return shares.repartition(SEGMENTS, "seg").sortWithinPartitions("seg").mapInArrow(whole, HASHED)


def _with_segments(sent: DataFrame, segments: DataFrame, shares: int, tasks: int) -> DataFrame:
    """Rows of every (segment, share), the segment's own row before the blocks'."""
    own = segments.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("block", F.lit(-1).cast("long"))
    rows = sent.unionByName(own, allowMissingColumns=True)
    return rows.repartition(tasks, "seg", "share").sortWithinPartitions("seg", "share", "block")


def _count(sent: DataFrame, hashed: DataFrame, shares: int, tasks: int) -> DataFrame:
    """(seg, counts): documents per pair, at the pair's number."""
    def share(batches):
        for (seg, _), rows in _grouped(batches, "seg", "share"):
            own = next(rows)
            segment = Segment(own["hashed"], own["pairs"], None)
            for r in rows:
                segment.counts[segment.numbers(np.frombuffer(r["pairs"], np.uint32))] += np.frombuffer(r["docs"], np.uint32)
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "counts": [segment.counts.tobytes()]})

    def whole(batches):
        for (seg,), rows in _grouped(batches, "seg"):
            total = None
            for r in rows:
                c = np.frombuffer(r["counts"], np.int64)
                total = c.copy() if total is None else np.add(total, c, out=total)
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "counts": [total.tobytes()]})
    return (_with_segments(sent, hashed, shares, tasks).mapInArrow(share, "seg int, counts binary")
            .repartition(SEGMENTS, "seg").sortWithinPartitions("seg").mapInArrow(whole, "seg int, counts binary"))


def _answers(sent: DataFrame, counted: DataFrame, shares: int, tasks: int) -> DataFrame:
    """(block, seg, counts): the counts of the pairs that a block sent to a segment."""
    def run(batches):
        for (seg, _), rows in _grouped(batches, "seg", "share"):
            own = next(rows)
            segment = Segment(own["hashed"], own["pairs"], own["counts"])
            for r in rows:
                found = segment.counts[segment.numbers(np.frombuffer(r["pairs"], np.uint32))]
                yield pa.RecordBatch.from_pydict({"block": [r["block"]], "seg": pa.array([seg], pa.int32()), "counts": [found.tobytes()]})
    rows = _with_segments(sent.select("seg", "share", "block", "pairs"), counted, shares, tasks)
    return rows.mapInArrow(run, "block long, seg int, counts binary")


class Alignment:
    """Aligned documents and the counts of their linked pairs."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES):
        self.spark = spark = docs.sparkSession
        with open(a_path, encoding="utf-8") as f:
            a_file = f.read()
        with open(b_path, "rb") as f:
            b_file = f.read()
        self.files = files = spark.sparkContext.broadcast((a_file, b_file))  # two files of fixed size
        docs = docs.drop(*COLUMNS, "a_ids", "b_ids")
        schema = T.StructType([*(f for f in docs.schema.fields if f.name != text_col),
                               *(T.StructField(n, T.BinaryType()) for n in ("a_ids", "b_ids"))])
        arrow = to_arrow_schema(schema)

        def encode(batches):
            pair = _in_worker(files)
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                for piece, _ in blocks.cut(batch, text_col, ENCODE_BYTES):
                    got = pair.encode(piece.column(at).to_pylist())
                    cols = [c for i, c in enumerate(piece.columns) if i != at]
                    cols += [pa.array([x[k] for x in got], pa.binary()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
        self.blocks = blocks.pack(docs.mapInArrow(encode, schema), "a_ids", block_bytes)
        self.tasks = max(SEGMENTS, blocks.shuffle_partitions(spark))
        self.shares = shares = max(1, -(-self.tasks // SEGMENTS))

        def send(block, batch, _):
            aligned = _aligned(_in_worker(files), batch)
            _, key, _ = aligned.links()
            u, cuts = _by_segment(key)
            place = np.empty(len(u), np.int64)
            order = np.argsort(u)
            place[order] = np.arange(len(u))
            docs_of = np.bincount(np.searchsorted(u[order], key), minlength=len(u))[place]
            full = np.flatnonzero(np.diff(cuts))
            if len(full):
                yield pa.RecordBatch.from_pydict({
                    "seg": pa.array(full, pa.int32()), "share": pa.array([hash((block, 7)) % shares] * len(full), pa.int32()), "block": [block] * len(full),
                    "pairs": [u[cuts[s]:cuts[s + 1]].astype(np.uint32).tobytes() for s in full],
                    "docs": [docs_of[cuts[s]:cuts[s + 1]].astype(np.uint32).tobytes() for s in full]})
        self.sent = blocks.saved(self.blocks.visit(send, SENT))
        self.hashed = blocks.saved(_hash_segments(self.sent, self.tasks))
        self.counted = blocks.saved(self.hashed.join(_count(self.sent, self.hashed, shares, self.tasks).hint("shuffle_hash"), "seg"))

    def _pairs(self, schema: str, fn) -> DataFrame:
        files = self.files

        def run(batches):
            size_b = _in_worker(files).size_b
            for b in batches:
                for i in range(b.num_rows):
                    pairs = np.frombuffer(b.column("pairs")[i].as_py(), np.uint32).astype(np.int64)
                    yield fn(pairs // size_b, pairs % size_b, np.frombuffer(b.column("counts")[i].as_py(), np.int64))
        return self.counted.select("pairs", "counts").mapInArrow(run, schema)

    def pair_counts(self) -> DataFrame:
        """(a, b, n_docs) of every linked pair of ids."""
        return self._pairs("a long, b long, n_docs long", lambda a, b, n: pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n_docs"]))

    def highest(self) -> DataFrame:
        """(a, top): the highest count among the pairs of each A id."""
        def top(a, _, n):
            ids, inv = np.unique(a, return_inverse=True)
            most = np.zeros(len(ids), np.int64)
            np.maximum.at(most, inv, n)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most)], names=["a", "top"])
        return self._pairs("a long, top long", top).groupBy("a").agg(F.max("top").alias("top"))

    def documents(self, ids: bool = False) -> DataFrame:
        """The documents' other columns with COLUMNS, and with ``ids`` their token ids as packed 32-bit integers."""
        files = self.files
        tops = self.highest().collect()  # a row per A id at most
        top = np.zeros(max([r["a"] for r in tops], default=0) + 1, np.int64)
        for r in tops:
            top[r["a"]] = r["top"]
        held = self.spark.sparkContext.broadcast(top)
        kept = [f for f in self.blocks.schema.fields if ids or f.name not in ("a_ids", "b_ids")]
        schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COLUMNS[:-1]), T.StructField(COLUMNS[-1], T.StringType())])
        arrow = to_arrow_schema(schema)

        def finish(block, batch, back):
            pair, n = _in_worker(files), batch.num_rows
            aligned = _aligned(pair, batch)
            doc, key, times = aligned.links()
            u, cuts = _by_segment(key)
            counts = np.zeros(len(u), np.int64)
            for x in back or ():
                counts[cuts[x["seg"]]:cuts[x["seg"] + 1]] = np.frombuffer(x["counts"], np.int64)
            order = np.argsort(u)
            mine = counts[order][np.searchsorted(u[order], key)]
            best = mine == held.value[(key // _U(pair.size_b)).astype(np.int64)] if len(key) else np.zeros(0, bool)
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], doc[best], times[best])
            np.add.at(sums[1], doc, times * mine)
            cols = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("a_ids", "b_ids")]
            if ids:
                cols += [_packed(batch.column(i), pair.kind) for i, f in enumerate(batch.schema) if f.name in ("a_ids", "b_ids")]
            cols += [pa.array(c.astype(np.int64)) for c in (*aligned.counts(), *sums)] + [pa.array(aligned.digests(), pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
        answers = blocks.saved(_answers(self.sent, self.counted, self.shares, self.tasks))
        return self.blocks.visit(finish, schema, blocks.per_block(answers, "seg", "counts"))


def _aligned(pair: Pair, batch) -> Aligned:
    def side(name):
        col = batch.column(batch.schema.get_field_index(name))
        parts = [np.frombuffer(x.as_py(), pair.kind) for x in col]
        return np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return Aligned(pair, *side("a_ids"), *side("b_ids"))


def _packed(column, kind: str):
    return pa.array([np.frombuffer(x.as_py(), kind).astype("<u4").tobytes() for x in column], pa.binary())


def _in_worker(files) -> Pair:
    """The tokenizers of the broadcast files, opened once per Python worker."""
    store = worker_store()
    a, b = files.value
    key = f"pair_{hash(a)}_{hash(b)}"
    if not hasattr(store, key):
        setattr(store, key, Pair(a, b))
    return getattr(store, key)
