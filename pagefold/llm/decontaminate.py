"""Benchmark decontamination over a positional inverted index.

``build_index`` stores the postings of every training token: the index is a Parquet table
of segments in the shared folder, a segment holding some megabytes of documents as sorted
terms, their counts and their positions (delta coded, compressed). A query reads each
segment once: windows with a term that the segment lacks are out at once; the others start
from the postings of their rarest term there, shifted by its offset, and are intersected
with the next rarest until all terms agree. ``phrase_hits`` gives the exact matches,
``near_hits`` those with all terms within some words of each other.

Test items reach the tasks in chunks of ``CHUNK_BYTES`` of text at most, one pass over the
index each, so what is broadcast is bounded whatever the size of the benchmark.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is 13
consecutive words of an item; a shorter item, unless empty, is one window.

Defined results: null or empty text has no words and no hits; a null or empty item has no
windows; repeated items count once by id; an item with a null id hits but is not listed;
rows that repeat an id are judged each by its own text; an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm import blocks
from pagefold.llm.words import alnum_rule, byte_values, hashed_words, make_room
from pagefold.session import checkpoint_dir

WINDOW_WORDS = 13
CHUNK_BYTES = 32 << 20
SEGMENT = "block long, docs binary, terms binary, n_terms int, counts binary, positions binary, n_positions int"
_SEGMENT = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("terms", pa.binary()), ("n_terms", pa.int32()),
                      ("counts", pa.binary()), ("positions", pa.binary()), ("n_positions", pa.int32())])


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    make_room()
    return hashed_words(texts, alnum_rule(), byte_values(lower=True))


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, then zstd."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), "zstd", asbytes=True)


def _spread(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def segment(block: int, batch: pa.RecordBatch, id_col: str, text_col: str) -> pa.RecordBatch:
    """The postings of a batch of documents."""
    h, offs = words_of(batch.column(batch.schema.get_field_index(text_col)))
    n = len(h)
    # leading bits of the term and the position in one word sort faster than an argsort
    bits = _bits(n)
    key = np.sort((h >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    at = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    term = h[at]
    if n and (term[1:] < term[:-1]).any():  # two terms that share the leading bits
        at = np.argsort(h, kind="stable")
        term = h[at]
    new = np.ones(n, bool)
    new[1:] = term[1:] != term[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, n)).astype(np.uint32)
    delta = np.diff(at.astype(np.uint32), prepend=np.uint32(0))  # wraps at each new term, as its sum does
    ids = batch.select([id_col])
    docs = pa.RecordBatch.from_arrays([ids.column(0), pa.array(np.diff(offs))], names=["id", "n_words"])
    return pa.RecordBatch.from_pydict(
        {"block": [block], "docs": [blocks.encode_batch(docs)], "terms": [term[starts].tobytes()],
         "n_terms": [len(starts)], "counts": [_squeeze(counts)], "positions": [_squeeze(delta)],
         "n_positions": [n]}, schema=_SEGMENT)


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


class Segment:
    """A stored segment, opened."""

    def __init__(self, row: dict):
        self.block = row["block"]
        docs = blocks.decode_batch(row["docs"])
        self.ids, self.n_words = docs.column(0), docs.column(1).to_numpy()
        self.offs = np.concatenate([[0], np.cumsum(self.n_words)]).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        counts = _spread(row["counts"], row["n_terms"], np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.at = np.cumsum(_spread(row["positions"], row["n_positions"], np.uint32), dtype=np.uint32).astype(np.int64)

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first posting, number of postings) of each term."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        have = self.terms[i] == terms
        return self.starts[i], np.where(have, self.starts[i + 1] - self.starts[i], 0)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1


class Phrases:
    """Distinct windows of the items of a chunk, as numbers of the chunk's sorted terms."""

    def __init__(self, items: list[tuple[object, str]], window: int | None):
        h, offs = words_of(pa.array([t for _, t in items], pa.string()))
        self.terms = np.unique(h)
        number = np.searchsorted(self.terms, h).astype(np.int32)
        found: dict[bytes, int] = {}
        owners: list[set[int]] = []
        for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
            size = int(b - a) if window is None else window
            for s in range(a, max(a + 1, b - size + 1)) if b > a else ():
                w = found.setdefault(number[s:min(s + size, b)].tobytes(), len(found))
                if w == len(owners):
                    owners.append(set())
                owners[w].add(i)
        longest = max((len(k) // 4 for k in found), default=1)
        self.words = np.full((len(found), longest), -1, np.int32)
        for k, w in found.items():
            self.words[w, :len(k) // 4] = np.frombuffer(k, np.int32)
        self.length = (self.words >= 0).sum(1)
        self.owners = [sorted(o) for o in owners]
        self.ids = [None if i is None else str(i) for i, _ in items]

    def matches(self, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, start position) of every occurrence inside one document."""
        first, count = seg.lookup(self.terms)
        none = np.zeros(0, np.int64)
        if not len(self.words):
            return none, none
        pad = self.words < 0
        alive = np.flatnonzero((pad | (count[self.words] > 0)).all(1))
        if not len(alive):
            return none, none
        words = self.words[alive]
        times = np.where(words < 0, np.iinfo(np.int64).max, count[words])
        order = np.argsort(times, axis=1, kind="stable")  # offsets of the terms, rarest first
        used = np.unique(words[words >= 0])
        lens = count[used]
        place = np.repeat(first[used] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        lists = np.repeat(used.astype(np.int64), lens) << 32 | seg.at[place]  # sorted by term, then position
        offset = order[:, 0]
        rare = words[np.arange(len(words)), offset]
        lens = count[rare]
        which = np.repeat(np.arange(len(words)), lens)
        place = np.repeat(first[rare] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        start = seg.at[place] - offset[which]
        ok = start >= 0
        which, start = which[ok], start[ok]
        for k in range(1, words.shape[1]):
            more = self.length[alive[which]] > k
            off = order[which, k]
            key = words[which, off].astype(np.int64) << 32 | (start + off)
            i = np.minimum(np.searchsorted(lists, key), len(lists) - 1)
            ok = ~more | (lists[i] == key)
            which, start = which[ok], start[ok]
            if not len(which):
                return none, none
        which = alive[which]
        doc = seg.document(start)
        ok = start + self.length[which] <= seg.offs[doc + 1]
        return which[ok], start[ok]

    def near(self, seg: Segment, slop: int):
        """(window, position of its rarest term) where each other term stands within ``slop`` words of it."""
        first, count = seg.lookup(self.terms)
        for w, row in enumerate(self.words):
            terms = np.unique(row[row >= 0])
            if not len(terms) or (count[terms] == 0).any():
                continue
            terms = terms[np.argsort(count[terms], kind="stable")]
            at = seg.at[first[terms[0]]:first[terms[0]] + count[terms[0]]]
            doc = seg.document(at)
            low, high = np.maximum(at - slop, seg.offs[doc]), np.minimum(at + slop + 1, seg.offs[doc + 1])
            ok = np.ones(len(at), bool)
            for t in terms[1:]:
                other = seg.at[first[t]:first[t] + count[t]]
                ok &= np.searchsorted(other, low) < np.searchsorted(other, high)
            for p in at[ok]:
                yield w, int(p)


class Index:
    """The stored index. ``release()`` deletes its files."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.df = spark, path, spark.read.schema(SEGMENT).parquet(path)

    def release(self) -> None:
        blocks.remove_folder(self.spark, self.path)

    def search(self, phrases: Phrases, fn, schema: str) -> DataFrame:
        """``fn(segment, phrases)`` yields record batches of ``schema``."""
        held = self.spark.sparkContext.broadcast(vars(phrases))

        def run(batches):
            phrases = Phrases.__new__(Phrases)
            vars(phrases).update(held.value)
            for b in batches:
                for row in b.to_pylist():
                    yield from fn(Segment(row), phrases)
        return self.df.mapInArrow(run, schema)


def _segments(id_col: str, text_col: str, target: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece, _ in blocks.cut(batch, text_col, target):
                yield segment(part << 22 | seq, piece, id_col, text_col)
                seq += 1
    return run


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_bytes: int = blocks.BLOCK_BYTES, packed: blocks.Blocks | None = None) -> Index:
    """Index every row of ``df``, or of a packed table whose block numbers the segments then carry."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm_index_{uuid.uuid4().hex}"
    if packed is None:
        rows = df.select(id_col, text_col).mapInArrow(_segments(id_col, text_col, segment_bytes), SEGMENT)
    else:
        rows = packed.visit(lambda block, batch, _: iter([segment(block, batch, id_col, text_col)]), SEGMENT)
    rows.write.option("compression", "none").parquet(path)
    return Index(spark, path)


def _chunks(items: DataFrame, id_col: str, text_col: str, chunk_bytes: int):
    """The items in lists of about ``chunk_bytes`` of text at most."""
    held = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // chunk_bytes) or 1
    for c in range(n):
        yield [(r["id"], r["text"]) for r in held.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == c).collect()]


def _hits(seg: Segment, phrases: Phrases):
    which, start = phrases.matches(seg)
    n = len(seg.ids)
    spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
    doc = seg.document(start)
    for d, w, s in zip(doc.tolist(), which.tolist(), start.tolist()):
        s -= int(seg.offs[d])
        spans[d].append({"s": s, "e": s + int(phrases.length[w])})
        items[d].update(phrases.ids[o] for o in phrases.owners[w])
    schema = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        ("items", pa.list_(pa.string()))])
    yield pa.RecordBatch.from_arrays([
        pa.array([seg.block] * n, pa.int64()), pa.array(np.arange(n)), seg.ids.cast(pa.int64()), pa.array(seg.n_words),
        pa.array(spans, schema.field("spans").type),
        pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.string()))], schema=schema)


HITS = "block long, place long, id long, n_words long, spans array<struct<s: long, e: long>>, items array<string>"


def phrase_hits(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                window_words: int = WINDOW_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per indexed document: block, place, id, n_words, n_hit (words inside any occurrence of a window),
    spans (start and end word of the occurrences), items (ids with an occurrence, sorted as strings)."""
    found = None
    for chunk in _chunks(items, item_col, text_col, chunk_bytes):
        part = index.search(Phrases(chunk, window_words), _hits, HITS)
        found = part if found is None else found.unionByName(part)
        several = found is not part
    if several:
        found = found.groupBy("block", "place").agg(
            F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = """aggregate(array_sort(spans), named_struct('n', 0L, 'e', 0L),
        (a, x) -> named_struct('n', a.n + greatest(0L, x.e - greatest(a.e, x.s)), 'e', greatest(a.e, x.e)), a -> a.n)"""
    return found.withColumn("n_hit", F.expr(union))


def near_hits(index: Index, items: DataFrame, slop: int, item_col: str = "item_id", text_col: str = "text",
              chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, item, word): documents where all words of a whole item stand within ``slop`` words of its rarest."""
    def fn(seg, phrases):
        rows = [(seg.ids[d].as_py(), phrases.ids[o], p - int(seg.offs[d])) for w, p in phrases.near(seg, slop)
                for d in [int(seg.document(np.array([p]))[0])] for o in phrases.owners[w]]
        if rows:
            ids, item, word = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item, pa.string()),
                                              pa.array(word, pa.int64())], names=["id", "item", "word"])
    found = None
    for chunk in _chunks(items, item_col, text_col, chunk_bytes):
        part = index.search(Phrases(chunk, None), fn, "id long, item string, word long")
        found = part if found is None else found.unionByName(part)
    return found


#: A document is contaminated when at least one word in 20 is hit.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_hit, items, spans and ``contaminated``."""
    index = build_index(df, id_col, text_col)
    out = blocks.saved(phrase_hits(index, items).withColumn("contaminated", F.expr(CONTAMINATED))
                       .drop("block", "place").withColumnRenamed("id", id_col))
    index.release()
    return out


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not contaminated."""
    packed = blocks.pack(df, text_col)
    index = build_index(df, id_col, text_col, packed=packed)
    gone = blocks.saved(phrase_hits(index, items).where(CONTAMINATED).select("block", "place"))
    index.release()

    def keep(block, batch, back):
        mask = np.ones(batch.num_rows, bool)
        mask[[x["place"] for x in back or ()]] = False
        yield batch.filter(pa.array(mask))
    return packed.visit(keep, packed.schema, blocks.per_block(gone, "place"))
