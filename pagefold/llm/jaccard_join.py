"""N-gram Jaccard join with a count-vector R-tree; nothing is lost to approximation.

Two documents link when their sets of distinct word 5-grams have a Jaccard similarity of
0.8 or more (9 * overlap >= 4 * (size + size) in whole numbers).

1. Groups. Shingle hashes are dealt into groups. Linked sets differ in at most a quarter
   of the smaller one's shingles, so when a document sends more group contents than that,
   a linked partner must hold one of them unchanged. Sizes fall into classes with a fixed
   number of groups; a document close under the next class sends there too. Contents of
   two or more shingles are sent first; a document with too few of those also sends, under
   another name, all groups, then finer groups, in the end single shingles - two linked
   documents that are both short of contents meet at that level, and a document that is not
   short meets every partner at the level before.
2. R-tree over points. One document speaks for all that have its very set. A block sends
   each content once per size band, with its number of documents, and learns which contents
   others of near size hold too, and how many. As linked sets differ in few contents, only
   the rarest of a document's contents are needed to meet every partner: one of a passage that
   many texts quote brings nobody together. For those the documents travel as points of 64
   group counts. Points that share a content are packed into a tree of bounding boxes; the
   overlap with a box or a point is at most the sum of the coordinate minima, and pairs that
   pass this bound (and the one on sizes) are candidates. Components of the candidates hold
   every possible link. A content of more than ``POINT_CHUNK`` documents is split into chunks,
   each pair of chunks a group.
3. Verification. Inside a component the same tree, with more groups, leaves pairs that are
   verified on the full sets unless they are connected by then. Components over ``CHUNK``
   documents are split by size class and hash, each pair of chunks of near size a group.
4. Components of the verified links, with the exact copies of every set.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer
than five words are one shingle; rows that repeat an id are separate rows that may link;
a null id never becomes a component's id unless it is alone (then null); no rows give none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm import blocks
from pagefold.llm.components import connected, local_components
from pagefold.llm.repeats import bucket_count
from pagefold.llm.words import byte_values, give_back, hashed_words, in_document, make_room, mix, range_bucket, space_rule, window_hashes

SHINGLE_WORDS = 5
#: Sizes of a class lie within a factor of 3; its largest documents have 3 shingles a group.
CLASS_FACTOR = 3
GROUP_SHINGLES = 3.0
CHUNK = 1024
CHUNK_SHINGLES = 1 << 21
LEAF = 16
#: Text that a task unpacks and cuts into shingles at a time.
PIECE_BYTES = 2 << 20
#: Groups of the points that meet under one content, and documents of a content that one task compares.
POINT_DIMS = 64
POINT_CHUNK = 2048
#: Answers to blocks that a task sends at a time.
ANSWERS = 1024
_U = np.uint64


def shingle_sets(texts, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of the documents one after another, offsets)."""
    make_room()
    h, offs = hashed_words(texts, space_rule(), byte_values(lower=True))
    n = np.diff(offs)
    full = window_hashes(h, k)
    sets = []
    for i, m in enumerate(n):
        if m >= k:
            sets.append(np.unique(full[offs[i]:offs[i + 1] - k + 1]))
        elif m:
            sets.append(window_hashes(h[offs[i]:offs[i + 1]], int(m)))
        else:
            sets.append(np.zeros(0, _U))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def set_hashes(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of every set, as two int64 columns; empty sets get zeros."""
    out = []
    full = np.flatnonzero(np.diff(offs))
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        v = np.zeros(len(offs) - 1, _U)
        if len(full):
            v[full] = mix(np.add.reduceat(mix(sets ^ _U(salt)), offs[full]))
        out.append(v.view(np.int64))
    return out[0], out[1]


def _groups(sets, offs, docs, g, salt):
    """Contents of the groups of these documents: (document, content hash, shingles in it)."""
    n = np.diff(offs)[docs]
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    place = np.repeat(offs[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    h = sets[place]
    doc = np.repeat(np.arange(len(docs)), n)
    group = (h >> _U(32)) * np.repeat(g, n).astype(_U) >> _U(32)
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])
    starts = np.flatnonzero(new)
    content = np.add.reduceat(mix(h ^ _U(0xA0761D6478BD642F)), starts)
    d = doc[starts]
    return docs[d], mix(content ^ mix(salt[d])), np.diff(np.append(starts, len(h)))


def contents(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, content hash) of all that the documents send."""
    return leveled_contents(sets, offs)[:2]


def leveled_contents(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, content hash, class and level under which it is sent) of all that the documents send."""
    size = np.diff(offs)
    some = np.flatnonzero(size)
    cls = np.zeros(len(size), np.int64)
    top = CLASS_FACTOR
    while len(size) and (size >= top).any():
        cls += size >= top
        top *= CLASS_FACTOR
    bound = CLASS_FACTOR ** (cls + 1)
    jobs = [(some, cls[some]), (some[5 * size[some] >= 4 * bound[some]], cls[some[5 * size[some] >= 4 * bound[some]]] + 1)]
    out_doc, out_key, out_level = [], [], []
    for docs, c in jobs:
        largest = (CLASS_FACTOR ** (c + 1)).astype(np.float64)
        for level, (per_group, least) in enumerate(((GROUP_SHINGLES, 2), (2.5, 1), (0.6, 1), (0.0, 1))):
            if not len(docs):
                break
            if per_group:
                g = np.maximum(1, np.ceil(largest / per_group)).astype(np.int64)
                salt = (c * 8 + level).astype(_U)
                d, key, cnt = _groups(sets, offs, docs, g, salt)
                keep = cnt >= least
                d, key = d[keep], key[keep]
            else:  # every shingle by itself
                n = size[docs]
                place = np.repeat(offs[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                d, key = np.repeat(docs, n), mix(sets[place] ^ mix(np.repeat(c * 8 + level, n).astype(_U)))
            out_doc.append(d)
            out_key.append(key)
            at = np.zeros(len(size), np.int64)
            at[docs] = c * 8 + level
            out_level.append(at[d])
            sent = np.bincount(d, minlength=len(size))[docs]
            short = sent <= size[docs] // 4
            docs, c, largest = docs[short], c[short], largest[short]
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(out_doc), np.concatenate(out_key), np.concatenate(out_level)


def rarest(n: np.ndarray, doc: np.ndarray, key: np.ndarray, level: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which contents are needed to meet every partner, given how many documents hold each (0: no possible partner).
    At a level under which linked documents meet, at most a quarter of a set's size of its contents are not the
    partner's. So in an order that is the same for all documents, here the rarest first, the first content that the two
    share is among the first ``n // 4 + 1`` of either."""
    order = np.lexsort((key, held, level, doc))
    d, v = doc[order], level[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    starts = np.flatnonzero(new)
    rank = np.empty(len(d), np.int64)
    rank[order] = np.arange(len(d)) - np.repeat(starts, np.diff(np.append(starts, len(d))))
    return (held > 0) & (rank <= n[doc] // 4)


SENT = "bucket int, block long, keys binary, bands binary, counts binary"
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("bands", pa.binary()),
                   ("counts", pa.binary())])
FOUND = "block long, bucket int, held binary"
_FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("held", pa.binary())])
POINT = "key long, a int, b int, side int, ref long, n long, point binary"
_POINT = pa.schema([("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("side", pa.int32()), ("ref", pa.int64()),
                    ("n", pa.int64()), ("point", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _star_rows(a: np.ndarray, b: np.ndarray):
    """The same components, as edges to their least member."""
    if len(a):
        node, root = local_components(a, b)
        if (node != root).any():
            yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], schema=_PAIR)


def size_band(n: np.ndarray) -> np.ndarray:
    """Logarithmic size; the bands of two linked sets differ by 2 at most (1.13 ** 2 > 1.25 and then some)."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.13)).astype(np.uint8)


def _sent(texts, gone: list[int]):
    """Sets of a block, and the contents sent with their documents: all but those ``gone``."""
    sets, offs = shingle_sets(texts)
    size = np.diff(offs)
    size[gone] = 0
    held = size[in_document(offs, len(sets))] > 0
    return sets, offs, *leveled_contents(sets[held], np.concatenate([[0], np.cumsum(size)]).astype(np.int64))


def _entries(offs, doc, key):
    """Distinct (content, size band) sorted, how often each is sent, and the entry of every content sent."""
    band = size_band(np.diff(offs))[doc]
    order = np.lexsort((band, key))
    k, b = key[order], band[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    entry = np.empty(len(k), np.int64)
    entry[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return k[starts], b[starts], np.diff(np.append(starts, len(k))), entry


def _places(back) -> list[int]:
    return [x["place"] for x in back or () if x["place"] is not None]


def _send_keys(text_col: str, buckets: int):
    def send(block, batch, back):
        _, offs, doc, key, _ = _sent(batch.column(batch.schema.get_field_index(text_col)), _places(back))
        key, band, counts, _ = _entries(offs, doc, key)
        cuts = np.searchsorted(range_bucket(key, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        if len(full):
            part = [slice(cuts[b], cuts[b + 1]) for b in full]
            yield pa.RecordBatch.from_pydict(
                {"bucket": full, "block": [block] * len(full), "keys": [key[x].tobytes() for x in part],
                 "bands": [band[x].tobytes() for x in part], "counts": [counts[x].astype(np.uint32).tobytes() for x in part]},
                schema=_SENT)
    return send


def _meet():
    """Per block, bucket and entry sent: 0 if no other document of near size sends its content, else the number of
    documents with the content."""
    def run(batches):
        heads, keys, bands, counts = [], [], [], []
        for b in batches:
            own = b.column("keys").to_pylist()
            heads += zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), map(len, own))
            keys.append(np.frombuffer(b"".join(own), np.uint64))
            bands.append(np.frombuffer(b"".join(b.column("bands").to_pylist()), np.uint8))
            counts.append(np.frombuffer(b"".join(b.column("counts").to_pylist()), np.uint32))
        if not heads:
            return
        key, band = np.concatenate(keys), np.concatenate(bands)
        order = np.lexsort((band, key))
        k, s, n = key[order], band[order].astype(np.int64), np.concatenate(counts).astype(np.int64)[order]
        same = k[1:] == k[:-1]
        near = np.zeros(len(k) + 1, bool)
        near[1:-1] = same & (s[1:] - s[:-1] <= 2)
        shared = near[1:] | near[:-1] | (n > 1)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        total = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(k))))
        held = np.empty(len(k), np.uint32)
        held[order] = np.where(shared, np.minimum(total, (1 << 32) - 1), 0)
        at, found = 0, []
        for block, bucket, size in heads:  # one for every block: many, so their answers leave together
            got = held[at:at + size // 8]
            at += len(got)
            if got.any():
                found.append((block, bucket, pa.compress(got.tobytes(), "zstd", asbytes=True)))
        for i in range(0, len(found), ANSWERS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i:i + ANSWERS]), _FOUND.types)], schema=_FOUND)
    return run


def points_of(sets: np.ndarray, offs: np.ndarray, dims: int) -> np.ndarray:
    """Counts of every set's shingles by group: one row per document."""
    group = mix(sets ^ _U(0xE7037ED1A0B428DB)) >> _U(40)
    at = in_document(offs, len(sets)) * dims + (group % _U(dims)).astype(np.int64)
    return np.bincount(at, minlength=(len(offs) - 1) * dims).reshape(-1, dims)


def _unit(n: np.ndarray) -> np.ndarray:
    """Shingles that one step of a stored count stands for: the largest possible count of a set fits a byte."""
    return np.maximum(1, -(-n // 255))


def _send_points(text_col: str, buckets: int, chunk: int):
    def send(block, batch, back):
        answers = [x for x in back or () if x["held"] is not None]
        if not answers:
            return
        sets, offs, doc, key, level = _sent(batch.column(batch.schema.get_field_index(text_col)), _places(back))
        own, _, _, entry = _entries(offs, doc, key)
        cuts = np.searchsorted(range_bucket(own, buckets), np.arange(buckets + 1))
        held = np.zeros(len(own), np.int64)
        for x in answers:
            i, j = cuts[x["bucket"]], cuts[x["bucket"] + 1]
            held[i:j] = np.frombuffer(pa.decompress(x["held"], int(j - i) * 4, codec="zstd", asbytes=True), np.uint32)
        n, held = np.diff(offs), held[entry]
        need = rarest(n, doc, key, level, held)
        doc, key, chunks = doc[need], key[need], -(-held[need] // chunk)
        if not len(doc):
            return
        unit = _unit(n)
        used = np.unique(doc)
        size = np.where(np.isin(np.arange(len(n)), used), n, 0)
        inside = size[in_document(offs, len(sets))] > 0
        counts = points_of(sets[inside], np.concatenate([[0], np.cumsum(size)]), POINT_DIMS)
        point = {int(d): (-(-counts[d] // unit[d])).astype(np.uint8).tobytes() for d in used}
        ref = (block << blocks.PLACE_BITS) + doc
        mine = (mix(ref.astype(np.uint64)) % chunks.astype(np.uint64)).astype(np.int64)
        for turn in range(int(chunks.max())):  # a row for each chunk that the document's own chunk meets
            at = np.flatnonzero(chunks > turn)
            own = mine[at]
            side = np.where(own == turn, -1, own > turn).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(key[at].view(np.int64)), pa.array(np.minimum(own, turn).astype(np.int32)),
                pa.array(np.maximum(own, turn).astype(np.int32)), pa.array(side), pa.array(ref[at]), pa.array(n[doc[at]]),
                pa.array([point[d] for d in doc[at].tolist()], pa.binary())], schema=_POINT)
    return send


def _near_points(batches):
    """Rows of POINT sorted by (key, a, b) -> components of the pairs whose bound allows a link."""
    held, edges = None, []

    def compare(key, side, ref, n, point):
        new = np.ones(len(ref), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(ref)))
        small = np.repeat(size, size) <= LEAF
        unit = _unit(n)
        for d in range(1, min(LEAF, len(ref))):  # few points: the pairs d rows apart, of all groups at once
            i = np.flatnonzero(small[:len(ref) - d])
            i = i[(key[i + d] == key[i]).all(1)]
            i = i[(5 * n[i] >= 4 * n[i + d]) & (5 * n[i + d] >= 4 * n[i]) & ((side[i] < 0) | (side[i] != side[i + d]))]
            if not len(i):
                continue
            bound = np.minimum(point[i] * unit[i, None], point[i + d] * unit[i + d, None]).sum(1)
            i = i[9 * bound >= 4 * (n[i] + n[i + d])]
            edges.append((ref[i], ref[i + d]))
        for s, m in zip(starts[size > LEAF], size[size > LEAF]):
            x = slice(s, s + m)
            links = CountTree(point[x] * unit[x, None], n[x]).forest(side[x] if (side[x] >= 0).any() else None)
            links = np.array(links, np.int64).reshape(-1, 2)
            edges.append((ref[x][links[:, 0]], ref[x][links[:, 1]]))

    def contracted():
        yield from _star_rows(*(np.concatenate(e) for e in zip(*edges)))

    for b in batches:
        rows = [np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")], 1),
                *(b.column(c).to_numpy().astype(np.int64) for c in ("side", "ref", "n")),
                np.frombuffer(b"".join(b.column("point").to_pylist()), np.uint8).reshape(-1, POINT_DIMS).astype(np.int32)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        same = (rows[0] == rows[0][-1:]).all(1)
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if last:
            compare(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]  # the last group may go on in the next batch
        if sum(len(e[0]) for e in edges) > 1 << 20:
            yield from contracted()
            edges.clear()
    if held is not None and len(held[0]):
        compare(*held)
    if edges:
        yield from contracted()
    held = edges = None
    give_back()


class CountTree:
    """Points of group counts, packed by size and leading coordinates into bounding boxes."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.points, self.size = points, size
        self.order = np.lexsort((self.points[:, 2], self.points[:, 1], self.points[:, 0], self.size))
        self.levels = []  # (first child, boxes' upper corners, least size, largest size), leaves first
        high, low, top = self.points[self.order], self.size[self.order], self.size[self.order]
        while len(high) > LEAF:
            first = np.arange(0, len(high), LEAF)
            high, low, top = (np.maximum.reduceat(high, first), np.minimum.reduceat(low, first),
                              np.maximum.reduceat(top, first))
            self.levels.append((high, low, top))

    def near(self, q: np.ndarray, n: int) -> np.ndarray:
        """Points whose overlap bound with point q of size n still allows a link."""
        at = None
        for high, low, top in reversed(self.levels):
            at = np.arange(len(high)) if at is None else at[at < len(high)]
            ok = (5 * top[at] >= 4 * n) & (4 * low[at] <= 5 * n)
            at = at[ok]
            bound = np.minimum(high[at], q).sum(1, dtype=np.int64)
            at = at[9 * bound >= 4 * (n + low[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = self.order if at is None else self.order[at[at < len(self.order)]]
        size = self.size[at]
        at = at[(5 * size >= 4 * n) & (4 * size <= 5 * n)]
        bound = np.minimum(self.points[at], q).sum(1, dtype=np.int64)
        return at[9 * bound >= 4 * (n + self.size[at])]

    def forest(self, side: np.ndarray | None, verify=None) -> list[tuple[int, int]]:
        """Pairs within the bound that connect what all such pairs connect, at most one fewer than points.
        With ``side`` only pairs of different sides count; ``verify(i, candidates)`` keeps the true links.
        A point that is reached goes, so a group whose points all link is searched once."""
        left, tree, ids, links = np.ones(len(self.size), bool), self, None, []
        for start in self.order:
            if not left[start]:
                continue
            left[start] = False
            reached, rest = [start], int(left.sum())
            while reached and rest:
                i = reached.pop()
                if 2 * rest < len(tree.size):
                    ids = np.flatnonzero(left)
                    tree = CountTree(self.points[ids], self.size[ids])
                at = tree.near(self.points[i], int(self.size[i]))
                at = at if ids is None else ids[at]
                at = at[left[at]]
                if side is not None:
                    at = at[side[at] != side[i]]
                for step in (at,) if verify is None else (at[k:k + 64] for k in range(0, len(at), 64)):
                    found = step if verify is None else verify(i, step)
                    left[found] = False
                    rest -= len(found)
                    reached += found.tolist()
                    links += [(int(i), j) for j in found.tolist()]
        return links


def link_forest(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what all links connect, at most one fewer than documents.
    With ``side`` (0 or 1 for each) only links between the sides count."""
    if len(sets) == 2:
        if side is not None and side[0] == side[1]:
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(1, 0)] if 9 * both >= 4 * (len(sets[0]) + len(sets[1])) else []
    size = np.array([len(s) for s in sets], np.int64)
    cuts = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets)
    dims = 8
    while dims < min(1024, int(size.max()) // 4):
        dims *= 2
    tree = CountTree(points_of(flat, cuts, dims).astype(np.uint16 if size.max() < 65536 else np.uint32), size)
    _, ids = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, bool)

    def verify(i, step):
        mine = ids[cuts[i]:cuts[i + 1]]
        mark[mine] = True
        place = np.concatenate([ids[cuts[j]:cuts[j + 1]] for j in step])
        both = np.add.reduceat(mark[place].astype(np.int64), np.concatenate([[0], np.cumsum(size[step])[:-1]]))
        mark[mine] = False
        return step[9 * both >= 4 * (size[i] + size[step])]
    return tree.forest(side, verify)


def _some_bytes(batch: pa.RecordBatch):
    """Slices of about ``PIECE_BYTES`` of text before compression."""
    ends = np.cumsum(batch.column("bytes").to_numpy())
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def _tree_join(batches):
    """Rows (grp, side, ref, bytes, text) sorted by grp -> verified links."""
    grp, sides, refs, sets = None, [], [], []

    def done():
        if len(sets) > 1:
            side = np.array(sides) if min(sides) >= 0 else None
            links = link_forest(sets, side)
            ends = np.array([[refs[i], refs[j]] for i, j in links], np.int64).reshape(-1, 2)
            yield from _star_rows(ends[:, 0], ends[:, 1])

    for b in batches:
        for part in _some_bytes(b):
            texts = pa.array([pa.decompress(z.as_py(), n.as_py(), codec="zstd", asbytes=True)
                              for z, n in zip(part.column("text"), part.column("bytes"))], pa.large_binary())
            hashes, offs = shingle_sets(texts)
            for i, g in enumerate(part.column("grp").to_pylist()):
                if g != grp:
                    yield from done()
                    grp, sides, refs, sets = g, [], [], []
                sides.append(part.column("side")[i].as_py())
                refs.append(part.column("ref")[i].as_py())
                sets.append(hashes[offs[i]:offs[i + 1]].copy())
    yield from done()
    give_back()


SEEN = "ref long, id long, n_shingles long, one long, two long"
TEXT = "ref long, k long, bytes long, text binary"


def _see(id_col: str, text_col: str):
    names = ("ref", "id", "n_shingles", "one", "two")

    def see(block, batch, _):
        sets, offs = shingle_sets(batch.column(batch.schema.get_field_index(text_col)))
        one, two = set_hashes(sets, offs)
        ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
        ref = pa.array((block << blocks.PLACE_BITS) + np.arange(batch.num_rows, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([ref, ids, pa.array(np.diff(offs)), pa.array(one), pa.array(two)], names=names)
    return see


def _hand_over(text_col: str):
    """Compressed texts of the documents asked for."""
    schema = pa.schema([("ref", pa.int64()), ("k", pa.int64()), ("bytes", pa.int64()), ("text", pa.binary())])

    def give(block, batch, back):
        if back:
            texts = batch.column(batch.schema.get_field_index(text_col))
            raw = [texts[x["place"]].as_py().encode("utf-8", "surrogatepass") for x in back]
            yield pa.RecordBatch.from_arrays([
                pa.array([(block << blocks.PLACE_BITS) + x["place"] for x in back], pa.int64()),
                pa.array([x["k"] for x in back], pa.int64()), pa.array([len(r) for r in raw], pa.int64()),
                pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())], schema=schema)
    return give


def _near_class():
    """Sizes of linked documents differ by one class at most."""
    return F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(1.26))).cast("long")


def _tasks(cand: DataFrame) -> DataFrame:
    """(grp, side, ref, bytes, text): a component of few documents is one group, a large one a group per pair
    of chunks whose sizes are near; side is -1 where all pairs of the group count."""
    per = cand.withColumn("cls", _near_class()).groupBy("k", "cls").agg(
        F.count("*").alias("docs"), F.sum("n_shingles").alias("held"))
    per = per.withColumn("chunks", F.greatest(F.ceil(F.col("docs") / CHUNK), F.ceil(F.col("held") / CHUNK_SHINGLES)))
    size = per.groupBy("k").agg(F.sum("docs").alias("all_docs"), F.sum("held").alias("all_held"),
                                F.map_from_entries(F.collect_list(F.struct("cls", "chunks"))).alias("chunks"))
    size = size.where("all_docs > 1").withColumn("whole", F.expr(f"all_docs <= {CHUNK} AND all_held <= {CHUNK_SHINGLES}"))
    rows = cand.join(size, "k").withColumn("cls", _near_class())
    mine = F.pmod(F.xxhash64("ref"), F.coalesce(F.col("chunks")[F.col("cls")], F.lit(1)))
    rows = rows.withColumn("mine", mine)
    name = "concat_ws('/', k, {0}, {1}, {2}, {3})"
    others = """array_compact(concat(
      transform(sequence(0L, chunks[cls] - 1), j -> named_struct(
        'grp', %s, 'side', if(j = mine, -1, if(j > mine, 0, 1)))),
      if(chunks[cls + 1] IS NULL, array(), transform(sequence(0L, chunks[cls + 1] - 1), j -> named_struct(
        'grp', %s, 'side', 0))),
      if(chunks[cls - 1] IS NULL, array(), transform(sequence(0L, chunks[cls - 1] - 1), j -> named_struct(
        'grp', %s, 'side', 1)))))""" % (
        name.format("cls", "least(j, mine)", "cls", "greatest(j, mine)"),
        name.format("cls", "mine", "cls + 1", "j"), name.format("cls - 1", "j", "cls", "mine"))
    groups = F.when(F.col("whole"), F.expr("array(named_struct('grp', cast(k AS string), 'side', -1))")).otherwise(F.expr(others))
    return rows.withColumn("t", F.explode(groups)).select("t.grp", "t.side", "ref", "bytes", "text")


def _joined(df: DataFrame, id_col: str, text_col: str, block_bytes: int):
    packed = blocks.pack(df, text_col, block_bytes)
    spark = df.sparkSession
    parts = blocks.shuffle_partitions(spark)
    buckets = bucket_count(packed.bytes / 12, parts)
    seen = blocks.saved(packed.visit(_see(id_col, text_col), SEEN))
    rows = seen.where("n_shingles > 0").select("ref", "one", "two")
    first = rows.groupBy("one", "two").agg(F.min("ref").alias("rep"))
    copies = blocks.saved(rows.join(first, ["one", "two"]).where("ref <> rep").select(F.col("ref").alias("a"), F.col("rep").alias("b")))
    gone = _at(copies, "a").withColumns({"bucket": F.lit(None).cast("int"), "held": F.lit(None).cast("binary")})
    shared = blocks.saved(packed.visit(_send_keys(text_col, buckets), SENT, blocks.per_block(gone, "place", "bucket", "held"))
                          .repartition(buckets, "bucket").mapInArrow(_meet(), FOUND))
    answers = gone.unionByName(shared.withColumn("place", F.lit(None).cast("long")))
    points = packed.visit(_send_points(text_col, buckets, POINT_CHUNK), POINT,
                          blocks.per_block(answers, "place", "bucket", "held"))
    k = connected(points.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
                  .mapInArrow(_near_points, "a long, b long"))
    asked = _at(k, "node").withColumnRenamed("label", "k")
    texts = packed.visit(_hand_over(text_col), TEXT, blocks.per_block(asked, "place", "k"))
    links = (_tasks(blocks.saved(texts.join(seen.select("ref", "n_shingles"), "ref"))).repartition("grp")
             .sortWithinPartitions("grp").mapInArrow(_tree_join, "a long, b long"))
    return packed, seen, connected(links.union(copies))


def _at(df: DataFrame, ref: str) -> DataFrame:
    """``df`` with block and place of a row reference."""
    return df.withColumns({"block": F.shiftright(ref, blocks.PLACE_BITS),
                           "place": F.col(ref).bitwiseAND((1 << blocks.PLACE_BITS) - 1)}).drop("a", "b", "node")


def _components(seen: DataFrame, labels: DataFrame) -> DataFrame:
    rows = seen.select("ref", "id", "n_shingles").join(labels.withColumnRenamed("node", "ref"), "ref", "left")
    alone = rows.where("label IS NULL").select("ref", "id", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("is_first"))
    linked = rows.where("label IS NOT NULL")
    least = linked.groupBy("label").agg(F.min("id").alias("component_id"),
                                        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "ref")).alias("first"))
    linked = linked.join(least, "label").select("ref", "id", "n_shingles", "component_id",
                                                (F.col("first.ref") == F.col("ref")).alias("is_first"))
    return linked.unionByName(alone)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: the id, n_shingles, component_id and whether the row is the
    component's first by id."""
    packed, seen, labels = _joined(df.select(id_col, text_col), id_col, text_col, block_bytes)
    out = blocks.saved(_components(seen, labels).withColumnRenamed("id", id_col).drop("ref"))
    packed.release()
    return out


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` without those that are not their component's first by id."""
    packed, seen, labels = _joined(df, id_col, text_col, block_bytes)
    gone = _at(_components(seen, labels).where("NOT is_first").select("ref"), "ref")

    def keep(block, batch, back):
        mask = np.ones(batch.num_rows, bool)
        mask[[x["place"] for x in back or ()]] = False
        yield batch.filter(pa.array(mask))
    return packed.visit(keep, packed.schema, blocks.per_block(gone, "place"))
