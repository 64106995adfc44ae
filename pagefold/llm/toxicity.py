"""Toxicity by weak supervision.

1. Features of a text: its words and their leading 3 to 8 bytes, hashed by kind; a stem that
   many insults share is a feature like a whole word.
2. Voters. Lexicons are mined from all labelled rows, counted in Spark: features whose
   presence goes with the label beyond chance (log-likelihood ratio), by kind and strength.
   A general word list and patterns (several lexicon hits, shouting, strings of exclamation
   marks) vote as well. Every document gets a vote pattern, one bit per voter.
3. Label model. A generative model of (label, votes) is fitted by EM on the counts of the
   vote patterns of all documents; those of all labelled rows enter with their labels. Votes are not
   taken as independent: given the label, each voter depends on one other, along the tree
   with the largest conditional mutual information, so accuracies and correlations are both
   estimated and near copies of a voter count once.
4. A sparse linear classifier on the features (logistic loss, L1) is trained on the posterior
   labels of sampled rows, labelled and not, and scores every document. Half of the labelled
   sample is toxic rows; the base is set back to the odds of all rows. The sample's features are
   counted in Spark, the driver gets those that the screen leaves.

Bounds: ``SAMPLE`` labelled and ``UNLABELLED`` other rows, one per id, train the classifier;
lexicons are mined from all labelled rows; vote patterns are counted over all documents and
there are at most 2 ** voters of them. Labels, language, source and id are
no features.

Defined results: null and empty texts have no features and get the model's base score;
repeated rows get equal scores; rows without a label, with a null id or a null label teach
nothing; without any usable label the label model is fitted to the votes of the word list and
the patterns alone, a document without a vote taken as clean, and words of the list too rare to train on weigh what it says of the list;
texts of any length are scored whole, piece by piece; a column named like the score is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagefold.llm import words as W
from pagefold.llm.blocks import cut, saved

SAMPLE = 6_000
UNLABELLED = 2_000
THRESHOLD = 0.3
PIECE_BYTES = 2 << 20
#: Kinds of features: the whole word, or its first bytes.
PREFIXES = (0, 3, 4, 5, 6, 8)
#: A feature id is its kind, then this many bits of hash.
KIND_BITS = 29
#: Common insults of several languages, fixed values.
INSULTS = ("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown "
           "fool bastard bitch asshole jerk retard ugly filthy vermin idiota imbecil estupido basura idiote imbecile "
           "connard salaud ordure trottel dummkopf arschloch abschaum").split()
_U = np.uint64


def _word_features(texts):
    """(feature ids of all words as an array per kind, 0 where there is none, word offsets)."""
    buf, offs = W.text_buffer(texts)
    lut, values = W.alnum_rule(), W.byte_values(lower=True)
    kinds, ends, done = [[] for _ in PREFIXES], [np.zeros(1, np.int64)], 0
    for i, j in W._slices(offs):
        b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        s, e = W.spans(b, o, lut)
        up, down = W._powers(len(b) + 1)
        run = np.concatenate([np.zeros(1, _U), np.cumsum(values[b] * up[:len(b)])])
        for k, size in enumerate(PREFIXES):
            stop = e if size == 0 else np.minimum(s + size, e)
            h = W.mix((run[stop] - run[s]) * down[s] + _U(k))
            f = (h >> _U(64 - KIND_BITS)).astype(np.uint32) | np.uint32(k << KIND_BITS | 1)
            if size:
                f[e - s <= size] = 0
            kinds[k].append(f)
        ends.append(np.searchsorted(s, o[1:]) + done)
        done += len(s)
    return [np.concatenate(k) if k else np.zeros(0, np.uint32) for k in kinds], np.concatenate(ends)


def _per_document(ids: np.ndarray, doc: np.ndarray):
    """Distinct (document, feature)."""
    key = np.unique(doc.astype(np.uint64) << _U(32) | ids)
    return (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.uint32)


def features_of(texts) -> list[np.ndarray]:
    """Sorted distinct feature ids of each text."""
    kinds, offs = _word_features(texts)
    doc = W.in_document(offs, len(kinds[0]))
    ids = np.concatenate(kinds)
    d, f = _per_document(ids[ids > 0], np.tile(doc, len(kinds))[ids > 0])
    cuts = np.searchsorted(d, np.arange(len(offs)))
    return [f[cuts[i]:cuts[i + 1]] for i in range(len(offs) - 1)]


class Table:
    """Values of a few features; a small bitmap rules most words out before the ids are compared."""

    BITS = 18

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.values = np.asarray(ids, np.uint32)[order], np.asarray(values)[order]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self._low(self.ids)] = True

    def _low(self, ids):
        return (ids >> np.uint32(1)) & np.uint32((1 << self.BITS) - 1)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the ids that the table has, their values)."""
        at = np.flatnonzero(self.maybe[self._low(ids)])
        if not len(at):
            return at, self.values[:0]
        i = np.minimum(np.searchsorted(self.ids, ids[at]), len(self.ids) - 1)
        have = self.ids[i] == ids[at]
        return at[have], self.values[i[have]]


def insult_ids() -> np.ndarray:
    return np.unique(_word_features(pa.array(INSULTS))[0][0])


class Voters:
    """A bit per lexicon, and the patterns after them."""

    PATTERNS = 3

    def __init__(self, lexicons: list[np.ndarray]):
        self.n = len(lexicons) + self.PATTERNS
        ids = np.unique(np.concatenate(lexicons))
        bits = np.zeros(len(ids), np.int64)
        for j, own in enumerate(lexicons):
            bits[np.searchsorted(ids, own)] |= 1 << j
        self.table = Table(ids, bits)

    def votes(self, texts) -> np.ndarray:
        """Bit pattern per text."""
        kinds, offs = _word_features(texts)
        doc = W.in_document(offs, len(kinds[0]))
        out, words = np.zeros(len(offs) - 1, np.int64), None
        for ids in kinds:
            hit, bits = self.table.find(ids)
            np.bitwise_or.at(out, doc[hit], bits)
            if words is None:
                words = np.bincount(_per_document(ids[hit], doc[hit])[0], minlength=len(out))
        return self._with_patterns(out, words, surface(texts))

    def of_features(self, ids: np.ndarray, marks: int) -> int:
        """The same bits from a text's features and surface marks."""
        hit, bits = self.table.find(ids)
        words = int((ids[hit] < 1 << KIND_BITS).sum())
        return int(self._with_patterns(np.array([np.bitwise_or.reduce(bits) if len(bits) else 0], np.int64),
                                       np.array([words]), np.array([marks]))[0])

    def _with_patterns(self, out, words, marks):
        base = self.n - self.PATTERNS
        return out | (words >= 2).astype(np.int64) << base | marks << (base + 1)


def surface(texts) -> np.ndarray:
    """Bit 0: three exclamation marks or more. Bit 1: more capitals than small letters."""
    buf, cuts = W.text_buffer(texts)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[cuts])
    marks, caps = count(buf == 0x21), count((buf >= 0x41) & (buf <= 0x5A))
    return (marks >= 3).astype(np.int64) | (caps > count((buf >= 0x61) & (buf <= 0x7A))).astype(np.int64) << 1


def mine(rows: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Lexicons of the voters: the word list, then per kind the features that go with the label."""
    if not len(rows):
        return [insult_ids()]
    ids, both, pos = feature_counts(rows, y)
    return lexicons(ids, both, pos, float(y.sum()), float(len(y) - y.sum()), int((both >= 3).sum()))


def feature_counts(rows: list[np.ndarray], y: np.ndarray):
    """(feature ids, rows that have them, toxic rows that have them)."""
    ids, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return ids, np.bincount(col, minlength=len(ids)), np.bincount(col, y[row], minlength=len(ids)).astype(np.int64)


def share_of(both, pos, n1: float, n0: float):
    """Smoothed share of toxic rows among those that have a feature."""
    rate = max(1.0, n1) / (max(1.0, n1) + max(1.0, n0))
    return (pos + 0.5 * rate) / (both + 0.5)


def lexicons(ids, both, pos, n1: float, n0: float, tried: int) -> list[np.ndarray]:
    """From counts over ``n1`` toxic and ``n0`` other rows, where ``tried`` features are in three rows or more."""
    found = [insult_ids()]
    neg = both - pos
    rate = max(1.0, n1) / (max(1.0, n1) + max(1.0, n0))
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(pos > 0, pos * np.log(pos / (both * rate)), 0) + np.where(neg > 0, neg * np.log(neg / (both * (1 - rate))), 0))
    share = share_of(both, pos, n1, n0)
    least = 2 * np.log(max(2, tried))  # one feature by chance among all that were tried
    for k in range(len(PREFIXES)):
        chosen = (ids >> KIND_BITS == k) & (g2 >= least) & (pos >= 3)
        found += [ids[chosen & (share >= 0.9)], ids[chosen & (share >= 0.6) & (share < 0.9)]]
    return [f for i, f in enumerate(found) if i == 0 or len(f)]


def mine_all(labelled: DataFrame):
    """Lexicons from all rows of ``_text`` and ``_y``."""
    def count(batches):
        for batch in _pieces(batches, "_text"):
            y = _text(batch, "_y").to_numpy(zero_copy_only=False).astype(np.int64)
            ids, both, pos = feature_counts(features_of(_text(batch, "_text")), y)
            # number 0, which no feature has, counts the rows
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids.astype(np.int64), 0)), pa.array(np.append(both, len(y))),
                                              pa.array(np.append(pos, y.sum()))], names=["id", "both", "pos"])
    counts = saved(labelled.mapInArrow(count, "id long, both long, pos long").groupBy("id")
                   .agg(F.sum("both").alias("both"), F.sum("pos").alias("pos")).where("both >= 3 OR id = 0"))
    all_rows = counts.where("id = 0").first()
    if all_rows is None:
        return [insult_ids()]
    n1, n0 = float(all_rows["pos"]), float(all_rows["both"] - all_rows["pos"])
    tried = counts.where("id > 0").count()
    rate = max(1.0, n1) / (max(1.0, n1) + max(1.0, n0))
    pos, neg = F.col("pos"), F.col("both") - F.col("pos")
    g2 = 2 * (pos * F.log(pos / (F.col("both") * rate)) + F.when(neg > 0, neg * F.log(neg / (F.col("both") * (1 - rate)))).otherwise(0.0))
    # the lexicons themselves, and a little over for rounding
    got = counts.where((F.col("id") > 0) & (pos >= 3) & (pos >= 0.59 * F.col("both")) & (g2 >= 2 * float(np.log(max(2, tried))) - 1e-6)).collect()
    got.sort(key=lambda r: r["id"])
    ids, both, pos = np.array([r["id"] for r in got], np.uint32), np.array([r["both"] for r in got], np.int64), np.array([r["pos"] for r in got], np.int64)
    return lexicons(ids, both, pos, n1, n0, tried)


class LabelModel:
    """P(label) and P(vote | label, vote of its parent) along a tree of the voters."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labelled: np.ndarray, n: int, rounds: int = 30):
        """``counts`` of all documents per pattern; ``labelled``: per pattern the labelled rows of label 0 and 1."""
        v = (patterns[:, None] >> np.arange(n)) & 1
        known = labelled.sum(1)
        rest = np.maximum(counts - known, 0).astype(float)
        # where labels are known they start the model; elsewhere most voters silent means clean
        start = (v.sum(1) > 0) * 0.5 + 0.02
        post = (labelled[:, 1] + start) / (known + 1)
        for r in range(rounds):
            w = np.stack([labelled[:, 0] + rest * (1 - post), labelled[:, 1] + rest * post], 1)
            self.prior = (w.sum(0) + 1) / (w.sum() + 2)
            if r % 5 == 0:
                self.parent, self.order = self._tree(v, w)
            self.rate = np.empty((n, 2, 2))  # voter, label, vote of the parent
            for j in range(n):
                p = self.parent[j]
                for y in (0, 1):
                    for b in (0, 1):
                        at = w[:, y] * ((v[:, p] == b) if p >= 0 else 1)
                        self.rate[j, y, b] = (at @ v[:, j] + 0.1) / (at.sum() + 0.2)
            new = self._posterior(v)
            done, post = np.abs(new - post).max() < 1e-6, new
            if done:
                break
        self.n = n

    @staticmethod
    def _tree(v, w):
        """Parents along the largest conditional mutual information given the label."""
        n = v.shape[1]
        info = np.zeros((n, n))
        for y in (0, 1):
            total = w[:, y].sum() + 1e-9
            for a in (0, 1):
                for b in (0, 1):
                    joint = ((v == a) * w[:, y:y + 1]).T @ (v == b) / total
                    left = ((v == a) * w[:, y:y + 1]).sum(0) / total
                    right = ((v == b) * w[:, y:y + 1]).sum(0) / total
                    with np.errstate(divide="ignore", invalid="ignore"):
                        info += total / w.sum() * np.where(joint > 0, joint * np.log(joint / np.maximum(np.outer(left, right), 1e-12)), 0)
        parent, order, left = np.full(n, -1), [0], set(range(1, n))
        while left:
            i, j = max(((i, j) for i in order for j in left), key=lambda e: info[e])
            parent[j] = i
            order.append(j)
            left.discard(j)
        return parent, order

    def _posterior(self, v):
        logs = np.repeat(np.log(self.prior)[None], len(v), 0)
        for j in self.order:
            b = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), int)
            for y in (0, 1):
                p = self.rate[j, y, b]
                logs[:, y] += np.log(np.where(v[:, j] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior((np.asarray(patterns)[:, None] >> np.arange(self.n)) & 1)


def _norm(row, col, n: int, m: int) -> float:
    """Largest squared singular value of the 0/1 matrix of rows and features, by power iteration."""
    x = np.ones(m)
    for _ in range(30):
        y = np.bincount(col, np.bincount(row, x[col], minlength=n)[row], minlength=m)
        size = np.linalg.norm(y)
        if size == 0:
            return 1.0
        x = y / size
    return 1.1 * size


def train(rows: list[np.ndarray], target: np.ndarray, rounds: int = 400, l1: float = 0.2):
    """Sparse logistic regression on soft labels by accelerated proximal gradient: (feature ids, weights, base).
    Features whose presence goes with the target no more than chance explains are left out."""
    n = len(rows)
    none = np.zeros(0, np.uint32), np.zeros(0)
    if not n:
        return *none, -4.0
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    ids, col = np.unique(np.concatenate(rows), return_inverse=True)
    times = np.bincount(col, minlength=len(ids))
    lift = np.bincount(col, (target - mean)[row], minlength=len(ids))
    screen = np.sqrt(2 * np.log(max(2, (times >= 3).sum())))  # in standard errors
    used = (times >= 3) & (np.abs(lift) >= screen * np.sqrt(mean * (1 - mean) * np.maximum(times, 1)))
    if not used.any():
        return *none, base
    number = np.cumsum(used) - 1
    row, col = row[used[col]], number[col[used[col]]]
    m = int(used.sum())
    step = 4.0 / (_norm(row, col, n, m) + n)
    x, b = np.zeros(m), base
    z, zb, t = x, b, 1.0
    for _ in range(rounds):
        margin = np.bincount(row, z[col], minlength=n) + zb
        off = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        new = z - step * np.bincount(col, off[row], minlength=m)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = zb - step * off.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - x), nb + (t - 1) / t2 * (nb - b)
        x, b, t = new, nb, t2
    return ids[used][x != 0], x[x != 0], float(b)


class Model:
    """Weights of the linear classifier; its probability is the score."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, base: float):
        self.ids, self.values, self.base = ids, values, base

    def scores(self, texts) -> np.ndarray:
        table = Table(self.ids, self.values)
        kinds, offs = _word_features(texts)
        doc = W.in_document(offs, len(kinds[0]))
        margin = np.full(len(offs) - 1, self.base)
        for ids in kinds:
            hit, _ = table.find(ids)
            d, f = _per_document(ids[hit], doc[hit])
            margin += np.bincount(d, table.find(f)[1], minlength=len(margin))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _pieces(batches, text_col: str):
    """The batches in slices of about ``PIECE_BYTES`` of text, which bounds a task's arrays."""
    W.make_room()
    for batch in batches:
        for piece, _ in cut(batch, text_col, PIECE_BYTES):
            yield piece
    W.give_back()


def _text(batch, text_col):
    return batch.column(batch.schema.get_field_index(text_col))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        learn_from: Column | None = None, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """Model from ``docs`` and those ``labels`` that ``learn_from`` (a condition on the id) admits."""
    admitted = F.col(id_col).isNotNull() if learn_from is None else F.col(id_col).isNotNull() & learn_from
    usable = (labels.where(admitted & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
              .agg((F.max(label_col).cast("int") > 0).cast("int").alias("_y")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    usable = usable.hint("merge")  # labels may be many: no side of a join with them is sent whole to the tasks
    found = mine_all(docs.where(admitted).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                                    .join(usable, "_id").select("_text", "_y"))
    voters = Voters(found)

    def vote(batches):
        for batch in _pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([_text(batch, "_id").cast(pa.int64()), pa.array(voters.votes(_text(batch, "_text")))], names=["_id", "votes"])
    counted = (texts.withColumn("_id", F.col("_id").cast("long")).mapInArrow(vote, "_id long, votes long")
               .join(usable.withColumn("_id", F.col("_id").cast("long")).hint("merge"), "_id", "left").groupBy("votes", "_y").count().collect())
    if not counted:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -4.0)
    patterns = np.array(sorted({r["votes"] for r in counted}), np.int64)
    place = {p: i for i, p in enumerate(patterns.tolist())}
    totals, labelled = np.zeros(len(patterns)), np.zeros((len(patterns), 2))
    for r in counted:
        totals[place[r["votes"]]] += r["count"]
        if r["_y"] is not None:
            labelled[place[r["votes"]], r["_y"]] += r["count"]
    unlabelled_only = not labelled.any()
    if unlabelled_only:  # nothing tells the two classes apart but that a document without any vote is clean
        labelled[patterns == 0, 0] = totals[patterns == 0]
    model = LabelModel(patterns, totals, labelled, voters.n)

    def some(ids, n):
        return ids.orderBy(F.xxhash64("_id"), "_id").limit(n).select("_id")
    others = docs.where(admitted).select(F.col(id_col).alias("_id")).distinct().join(usable, "_id", "left_anti")
    shown = texts.select("_id").distinct().join(usable, "_id")
    # toxic rows are few: half of the sample is theirs
    toxic, clean = shown.where("_y = 1"), shown.where("_y = 0")
    picked = some(toxic, sample // 2).unionByName(some(clean, sample - sample // 2)).unionByName(some(others, unlabelled))
    # ``sample`` + ``unlabelled`` rows at most: of rows with one id the least text
    picked = texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("_text").alias("_text"))

    def describe(batches):
        for batch in _pieces(batches, "_text"):
            text = _text(batch, "_text")
            rows = [r.tobytes() for r in features_of(text)]
            yield pa.RecordBatch.from_arrays([_text(batch, "_id").cast(pa.int64()), pa.array(rows, pa.binary()),
                                              pa.array(voters.votes(text))], names=["id", "ids", "votes"])
    described = saved(picked.mapInArrow(describe, "id long, ids binary, votes long"))
    got = sorted((r["id"], r["votes"]) for r in described.select("id", "votes").collect())
    target = model.posterior(np.array([v for _, v in got], np.int64)) if got else np.zeros(0)
    rows = _screened_rows(described, dict(zip((i for i, _ in got), target.tolist())))
    ids, weights, base = train(rows, target)
    # the sample holds more toxic rows than there are: its odds give way to those of all rows
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if got else 0.5
    prior = float(np.clip(model.prior[1], 1e-3, 1 - 1e-3))
    base += np.log(prior / (1 - prior)) - np.log(mean / (1 - mean)) if got else 0.0
    if unlabelled_only:  # words of the list too rare to train on weigh what their voter says
        rare = np.setdiff1d(insult_ids(), ids)
        said = model.rate[0, :, 0]
        ids = np.append(ids, rare).astype(np.uint32)
        weights = np.append(weights, np.full(len(rare), float(np.clip(np.log(said[1] / said[0]), 0, 5))))
    return Model(ids, weights, float(base))


#: Targets are added up as whole numbers, whose sum does not depend on the order.
_PARTS = 1 << 30


def _screened_rows(described: DataFrame, target: dict[int, float]) -> list[np.ndarray]:
    """Of each described row, by id, the features that ``train`` can use. All features are counted in Spark; the driver
    gets those whose presence goes with the target more than chance explains."""
    held = described.sparkSession.sparkContext.broadcast({i: round(t * _PARTS) for i, t in target.items()})

    def count(batches):
        for batch in batches:
            rows = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(1)]
            if not sum(map(len, rows)):
                continue
            ids, col = np.unique(np.concatenate(rows), return_inverse=True)
            parts = np.zeros(len(ids), np.int64)
            np.add.at(parts, col, np.repeat([held.value[i] for i in batch.column(0).to_pylist()], [len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.bincount(col, minlength=len(ids))), pa.array(parts)],
                                             names=["id", "times", "parts"])
    n = len(target)
    mean = float(np.clip(sum(target[i] for i in sorted(target)) / max(n, 1), 1e-3, 1 - 1e-3))
    counts = saved(described.select("id", "ids").mapInArrow(count, "id long, times long, parts long").groupBy("id")
                   .agg(F.sum("times").alias("times"), F.sum("parts").alias("parts")).where("times >= 3"))
    least = float(np.sqrt(2 * np.log(max(2, counts.count()))) * np.sqrt(mean * (1 - mean)))
    lift = F.col("parts") / float(_PARTS) - mean * F.col("times")
    used = np.array(sorted(r["id"] for r in counts.where(F.abs(lift) >= least * F.sqrt("times")).select("id").collect()), np.uint32)
    chosen = described.sparkSession.sparkContext.broadcast(used)

    def cut_down(batches):
        for batch in batches:
            rows = [np.intersect1d(np.frombuffer(x.as_py(), np.uint32), chosen.value, assume_unique=True).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "ids"])
    few = sorted((r["id"], bytes(r["ids"])) for r in described.select("id", "ids").mapInArrow(cut_down, "id long, ids binary").collect())
    return [np.frombuffer(r, np.uint32) for _, r in few]


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability that the text is toxic."""
    df = df.drop(score_col)
    schema = T.StructType(df.schema.fields + [T.StructField(score_col, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    held = df.sparkSession.sparkContext.broadcast((model.ids, model.values, model.base))  # the non-zero weights

    def run(batches):
        model = Model(*held.value)
        for batch in _pieces(batches, text_col):
            cols = [*batch.columns, pa.array(model.scores(_text(batch, text_col)))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return df.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, unchanged."""
    learn_from = F.crc32(F.col(columns.get("id_col", "doc_id")).cast("string")) % 4 != 2
    model = fit(docs, labels, learn_from=learn_from, **columns)
    return score(docs, model, columns.get("text_col", "text"), "_score").where(F.col("_score") < threshold).drop("_score")
