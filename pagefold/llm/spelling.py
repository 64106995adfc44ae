"""Spelling variants by a variable-length gram index.

1. Words. Every task counts the words of its texts; sums meet by word.
2. Gram dictionary. Frequencies of all grams of 1 to ``qmax`` letters of the words; a gram
   with more than ``frequent`` of all grams of its length is pruned: the words are not cut
   there, the gram grows by a letter (to ``qmax`` at most). The alphabet has 90 letters, so
   the dictionary has 8,190 grams at ``qmax`` 2 and is sent to the tasks.
3. Decomposition. A word is cut into grams from its left end and from its right end. No cut
   looks beyond its gram, so an edit leaves all left grams before it and all right grams
   behind it as they are.
4. Affected grams. For each place of an edit the word's affected grams are known: one from
   the left and one from the right. A near word must have all others, in place; merging
   their lists is one look-up of (letters under the left grams before, letters under the
   right grams behind). Places with the same affected grams share a look-up. Words of
   L letters meet those of L letters, and those of L + 1 by the grams of class L; in words
   of more than ``PLACES`` letters several grams go together.
5. Verification letter by letter. A list of more than ``LIST`` words is first split by
   what is left of the letters between the two kept ends when one is taken out: words
   that agree there are few (one alphabet at most), so no list is compared all with all.

Nothing is capped: every look-up is answered in full.

Defined results: a null text has no words; a null id counts as the empty string in the
rule that deletes a letter; equal rows count like different ones; very long runs of letters
are words like others (they have a bounded number of look-ups); ties of the form go to the
least word in code-point order; an empty table gives no rows; other columns are not looked
at.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.blocks import saved, shuffle_partitions
from pagefold.llm.words import give_back

#: Words held by a counting task before it hands them on.
HELD = 400_000
QMAX = 2
FREQUENT = 0.005
PLACES = 32
LIST = 12
#: Look-ups per partition.
KEYS = 1_000_000


def _varied(run: str, crc_of_id: int) -> str:
    """The run, without one letter where 31 divides the crc32 of ``<id>:<run>``."""
    h = zlib.crc32(run.encode(), crc_of_id)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _emit(held: dict):
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                      names=["word", "n"])


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): the words of at least ``least_length`` letters that occur at least ``least_n`` times."""
    longer = re.compile("[a-z\xc0-\xff]{%d,}" % least_length)

    def count(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, k in Counter(longer.findall(text.encode().lower().decode())).items():
                    word = _varied(run, prefix)
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + k
                if len(held) > HELD:
                    yield _emit(held)
                    held = {}
        yield _emit(held)
        give_back()
    runs = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def gram_dictionary(vocabulary: DataFrame, qmax: int = QMAX, frequent: float = FREQUENT) -> frozenset[str]:
    """The pruned grams: those too frequent to cut a word at."""
    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for q in range(1, qmax):
                    held.update(w[i:i + q] for i in range(len(w) - q + 1))
        yield _emit(held)
    grams = vocabulary.select("word").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total: Counter = Counter()
    for g in grams:
        total[len(g["word"])] += g["n"]
    return frozenset(g["word"] for g in grams if g["n"] > frequent * total[len(g["word"])])


def left_cuts(word: str, pruned: frozenset[str], qmax: int) -> list[int]:
    """Ends of the grams from the left end on; a gram that does not end inside the word is none."""
    cuts, at, size = [0], 0, len(word)
    while True:
        q = 1
        while q < qmax and word[at:at + q] in pruned:
            q += 1
        at += q
        if at > size:
            return cuts
        cuts.append(at)


def right_cuts(word: str, pruned: frozenset[str], qmax: int) -> list[int]:
    """Starts of the grams from the right end on, from right to left."""
    at = len(word)
    cuts = [at]
    while True:
        q = 1
        while q < qmax and at >= q and word[at - q:at] in pruned:
            q += 1
        at -= q
        if at < 0:
            return cuts
        cuts.append(at)


def _places(size: int, shorter: int, left: list[int], right: list[int], gap: int):
    """Distinct (end of the kept left grams, start of the kept right ones) over all edits that take ``gap`` letters
    out of a word of ``size`` letters, at the steps of class ``shorter``."""
    step = max(1, shorter // PLACES)
    left, right = left[::step], right[::step][::-1]
    # a place right of the last cut, or left of the first, keeps what is before, or behind
    return {(left[bisect_right(left, i) - 1], right[j] if (j := bisect_left(right, i + gap)) < len(right) else size)
            for i in range(size - gap + 1)} if size <= 4 * PLACES else _staircase(size, left, right, gap)


def _staircase(size: int, left: list[int], right: list[int], gap: int):
    """The same for a long word, from the cuts alone: between two cuts nothing changes."""
    turns = sorted({i for i in left} | {max(0, j - gap) for j in right} | {min(size - gap, j - gap + 1) for j in right} | {0})
    return {(left[bisect_right(left, i) - 1], right[bisect_left(right, i + gap)]) for i in turns if 0 <= i <= size - gap}


def lookups(word: str, pruned: frozenset[str], qmax: int):
    """(key, kept letters on the left, kept letters on the right) of every look-up of a word: among words as long as
    this one, longer ones, shorter ones. The last bit of a key tells lists of two lengths from lists of one."""
    size, raw = len(word), word.encode("latin-1")
    left, right = left_cuts(word, pruned, qmax), right_cuts(word, pruned, qmax)
    for kind, shorter, gap in ((0, size, 1), (1, size, 0), (1, size - 1, 1)):
        tag = b"%d %d" % (kind, shorter)
        for a, b in _places(size, shorter, left, right, gap):
            yield zlib.crc32(raw[:a]) << 32 | zlib.crc32(raw[b:], zlib.crc32(tag)) & ~1 | kind, a, size - b


def near(a: str, b: str) -> bool:
    """One letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _pairs(group: list[tuple[str, int, int, int]], two_lengths: bool):
    """Near pairs of one list: rows (word, n, kept left, kept right). Different look-ups may have one key, so a list of
    two lengths may hold words of more: each length meets the next."""
    lengths = {len(x[0]) for x in group}
    if two_lengths and not any(m + 1 in lengths for m in lengths):
        return
    if len(group) > LIST:
        # near words become equal by taking out a letter between the kept ends; of two lengths the shorter stands for itself
        parts = defaultdict(list)
        for x in group:
            w, a, b = x[0], x[2], len(x[0]) - x[3]
            if two_lengths and len(w) + 1 in lengths:
                parts[w].append(x)
            if not two_lengths or len(w) - 1 in lengths:
                for i in range(a, b):
                    parts[w[:i] + w[i + 1:] if two_lengths else (i, w[:i] + w[i + 1:])].append(x)
        lists = parts.values()
    else:
        lists = (group,)
    for part in lists:
        if two_lengths:
            of = defaultdict(list)
            for x in part:
                of[len(x[0])].append(x)
            yield from ((x, y) for m, short in of.items() if m + 1 in of for x in short for y in of[m + 1] if near(x[0], y[0]))
        else:
            yield from ((x, y) for i, x in enumerate(part) for y in part[:i] if near(x[0], y[0]))


_LINK = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])


def near_pairs(vocabulary: DataFrame, qmax: int = QMAX, frequent: float = FREQUENT) -> DataFrame:
    """(word, n, other, other_n) for every ordered pair of near words of ``vocabulary`` (word, n)."""
    spark = vocabulary.sparkSession
    size = vocabulary.agg(F.sum(F.least(F.length("word"), F.lit(4 * PLACES)))).first()[0] or 0
    pruned = gram_dictionary(vocabulary, qmax, frequent)

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                out, held = ([], [], [], [], []), 0
                part = batch.slice(at, 1 << 13)
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for key, a, b in lookups(word, pruned, qmax):
                        for c, v in zip(out, (key, word, n, a, b)):
                            c.append(v)
                        held += len(word)
                        if held > 1 << 24:
                            yield _signed(out)
                            out, held = ([], [], [], [], []), 0
                if out[0]:
                    yield _signed(out)

    def meet(batches):
        last, group = 0, []  # a list may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cols, found = batch.column(0).to_numpy(), None, []
            if group and keys[0] != last:
                found.extend(_pairs(group, bool(last & 1)))
                group = []
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(starts[1:], len(keys))
            ends[-1] += 1  # whatever its length, the last list is kept for the next batch
            if group:
                ends[0] += 1
            for i in np.flatnonzero(ends - starts > 1).tolist():
                cols = cols or [batch.column(c).to_pylist() for c in range(1, 5)]
                s, e = int(starts[i]), int(starts[i + 1]) if i + 1 < len(starts) else len(keys)
                group += zip(*(c[s:e] for c in cols))
                if e < len(keys):
                    found.extend(_pairs(group, bool(keys[s] & 1)))
                    group = []
            last = int(keys[-1])
            if found:
                yield _links(found)
        if group and (found := list(_pairs(group, bool(last & 1)))):
            yield _links(found)

    parts = max(shuffle_partitions(spark), int(size * 3 / KEYS) + 1)
    sent = vocabulary.select("word", "n").mapInArrow(send, "key long, word string, n long, a int, b int")
    met = sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(meet, "word string, n long, other string, other_n long")
    return met.distinct()


def _signed(out):
    key = np.array(out[0], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()),
                                       pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32())], names=["key", "word", "n", "a", "b"])


def _links(found):
    both = [(x[0], x[1], y[0], y[1]) for x, y in found] + [(y[0], y[1], x[0], x[1]) for x, y in found]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*both), _LINK)], schema=_LINK)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2,
             times: int = 10, qmax: int = QMAX, frequent: float = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the near word of largest n is the form where it has ``times`` the
    word's n at least; root follows the forms to the last."""
    vocabulary = saved(words(docs, id_col, text_col, least_length, least_n))
    most = vocabulary.agg(F.max("n")).first()[0]
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other"))).alias("best")
    linked = near_pairs(vocabulary, qmax, frequent).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.minus") >= times * F.col("n")
    linked = saved(linked.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"),
                                 F.when(is_form, -F.col("best.minus")).alias("form_n")))
    # forms grow ``times``-fold at each step, so the longest way to a last form has this many steps
    steps = int(math.log(max(most or 1, 1)) / math.log(times)) + 1
    root = linked.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = saved(root.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return (vocabulary.join(linked, "word", "left").join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long")))
