import random
import zlib
from collections import Counter, defaultdict

import pytest

from pagefold.llm import spelling as S

LETTERS = "abcé"


def brute(docs, least_length=7, least_n=2, times=10):
    """word -> (form, root, n, n_near, form_n) by the definition."""
    counts = Counter()
    for key, text in docs:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if c.isascii() else c
            if "a" <= c <= "z" or "\xc0" <= c <= "\xff":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}
    by_cut = defaultdict(set)
    for w in words:
        by_cut[w].add(w)
        for i in range(len(w)):
            by_cut[w[:i] + w[i + 1:]].add(w)
            by_cut[i, w[:i] + w[i + 1:]].add(w)
    out = {}
    for w, n in words.items():
        near = set().union(*(by_cut[i, w[:i] + w[i + 1:]] for i in range(len(w))), {x for x in by_cut[w] if len(x) == len(w) + 1},
                           {w[:i] + w[i + 1:] for i in range(len(w))} & set(words)) - {w}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= times * n else None, n, len(near))
    rows = {}
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, near, words[form] if form else None)
    return rows


def near_by_definition(words):
    found = set()
    for w in words:
        for i in range(len(w)):
            for x in (w[:i] + w[i + 1:], *(w[:i] + c + w[i + 1:] for c in "abc")):
                if x != w and x in words:
                    found.add(frozenset((w, x)))
    return found


@pytest.mark.parametrize("pruned,qmax", [((), 1), (("a",), 2), (("a", "b", "ab", "ba", "aa"), 3)])
def test_every_near_pair_meets_in_a_list(pruned, qmax, monkeypatch):
    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(900)}
    words |= {"a" * k for k in range(1, 300, 3)} | {"a" * k + "b" for k in range(1, 300, 2)} | {"ab" * k for k in range(1, 140)}
    words |= {"ab" * 100 + "c" + "ab" * k for k in range(30)} | {"ab" * 100 + "ab" * k for k in range(30)}
    for bound in (S.LIST, 2):  # also with lists split by their letters
        monkeypatch.setattr(S, "LIST", bound)
        lists = defaultdict(list)
        for w in words:
            for key, a, b in S.lookups(w, frozenset(pruned), qmax):
                lists[key].append((w, 1, a, b))
        got = {frozenset((x[0], y[0])) for key, g in lists.items() for x, y in S._pairs(g, bool(key & 1))}
        assert got == near_by_definition(words)


def test_lists_of_other_lengths_under_one_key(spark):
    """Two look-ups may have the same key; the longer pair must not be lost beside the shorter one."""
    rng = random.Random(11)

    def keys(size):
        words = ("".join(rng.choice("abcdefghijklm") for _ in range(size)) for _ in range(150_000))
        return {zlib.crc32(w.encode(), zlib.crc32(b"1 %d" % size)) & ~1 | 1: w for w in words}
    short, long = keys(7), keys(10)
    both = sorted(short.keys() & long.keys())
    assert both
    for extra in (0, 12):  # also in a list that is split by its letters
        a, b = short[both[0]], long[both[0]]
        for w in (a, b):
            assert (both[0], 0, len(w)) in S.lookups(w, frozenset(), 1) and (both[0], 0, len(w)) in S.lookups("x" + w, frozenset(), 1)
        words = [a, "x" + a, b, "x" + b] + [chr(97 + i) + a for i in range(13, 13 + extra) if i != 23]
        got = S.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), qmax=1).select("word", "other").collect()
        links = {frozenset(r) for r in got}
        assert {frozenset((a, "x" + a)), frozenset((b, "x" + b))} <= links
        assert links == {frozenset((v, w)) for v in words for w in words if S.near(v, w)}


def some_docs(seed, n_docs=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(7, 12))) for _ in range(60)]
    docs = []
    for d in range(n_docs):
        text = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.15)), 59)]
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", rng.choice(LETTERS), w[i] + rng.choice(LETTERS)]) + w[i + 1:]
            text.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((d, rng.choice([" ", ", ", "1"]).join(text)))
    return docs


def test_variants_against_brute_force(spark):
    docs = some_docs(1)
    docs += docs[:5] + [(None, docs[0][1]), (900, None), (901, ""), (None, None), (902, "ſimple Ābcdefgh ÀÖßÿ×÷÷÷ " * 3),
                        (903, "b" * 2_000 + " " + "b" * 2_001), (904, ("b" * 2_000 + "é ") * 2 + "b" * 2_000)]
    got = S.variants(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").repartition(3)).collect()
    want = brute(docs)
    assert len(got) == len(want) and len(got) > 200
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert any(r["root"] != r["form"] for r in got if r["form"])


def test_other_bounds_and_text_ids(spark):
    docs = [(f"d{i}", t) for i, t in some_docs(2, 60)]
    df = spark.createDataFrame(docs, "id string, body string")
    got = S.variants(df, "id", "body", least_length=5, least_n=1, times=3, qmax=3, frequent=0.05).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute(docs, 5, 1, 3)


def test_empty_tables(spark):
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert S.variants(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")).collect() == []
