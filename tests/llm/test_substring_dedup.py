import random
from collections import Counter

import pytest
from . import SF001
from pyspark.sql import functions as F

from pagefold.llm.substring_dedup import COVERS, cover_for, dedup_substrings


def brute(texts, w):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(s[i:i + w]) for s in split for i in range(len(s) - w + 1))
    out = []
    for s in split:
        keep = [True] * len(s)
        for i in range(len(s) - w + 1):
            if seen[tuple(s[i:i + w])] > 1:
                keep[i:i + w] = [False] * w
        out.append((len(s), keep.count(False), b" ".join(x for x, k in zip(s, keep) if k).decode()))
    return out


def test_covers_are_difference_covers():
    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert cover_for(35)[0] == 21 and cover_for(2)[0] == 1


@pytest.mark.parametrize("window", [2, 6, 35])
def test_random_texts(spark, window):
    rng = random.Random(window)
    texts = []
    for i in range(60):
        t = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 120))]
        if texts and rng.random() < 0.5:  # a passage of an earlier text at any offset
            s = rng.choice(texts).split()
            a = rng.randrange(len(s) + 1)
            p = rng.randrange(len(t) + 1)
            t[p:p] = s[a:a + rng.randrange(3 * window)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = {r["i"]: (r["n_words"], r["n_removed"], r["kept_text"])
           for r in dedup_substrings(df, window_words=window, block_bytes=4000).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_odd_rows_and_empty_table(spark, odd_docs):
    rows = dedup_substrings(odd_docs).collect()
    want = brute([r["text"] for r in odd_docs.collect()], 35)
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in rows) == sorted(want)
    assert set(odd_docs.columns) | {"n_removed", "kept_text"} == set(rows[0].asDict())
    assert dedup_substrings(odd_docs.where("false")).collect() == []


def test_query_against_brute_force(spark):
    from pagefold.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    want = {d["doc_id"]: w[:2] for d, w in zip(docs, brute([d["text"] for d in docs], 35))}
    rows = QUERIES["op1_substring_dedup"](spark, SF001)
    assert rows.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows.collect()} == want
    assert rows.where(F.length("kept_sha256") != 64).isEmpty()
