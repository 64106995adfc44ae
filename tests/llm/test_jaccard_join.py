import random

import numpy as np
import pytest
from .test_components import least_members

import pagefold.llm.jaccard_join as J


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and
             100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = least_members(links)
    return [(len(s), label.get(i, i)) for i, s in enumerate(sets)], len(links)


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"z{rng.randrange(999)}" for w in text.split())


def corpus(rng):
    texts = []
    for size in (1, 3, 5, 7, 12, 25, 60, 150, 400):
        for _ in range(5):
            base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(size, 2 * size)))
            texts += [base] + [edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03])) for _ in range(4)]
    return texts


@pytest.mark.parametrize("chunk", [1024, 4])
def test_random_texts_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "POINT_CHUNK", max(chunk, 30) if chunk > 4 else 3)
    texts = corpus(random.Random(chunk))
    want, links = brute(texts)
    assert links > 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, block_bytes=20_000).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_contents_meet_for_every_linked_pair():
    import pyarrow as pa
    texts = corpus(random.Random(9))
    sets, offs = J.shingle_sets(pa.array(texts))
    doc, key = J.contents(sets, offs)
    sent = [set(key[doc == i]) for i in range(len(texts))]
    own = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if own[i] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                assert sent[i] & sent[j]


def test_tree_bound_keeps_every_near_point():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(20, 120), replace=False)) for _ in range(200)]
    sets += [np.unique(np.concatenate([s[:-2], rng.integers(0, 2**63, 2).astype(np.uint64)])) for s in sets]
    size = np.array([len(s) for s in sets])
    tree = J.CountTree(J.points_of(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), 32), size)
    assert len(tree.levels) == 2
    for i in range(0, len(sets), 7):
        near = set(tree.near(tree.points[i], len(sets[i])).tolist())
        for j, s in enumerate(sets):
            both = len(np.intersect1d(sets[i], s))
            assert j in near or 9 * both < 4 * (len(s) + len(sets[i]))


def test_odd_rows(spark, odd_docs):
    rows = J.jaccard_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1
    assert by_id[7] == by_id[8] == 7 and by_id[9] == 9
    assert all(by_id[i] == i for i in (4, 5, 6, 10, 11, 12))
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = J.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 10, 11, 12]


def test_empty_table(spark, odd_docs):
    assert J.jaccard_components(odd_docs.where("false")).collect() == []


def shared_passage(rng, docs):
    """Unlike texts of 300 words around one passage of 40, then two of them with a few words changed."""
    word = lambda: f"w{rng.randrange(50000)}"
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join([word() for _ in range(150)] + [passage] + [word() for _ in range(150)]) for _ in range(docs)]
    return texts + [edited(rng, t, 0.01) for t in texts[:2]]


def test_a_passage_of_many_documents_brings_none_of_them_together():
    import pyarrow as pa
    texts = shared_passage(random.Random(4), 60) + corpus(random.Random(5))
    sets, offs = J.shingle_sets(pa.array(texts))
    n = np.diff(offs)
    doc, key, level = J.leveled_contents(sets, offs)
    _, entry, times = np.unique(key, return_inverse=True, return_counts=True)
    held = np.where(times[entry] > 1, times[entry], 0)
    need = J.rarest(n, doc, key, level, held)
    alone = (doc >= 2) & (doc < 60)
    assert (held[alone] > 0).sum() > 58 and not need[alone].any()
    sent = [set(key[need & (doc == i)]) for i in range(len(texts))]
    own = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if own[i] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])]
    assert len(linked) > 60 and all(sent[i] & sent[j] for i, j in linked)


def test_points_that_all_link_are_searched_once(monkeypatch):
    rng = np.random.default_rng(3)
    point = rng.integers(1, 9, J.POINT_DIMS)
    tree = J.CountTree(np.repeat(point[None], 500, 0), np.full(500, point.sum()))
    near, asked = J.CountTree.near, []
    monkeypatch.setattr(J.CountTree, "near", lambda self, q, n: (asked.append(1), near(self, q, n))[1])
    assert len(tree.forest(None)) == 499 and len(asked) == 1


@pytest.mark.parametrize("sides", [False, True])
def test_forest_connects_what_all_links_connect(sides):
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 2**63, m).astype(np.uint64)) for m in (12, 30, 31, 80) for _ in range(8)]
    sets = [np.unique(np.concatenate([s[int(rng.integers(0, len(s) // 5 + 1)):],
                                      rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)])) for s in base for _ in range(9)]
    side = rng.integers(0, 2, len(sets)) if sides else None
    true = [(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j])
            and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
    links = J.link_forest(sets, side)
    assert set(links) <= set(true) | {(j, i) for i, j in true}
    assert least_members(links) == least_members(true) and len(links) < len(sets) and len(true) > len(links)


def test_answers_to_many_blocks_leave_together():
    import pyarrow as pa
    key = np.arange(1, 4, dtype=np.uint64)
    rows = [(0, i, key[:2 + i % 2].tobytes(), bytes(2 + i % 2), np.ones(2 + i % 2, np.uint32).tobytes()) for i in range(300)]
    rows.append((0, 300, np.uint64(9).tobytes(), bytes(1), np.ones(1, np.uint32).tobytes()))
    sent = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=J._SENT.names)]).cast(J._SENT)
    found = list(J._meet()(iter(sent.to_batches(max_chunksize=70))))
    assert len(found) == 1 and found[0].column("block").to_pylist() == list(range(300))
    for i, x in enumerate(found[0].column("held").to_pylist()):
        held = np.frombuffer(pa.decompress(x, 4 * (2 + i % 2), codec="zstd", asbytes=True), np.uint32)
        assert held.tolist() == [300, 300, 150][:2 + i % 2]
