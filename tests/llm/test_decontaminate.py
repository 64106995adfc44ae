import random
import re

import pyarrow as pa
import pytest

from pagefold.llm import decontaminate as D


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(texts, items, k=13):
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            x = words(item)
            for s in range(max(1, len(x) - k + 1)) if x else ():
                win = x[s:s + k]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        names.add(name)
        out.append((len(w), len(hit), sorted(str(n) for n in names if n is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def case(rng):
    items = [(i, " ".join(f"W{rng.randrange(30)}" for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)]
    items += [(3, items[5][1]), (None, items[6][1]), (90, None), (91, ""), (92, "...")]
    texts = [None, "", "--"]
    for _ in range(50):
        t = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))]
        if rng.random() < 0.7:
            x = (rng.choice(items)[1] or "").split()
            p, a = rng.randrange(len(t) + 1), rng.randrange(len(x) + 1)
            t[p:p] = x[a if rng.random() < 0.3 else 0:]
        texts.append(rng.choice([" ", ", ", "\n"]).join(t))
    return texts, items


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 200])
def test_phrases_against_brute_force(spark, chunk_bytes):
    texts, items = case(random.Random(chunk_bytes))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = D.build_index(df, segment_bytes=1500)
    rows = D.phrase_hits(index, spark.createDataFrame(items, "item_id long, text string"), chunk_bytes=chunk_bytes).collect()
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"], r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, items)


def test_near_matches(spark):
    df = spark.createDataFrame([(1, "alpha x x beta gamma"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "gamma. Beta alpha"),
                                (4, "beta gamma"), (5, "alpha"), (6, "beta gamma")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("q", "alpha beta gamma"), ("none", None)], "item_id string, text string")
    rows = D.near_hits(D.build_index(df), items, slop=4).collect()
    assert {(r["id"], r["item"]) for r in rows} == {(1, "q"), (3, "q")}  # not across documents 4 to 6


def test_segment_round_trip():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["b a b", "a c"]})
    seg = D.Segment(D.segment(5, batch, "doc_id", "text").to_pylist()[0])
    h, offs = D.words_of(batch.column("text"))
    for term in set(h.tolist()):
        first, count = seg.lookup(h[h == term][:1])
        assert seg.at[first[0]:first[0] + count[0]].tolist() == [i for i, x in enumerate(h.tolist()) if x == term]
    assert seg.offs.tolist() == offs.tolist()


def test_odd_rows_empty_tables_and_filter(spark, odd_docs):
    text = odd_docs.where("doc_id = 10").first()["text"]
    items = spark.createDataFrame([(1, " ".join(text.split()[:600])), (2, "one two")], "item_id long, text string")
    rows = D.contamination(odd_docs, items).collect()
    assert len(rows) == odd_docs.count()
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {7, 8, 10}
    kept = D.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 3, 4, 5, 6, 9, 11, 12]
    assert not any(r["contaminated"] for r in D.contamination(odd_docs, items.where("false")).collect())
    assert D.contamination(odd_docs.where("false"), items).collect() == []
