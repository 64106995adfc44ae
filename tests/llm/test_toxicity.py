import zlib

import numpy as np
from pyspark.sql import functions as F

from pagefold.llm import toxicity as X
from pagefold.llm.queries import QUERIES

SF1 = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    rows = QUERIES["op9_toxicity"](spark, SF1)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    held = rows.join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in held)
    held = [r for r in held if r["held_out"]]
    hits = sum(r["predicted"] and r["toxic"] for r in held)
    assert hits >= 0.7 * sum(r["toxic"] for r in held) and hits >= 0.8 * sum(r["predicted"] for r in held)


def test_label_model_counts_copies_of_a_voter_once():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.2
    noisy = np.where(rng.random(n) < 0.15, ~y, y)
    own = [np.where(rng.random(n) < 0.1, ~y, y) for _ in range(2)]
    votes = np.stack([noisy, noisy, noisy, *own], 1)  # three copies of the worst voter
    bits = (votes << np.arange(5)).sum(1)
    patterns, at = np.unique(bits, return_inverse=True)
    counts = np.bincount(at).astype(float)
    labelled = np.zeros((len(patterns), 2))
    np.add.at(labelled, (at[:600], y[:600].astype(int)), 1)
    model = X.LabelModel(patterns, counts, labelled, 5)
    post = dict(zip(patterns.tolist(), model.posterior(patterns)))
    assert post[0b11000] > 0.5 > post[0b00111]  # two good voters outweigh the copies
    assert abs(model.prior[1] - 0.2) < 0.05


def test_features_and_votes_agree():
    import pyarrow as pa
    texts = ["You IDIOT, you moron!!!", "", None, "harmless words", "WE SHOUT NOW"]
    voters = X.Voters(X.mine([], np.zeros(0, int)))
    arr = pa.array(texts, pa.string())
    votes = voters.votes(arr)
    assert votes.tolist() == [voters.of_features(f, int(s)) for f, s in zip(X.features_of(arr), X.surface(arr))]
    assert votes[0] & 1 and not votes[3] and votes[1] == votes[2] == 0


def test_odd_rows(spark, odd_docs):
    insult = spark.createDataFrame([(50, "such an idiot and moron", "en", "a", 0, 1, 1.0)], odd_docs.schema)
    docs = odd_docs.union(insult)
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (None, 1), (10, None), (777, 1)], "doc_id long, toxic int")
    for some in (labels, labels.where("false")):
        rows = X.score(docs, X.fit(docs, some)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if not (r["text"] or "").split()}) == 1
    assert next(r for r in rows if r["doc_id"] == 50)["score"] >= 0.3  # without labels the word list votes
    kept = X.drop_toxic(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.where("doc_id = 50").isEmpty() and kept.count() == docs.count() - 1
    assert X.score(docs.where("false"), X.fit(docs.where("false"), labels)).collect() == []


def test_long_sparse_fit_separates():
    rng = np.random.default_rng(1)
    rows, target = [], []
    for i in range(600):
        bad = i % 8 == 0
        rows.append(np.unique(np.concatenate([rng.integers(100, 5000, 60), [7] if bad else []])).astype(np.int32))
        target.append(0.95 if bad else 0.02)
    ids, weights, base = X.train([r.astype(np.uint32) for r in rows], np.array(target))
    assert weights[ids == 7] > 2 and len(ids) < 20 and base < 0


def test_rank_of_scores_ignores_other_columns(spark, odd_docs):
    model = X.fit(odd_docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    a = X.score(odd_docs.select("doc_id", "text"), model).agg(F.sum("score")).first()[0]
    b = X.score(odd_docs.withColumn("lang", F.lit("zz")), model).agg(F.sum("score")).first()[0]
    assert a == b


def test_all_labels_and_unlabelled_rows_teach(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 20)) + (" zorgblat" if i % 20 == 0 else "") for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 20 == 0).cast("int").alias("toxic"))
    asked = spark.createDataFrame([(0, "w1 w2 zorgblat"), (1, "w1 w2 w3")], "doc_id long, text string")
    few = X.fit(docs, labels, sample=20)  # shows the word in fewer than three rows
    bad, fine = (r["score"] for r in X.score(asked, few).orderBy("doc_id").collect())
    assert bad >= 0.5 and fine < 0.3
    half = X.fit(docs, labels.where("doc_id < 1000"), sample=10, unlabelled=900)
    bad, fine = (r["score"] for r in X.score(asked, half).orderBy("doc_id").collect())
    assert bad >= 0.5 and fine < 0.3


def test_one_row_per_id_reaches_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 4, f"some words {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen, train = [], X.train
    monkeypatch.setattr(X, "train", lambda rows, target: seen.append(len(rows)) or train(rows, target))
    X.fit(docs, labels)
    X.fit(docs, labels, sample=2, unlabelled=0)
    assert seen == [4, 2]
