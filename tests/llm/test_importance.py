import numpy as np
from . import SF01
from pyspark.sql import functions as F

from pagefold.llm import importance as I


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(0)
    sums = [*rng.normal(0, 1e3, 300).tolist(), 0.0, -0.0, 5.0, 5.0, 5.0, 1e-300, -1e300]
    df = spark.createDataFrame([(s,) for s in sums], "sum double").repartition(3)
    order = sorted(sums, reverse=True)
    for k in (1, 2, 150, len(sums)):
        assert I.kth_largest(df, k) == order[k - 1]
    assert I.kth_largest(df, len(sums) + 1) is None


def test_weights_against_brute_force(spark):
    import pyarrow as pa
    texts = ["a b a b a", "", "B c\nd", "a"]
    ids, doc, n = I._grams(pa.array(texts))
    assert n == 4 and np.bincount(doc, minlength=4).tolist() == [5 + 4 + 3, 0, 3 + 2 + 1, 1]
    assert ids[0] == ids[2] == ids[8] >= 2  # a, by documents in order
    assert ids[-4:].tolist() == [0, 0, 1, 0]  # the trigrams: a b a comes again
    ratio = np.arange(I.BUCKETS) / 100
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i long, text string")
    got = {r["i"]: r["log_weight"] for r in I.weigh(df, ratio).collect()}
    want = np.bincount(doc, ratio[ids], minlength=4)
    assert got[9] == 0 and all(abs(got[i] - want[i]) < 1e-9 for i in range(4))


def test_held_out_labels(spark):
    from pagefold.llm.queries import QUERIES
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = QUERIES["op5_importance"](spark, SF01)
    assert rows.columns[0] == "doc_id" and rows.columns[-1] == "kept"
    held = rows.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    share = lambda q: np.mean([r["kept"] for r in held if r["quality"] == q])
    assert share(1) > 0.85 and share(0) < 0.5


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (10, 0), (11, 0), (None, 1), (12, None), (2, 1), (2, 0)], "doc_id long, quality int")
    rows = I.resample(odd_docs, labels, k=5).collect()
    assert len(rows) == odd_docs.count() and sum(r["kept"] for r in rows) >= 5
    assert {r["log_weight"] for r in rows if not (r["text"] or "").split()} == {0.0}
    assert all(r["kept"] for r in I.resample(odd_docs, labels, k=10**6).collect())
    assert not any(r["kept"] for r in I.resample(odd_docs, labels, k=0).collect())
    uniform = I.resample(odd_docs, labels.where("false"))
    assert {r["log_weight"] for r in uniform.collect()} == {0.0}
    assert I.resample(odd_docs.where("false"), labels).collect() == []


def test_share_counts_all_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 37).cast("int").alias("quality"))
    for sample in (1, 3, 1000):  # of the labels, for the target model only
        assert I.resample(docs, labels, sample=sample).where("kept").count() == 37
