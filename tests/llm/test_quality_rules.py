import math
import re
from collections import Counter

import pyarrow as pa
from . import SF001, SF01
from pyspark.sql import functions as F

from pagefold.llm import quality_rules as Q
from pagefold.llm.queries import QUERIES


def brute(text):
    text = text or ""
    w = text.encode().split()
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_counts_against_brute_force(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()] + [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    texts += ["a b c d e f a b c d e f", "x\nx \n\n \nx", "a a a a a a a", "é#é% <|>"]
    got = Q.text_counts(pa.array(texts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in Q.COUNTS[:5]))) == [brute(t) for t in texts]


def test_exact_binomial_tail():
    for n, p in ((1, 0.3), (12, 0.05), (40, 0.5)):
        for x in range(n + 1):
            want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(x + 1))
            assert abs(Q.binomial_tail(x, n, p) - want) < 1e-9
    assert Q.binomial_tail(0, 10**6, 0.01) < 1e-300 and Q.binomial_tail(0, 0, 0.1) == 1.0


def test_cutoffs_stop_at_the_first_that_fails():
    assert Q.select_cutoff([3, 2, 1], [0, 0, 0], [0, 5, 5], 1000, 0.01, 0.01) == 2  # the most lenient of equals
    assert Q.select_cutoff([3, 2, 1], [0, 50, 50], [0, 90, 99], 1000, 0.01, 0.01) is None
    assert Q.select_cutoff([3, 2, 1], [0, 0, 0], [9, 9, 9], 20, 0.01, 0.01) is None  # too few labels


def test_query_base_columns_and_risk(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, SF01)
    assert rows.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = rows.collect()
    assert {tuple(r)[:6] for r in got} == {(i, *brute(t)) for i, t in docs.items()}
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_rules_learn_what_goes_with_bad_labels(spark):
    rows = [(i, "xx" if i % 2 else None, " ".join([f"w{i:04d}{j:02d}{'#' if i % 10 == 0 else 'x'}" for j in range(30)])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    counted = Q.with_counts(docs, keep=["doc_id", "lang"]).cache()
    cutoffs = Q.calibrate(counted, labels)
    assert {(r["rule"], r["none"]) for r in cutoffs.collect()} == {("symbols", True)}  # bad ones are even, without a stratum
    judged = Q.judge(counted, cutoffs).collect()
    assert len(judged) == 4000 and all(r["kept"] == (r["doc_id"] % 10 != 0) for r in judged)


def test_odd_rows(spark, odd_docs):
    counted = Q.with_counts(odd_docs)
    none = Q.calibrate(counted, spark.createDataFrame([], "doc_id long, quality int"))
    rows = Q.judge(counted, none).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] != r["base_failed"] for r in rows)
    empty = counted.where("false")
    assert Q.judge(empty, Q.calibrate(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).collect() == []
