import types

import corpus_pipeline as P
import pyarrow as pa
import pytest
from . import SF001
from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as near
from .test_substring_dedup import brute as repeated

import __spark_entry__ as E
from pagefold.llm import words as W

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_queries_are_registered():
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [n for n, _ in P.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "decontaminate", "bpe"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after every stage over a whole small table."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [docs.select(DOCUMENT).collect()]
    for _, stage in P.STAGES:
        rows = stage(spark, docs, SF001)
        out.append(rows.collect())
        docs = spark.createDataFrame(out[-1], rows.schema).repartition(3)
    return out


def test_each_stage_against_brute_force(spark, stages):
    start, clean, unique, cut, kept, tokens = stages
    from pagefold.llm import toxicity as X
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"), learn_from=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    bad = {r["doc_id"] for r in X.score(docs, model).where("score >= 0.3").collect()}
    assert sorted(map(tuple, clean)) == sorted(tuple(r) for r in start if r["doc_id"] not in bad)

    clean = sorted(clean, key=lambda r: r["doc_id"])
    labels, _ = near([r["text"] for r in clean])
    assert sorted(map(tuple, unique)) == [tuple(r) for i, r in enumerate(clean) if labels[i][1] == i]

    unique = sorted(unique, key=lambda r: r["doc_id"])
    want = []
    for r, (_, gone, text) in zip(unique, repeated([r["text"] for r in unique], 35)):
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text)) if gone else tuple(r))
    assert sorted(map(tuple, cut)) == want

    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    cut = sorted(cut, key=lambda r: r["doc_id"])
    flags = [c[3] for c in contaminated([r["text"] for r in cut], items)]
    assert sorted(map(tuple, kept)) == [tuple(r) for r, f in zip(cut, flags) if not f]
    assert sorted(r["doc_id"] for r in tokens) == sorted(r["doc_id"] for r in kept)


def test_a_tokenizer_leaves_the_worker_to_the_next_operator(monkeypatch):
    from pagefold.llm import decontaminate, jaccard_join, substring_dedup, toxicity
    texts = pa.array(["one two three", None, ""])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for use in (lambda: jaccard_join.shingle_sets(texts), lambda: decontaminate.words_of(texts),
                lambda: substring_dedup._Words(texts, 35), lambda: list(toxicity._pieces([batch], "text"))):
        store = types.ModuleType("store")
        store.powers, store.encoder_1 = W._powers(10), bytes(10)
        monkeypatch.setattr(W, "worker_store", lambda: store)
        use()
        assert not hasattr(store, "encoder_1") and hasattr(store, "powers")


def test_run_gives_the_last_stage(spark, stages):
    rows = P.run(spark, SF001).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows) == sorted((r["doc_id"], r["ids_sha256"]) for r in stages[-1])


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs):
    for docs in (odd_docs, odd_docs.where("false")):
        for i, (_, stage) in enumerate(P.STAGES):
            rows = stage(spark, docs, SF001)
            got = rows.collect()
            assert len(got) <= docs.count()
            if i < len(P.STAGES) - 1:
                assert rows.columns == docs.columns and [f.dataType for f in rows.schema] == [f.dataType for f in docs.schema]
