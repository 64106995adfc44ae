import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from . import SF001
from tokenizers import Tokenizer

from pagefold.llm import bpe
from pagefold.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [chr(c) for c in [*range(0x250), 0x3A3, 0x3C2, 0x300, 0x301, 0x1680, 0x2003, 0x200B, 0x2028, 0x3000, 0xAC00, 0x1100, 0x1161,
                        0x4E2D, 0x1F600, 0xFEFF, 0x2126, 0x212B, 0xFB01, 0x660, 0x2167, 0x1E9E, 0x10400, 0x200D]]
ODD += ["'s", "'LL", " the ", "<|endoftext|>", "<|startoftext|>", "ΟΔΟΣ", "hello world"] * 6


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_odd_strings_like_the_library(library):
    rng, encoder = random.Random(2), bpe.Encoder(bpe.Tokenizer(bpe.load(PATH)))
    for _ in range(3000):
        s = "".join(rng.choice(ODD) for _ in range(rng.randrange(30)))
        raw, decoded = encoder.encode(s)
        want = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want, repr(s)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_every_code_point_like_the_library(library):
    """Letters, digits, white space and lower case by the library's tables, whatever Python's are."""
    points = [c for c in (*range(0x32400), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF) if not 0xD800 <= c <= 0xDFFF]
    encoder = bpe.Encoder(bpe.Tokenizer(bpe.load(PATH)))
    texts = [f"a{chr(c)}b1" for c in points]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [c for c, t, ids in zip(points, texts, want) if np.frombuffer(encoder.encode(t)[0], "<u4").tolist() != ids] == []


def test_full_tables_start_over(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    encoder = bpe.Encoder(bpe.Tokenizer(bpe.load(PATH)))
    for s in ("one two three four five six", "seven eight", "one nine ten", "one two"):
        assert np.frombuffer(encoder.encode(s)[0], "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(bpe.load(public_tokenizers.path("byte_bpe_50k.json")))


def test_encode_decode_and_count_odd_rows(spark, odd_docs, library):
    texts = sorted(r["text"] or "" for r in odd_docs.collect())
    want = sorted((t, library.encode(t, add_special_tokens=False).ids) for t in texts)
    rows = bpe.encode(odd_docs, PATH)
    again = bpe.decode(rows.withColumnRenamed("decoded", "first"), PATH).collect()
    assert sorted((r["text"] or "", np.frombuffer(r["ids"], "<u4").tolist()) for r in again) == want
    assert all(r["first"] == r["decoded"] and r["n_tokens"] * 4 == len(r["ids"]) for r in again)
    counted = token_counts(odd_docs, PATH, block_bytes=5000)
    assert set(counted.columns) == {*odd_docs.columns, "n_bytes", "n_tokens"}
    assert sorted((r["text"] or "", r["n_tokens"], r["n_bytes"]) for r in counted.collect()) == sorted(
        (t, len(ids), len(t.encode())) for t, ids in want)
    for empty in (bpe.encode(odd_docs.where("false"), PATH), token_counts(odd_docs.where("false"), PATH)):
        assert empty.collect() == []


def test_queries_like_the_library(spark, library):
    from pagefold.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {tuple(r) for r in QUERIES["op3_bpe"](spark, SF001).collect()} == {
        (i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    assert {tuple(r) for r in QUERIES["op7_token_counts"](spark, SF001).collect()} == {
        (i, len(docs[i].encode()), len(x), len(x) > 2048) for i, x in ids.items()}
