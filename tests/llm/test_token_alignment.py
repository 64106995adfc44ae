import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagefold.llm import token_alignment as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Rows of the counted columns, one text after the other."""
    a_tok = Tokenizer.from_file(A_PATH)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte_of = {c: i for i, c in enumerate(A.byte_characters())}
    docs, held = [], Counter()
    for t in texts:
        groups = []
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            a_len = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
            b_len = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_len) == b"".join(b_len) == b" " + t.encode():
                i = j = x = y = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        left.append(a[i])
                        x += len(a_len[i])
                        i += 1
                    else:
                        right.append(b[j])
                        y += len(b_len[j])
                        j += 1
                    if x == y:
                        groups.append((left, right))
                        left, right = [], []
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        held.update(set(links))
        docs.append((groups, links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    rows = []
    for groups, links in docs:
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                     sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links),
                     hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return rows, held


def odd_texts():
    rng = random.Random(5)
    base = ["the quick brown fox", "die Straße und das Haus", "l'été à la plage", "one", "a <|endoftext|> b <s> </s> <0x41>", "x▁y", "",
            None, " lead and  trail ", "\t\n\r\n  tabs nbsp", "日本語のテキスト、中国話", "😀😀👩‍👩‍👧 emoji", "é combining ﬁ ligature ½", "\u0000nul\u0007",
            "=" * 700, "ab" * 900 + "一" * 90, "0123456789" * 40]
    words = [w for t in base[:5] + base[10:15] for w in t.split(" ")]
    base += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return base + base[:6]


def test_against_the_libraries(spark, monkeypatch):
    texts = odd_texts()
    want, held = brute(texts)
    df = spark.createDataFrame([(i if i % 9 else None, t, "x", 1, i) for i, t in enumerate(texts)],
                               "doc_id long, text string, block string, n_a int, place int").repartition(4)
    for links, wide, size in ((A.LINKS, A.WIDE, 2 << 20), (64, 3, 2000)):  # also with small bounds
        monkeypatch.setattr(A, "LINKS", links)
        monkeypatch.setattr(A, "WIDE", wide)
        al = A.Alignment(df, A_PATH, B_PATH, block_bytes=size)
        out = al.documents(ids=True)
        assert out.columns == ["doc_id", "block", "place", "a_ids", "b_ids", *A.COLUMNS]
        got = {r["place"]: r for r in out.collect()}
        assert [tuple(got[i][c] for c in A.COLUMNS) for i in range(len(texts))] == want
        assert {(r["a"], r["b"]): r["n_docs"] for r in al.pair_counts().collect()} == dict(held)
        assert all(len(got[i]["a_ids"]) == 4 * want[i][0] for i in range(len(texts)))
    assert 4 <= sum(w[0] == 0 for w in want) < 40 and any(w[3] > 3 * w[2] for w in want if w[2])


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.Generator(np.random.PCG64(n)).integers(0, 1 << 32, n, dtype=np.uint64))
    built = A.PerfectHash.from_bytes(A.PerfectHash.build(keys).to_bytes())
    assert len(built) == len(keys) and np.array_equal(np.sort(built.numbers(keys)), np.arange(len(keys)))
    assert n < 1000 or len(built.to_bytes()) < n * 1.0


def test_perfect_hash_with_a_rest(monkeypatch):
    monkeypatch.setattr(A.PerfectHash, "LEVELS", 2)
    keys = np.arange(5000, dtype=np.uint64)
    built = A.PerfectHash.from_bytes(A.PerfectHash.build(keys).to_bytes())
    assert len(built.rest) and np.array_equal(np.sort(built.numbers(keys)), np.arange(5000))


def test_strangers_are_refused():
    keys = np.arange(100, dtype=np.uint64)
    built = A.PerfectHash.build(keys)
    kept = np.empty(100, np.uint32)
    kept[built.numbers(keys)] = keys
    segment = A.Segment(built.to_bytes(), kept.tobytes(), None)
    with pytest.raises(RuntimeError):
        segment.numbers(np.array([5, 777], np.uint32))


def test_empty_table_and_no_tokens(spark):
    for rows in ([], [(1, None), (2, "")]):
        al = A.Alignment(spark.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH)
        assert sorted(tuple(r) for r in al.documents().collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]
        assert al.pair_counts().collect() == []


def test_fast_encoder_is_the_library():
    """What the shortcut for plain texts rests on: ranks in the order of the merges, and no entry that its own bytes do
    not merge to; then the same ids on texts of every kind of plain character."""
    import json
    with open(A_PATH, encoding="utf-8") as f:
        a_file = f.read()
    spec, pair = json.loads(a_file)["model"], A.Pair(a_file, open(B_PATH, "rb").read())
    order = [spec["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["merges"]]
    assert order == sorted(order) and len(order) + 256 == len(spec["vocab"])
    model, merged = pair.a.model, set(order)
    assert all([t.id for t in model.tokenize(s)] == [i] for s, i in spec["vocab"].items() if i in merged)
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "ß", "ſ", "'s", "'", "'ll", "12", "3", "_", "=", "-", "<|endoftext|>", "tion", " the", ".", "Ā", "\x0b"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(20_000)] + ["x" * 5000, " " * 5000, "ab " * 4000]
    assert sum(bool(A.PLAIN(t)) for t in texts) == len(texts)
    assert [pair._a_ids(t) for t in texts] == [e.ids for e in pair.a.encode_batch(texts, add_special_tokens=False)]
