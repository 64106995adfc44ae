"""BPE encoding and decoding of a tokenizer file of the ``tokenizers`` library.

A pre-token is a doubly linked list of symbols. A priority queue holds the rank of every
mergeable neighbour pair; the least rank, leftmost first, is merged, its new neighbours
are pushed, and an entry whose symbols have changed meanwhile is stale and skipped.
Decoding looks every id's string up and joins the strings the way the file says.

Supported are files with these parts: NFC, white space to one
space, lower case; a split pattern whose matches are kept; bytes as printable characters;
merges with an end-of-word suffix; special tokens that are cut out of the raw text. A file
with other parts is refused rather than read wrongly.

Which characters are letters, digits or white space, and what their lower case is, differs
between Unicode versions. Texts of plain characters (``PLAIN``), whose classes have never
changed, are normalised and split here; for all others the library that the file belongs to
normalises and splits, so that its tables count and not those of Python.

Pre-tokens repeat, so a task keeps what it worked out in a table of ``CACHE`` entries at
most, which starts over when it is full. That bounds memory and never changes a result.

Defined results: null text is encoded like the empty text (no ids, empty decoded text);
rows are independent, so ties, repeats and row order do not matter; texts of any length are
encoded whole; columns named like the new ones are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagefold.llm.words import worker_store

CACHE = 400_000
#: The usual split pattern, and the same for lower-cased texts of PLAIN characters.
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\u017f]+")
#: ASCII without control characters, and the letters of U+00C0 to U+017F but for one that lower-cases to two.
PLAIN = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*\Z").match


def byte_characters() -> list[str]:
    """A printable character for each byte: itself, or the next unused one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Vocabulary, merges and text rules of one file."""

    def __init__(self, data: str):
        spec = json.loads(data)
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split, to_bytes = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        model = spec["model"]
        if (steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
                or split.get("type") != "Split" or split["behavior"] != "Removed" or not split["invert"]
                or to_bytes.get("type") != "ByteLevel" or to_bytes["add_prefix_space"] or to_bytes["use_regex"]
                or model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["byte_fallback"]
                or model["continuing_subword_prefix"] or model["ignore_merges"] or spec["decoder"] or spec["post_processor"]
                or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
            raise ValueError("this tokenizer file has parts that are not supported")
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        # every byte has an id, alone and at the end of a word, so no symbol is unknown
        self.byte_ids = [self.vocab[c] for c in byte_characters()]
        self.last_ids = [self.vocab[c + suffix] for c in byte_characters()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.data, self.byte_of = data, {c: i for i, c in enumerate(byte_characters())}
        # the usual pattern, written out for the letters and digits that a plain text can have
        self.plain_pattern = PLAIN_PRETOKENS if split["pattern"]["Regex"] == USUAL_PATTERN else None
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def ids(self, pretoken: str) -> list[int]:
        """Ids of the merged symbols of one pre-token."""
        data = pretoken.encode("utf-8", "surrogatepass")
        symbols = [self.byte_ids[b] for b in data]
        symbols[-1] = self.last_ids[data[-1]]
        n = len(symbols)
        merges, merged = self.merges, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []  # rank of a pair, then the place of its first symbol, in one whole number
        for i in range(n - 1):
            rank = merges.get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if symbols[i] < 0 or j >= n or merges.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = merges.get(symbols[i] << 32 | symbols[k])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = merges.get(symbols[h] << 32 | symbols[i])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    @cached_property
    def library(self):
        """The library's normaliser and splitter of the file, opened at the first text that needs them."""
        from tokenizers import Tokenizer as Library
        own = Library.from_str(self.data)
        return own.normalizer, own.pre_tokenizer

    @staticmethod
    def plain(text: str) -> bool:
        """Only characters that are normal forms already, and white space that ``split`` knows as well: no
        pre-token crosses white space, so such a text can be lower-cased, split and looked up by chunk."""
        return PLAIN(text) is not None

    def pretokens(self, text: str) -> list[str]:
        """Of text without special tokens."""
        if self.plain_pattern and self.plain(text):
            return self.plain_pattern.findall(text.lower())
        normalizer, splitter = self.library
        parts = splitter.pre_tokenize_str(normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in part]).decode("utf-8") for part, _ in parts]

    def parts(self, text: str):
        """(special token or None, the raw text between) in order."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield None, text[at:m.start()]
            yield m[0], ""
            at = m.end()
        yield None, text[at:] if at else text

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids; the file names no decoder, so a space joins them."""
        return " ".join(self.strings[i] for i in ids)


def load(path: str) -> str:
    """Contents of the tokenizer file, read where the job is written and sent along with it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def in_worker(data) -> Tokenizer:
    """The tokenizer of a broadcast file, opened once per Python worker."""
    store = worker_store()
    key = f"bpe_{hash(data.value)}"
    if not hasattr(store, key):
        setattr(store, key, Tokenizer(data.value))
    return getattr(store, key)


class Cached:
    """What ``make`` gives for a key, in a table that starts over at ``CACHE`` entries."""

    def __init__(self, make):
        self.make, self.held = make, {}

    def all(self, keys: list[str]) -> list:
        try:
            return [self.held[k] for k in keys]
        except KeyError:
            if len(self.held) > CACHE:
                self.held.clear()
            for k in set(keys).difference(self.held):
                self.held[k] = self.make(k)
            return [self.held[k] for k in keys]


class Encoder:
    """Ids (as bytes) and decoded string of a text."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.pieces = Cached(self._piece)
        self.chunks = Cached(self._chunk)

    def _piece(self, pretoken: str) -> tuple[bytes, str]:
        ids = self.tok.ids(pretoken)
        return np.array(ids, "<u4").tobytes(), self.tok.decode(ids)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        got = self.pieces.all(self.tok.pretokens(chunk))
        return got[0] if len(got) == 1 else (b"".join([r for r, _ in got]), " ".join([d for _, d in got]))

    def encode(self, text: str) -> tuple[bytes, str]:
        out = []
        for special, raw in self.tok.parts(text):
            if special is not None:
                out.append((np.array([self.tok.special[special]], "<u4").tobytes(), special))
            elif self.tok.plain(raw):
                out.extend(self.chunks.all(raw.lower().split()))
            else:
                out.extend(self.pieces.all(self.tok.pretokens(raw)))
        return b"".join([r for r, _ in out]), " ".join([d for _, d in out])


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` (long), ``ids`` (binary, little-endian unsigned 32-bit integers, as token
    shards hold them) and ``decoded`` (string)."""
    new = ("n_tokens", "ids", "decoded")
    df = df.drop(*new)
    data = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))  # a file of fixed size
    schema = T.StructType(df.schema.fields + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                                              T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        store = worker_store()
        key = f"encoder_{hash(data.value)}"
        if not hasattr(store, key):
            setattr(store, key, Encoder(in_worker(data)))
        encoder = getattr(store, key)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for i in range(0, batch.num_rows, 256):
                got = [encoder.encode(t.as_py() or "") for t in texts[i:i + 256]]
                cols = [c.slice(i, 256) for c in batch.columns] + [
                    pa.array([len(r) // 4 for r, _ in got], pa.int64()), pa.array([r for r, _ in got], pa.binary()),
                    pa.array([d for _, d in got], pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of the packed ids in ``ids_col`` (null: null)."""
    df = df.drop("decoded")
    data = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    schema = T.StructType(df.schema.fields + [T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        tok = in_worker(data)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            out = [None if x is None else tok.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            cols = [*batch.columns, pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return df.mapInArrow(run, schema)
