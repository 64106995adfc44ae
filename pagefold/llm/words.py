"""Words of whole text columns as numpy arrays: spans and 64-bit hashes.

Runs inside tasks on the UTF-8 buffer of an Arrow string array, so a block of documents
is cut into words without a Python loop over words. Every byte above 0x7F belongs to a
word under each of the rules used here, so working on bytes equals working on code points.

Word hash: a polynomial over randomly drawn 64-bit byte values (prefix sums, one
subtraction per word), then a full-avalanche finaliser. Window hash: words are combined
pairwise by doubling with the finaliser between levels, so order matters and no algebraic
structure of the polynomial survives. Two seeds give 128 bits where a decision rests on
the hash alone.
"""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def space_rule() -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+``: True for the bytes of a word."""
    lut = np.ones(256, bool)
    lut[[0x20, *range(0x09, 0x0E)]] = False
    return lut


def alnum_rule() -> np.ndarray:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of A-Z lower-cased text."""
    lut = np.zeros(256, bool)
    lut[0x30:0x3A] = lut[0x41:0x5B] = lut[0x61:0x7B] = lut[0x80:] = True
    return lut


def byte_values(lower: bool) -> np.ndarray:
    """Random 64-bit value per byte; with ``lower`` A-Z share the values of a-z."""
    t = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Full-avalanche 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def worker_store() -> types.ModuleType:
    """A module that lives as long as the Python worker, for caches shared by its tasks."""
    return sys.modules.setdefault("_pagefold_llm_store", types.ModuleType("_pagefold_llm_store"))


def give_back() -> None:
    """Return freed memory to the system. Python workers live on after a task, and the allocators keep what the
    arrays of one block took; a C library without ``malloc_trim`` keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def make_room() -> None:
    """For tasks that use no tokenizer: what the tasks of another operator have left in this worker goes, all but the
    powers of the hashes. A tokenizer's tables take hundreds of megabytes, and a worker lives on from one operator to
    the next."""
    left = [k for k in vars(worker_store()) if not k.startswith("__") and k != "powers"]
    for k in left:
        delattr(worker_store(), k)
    if left:
        give_back()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    store = worker_store()
    have = getattr(store, "powers", None)
    if have is None or len(have[0]) < n:
        n = max(n, 2 * SLICE_BYTES)
        up = np.cumprod(np.full(n, _BASE, _U))
        down = np.cumprod(np.full(n, _BASE_INV, _U))
        have = store.powers = (up, down)
    return have


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the offsets of its values; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    raw = arr.buffers()
    if len(arr) == 0 or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(raw[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offs[0]:offs[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words never cross a document."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = lut[buf]
    brk = np.zeros(n + 1, bool)
    brk[offs] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | brk[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | brk[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _slices(offs: np.ndarray):
    """Document ranges of about SLICE_BYTES, to keep the 64-bit arrays in cache."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hashed_words(arr, lut: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets of the documents' words)."""
    buf, offs = text_buffer(arr)
    hashes, ends = [], [np.zeros(1, np.int64)]
    done = 0
    for i, j in _slices(offs):
        b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        s, e = spans(b, o, lut)
        up, down = _powers(len(b) + 1)
        run = values[b]
        run *= up[:len(b)]
        run = np.cumsum(run, out=run)
        h = run[e - 1] if len(e) else np.zeros(0, _U)
        inner = s > 0
        h[inner] -= run[s[inner] - 1]
        h *= down[s]
        hashes.append(mix(h))
        ends.append(np.searchsorted(s, o[1:]) + done)
        done += len(s)
    return (np.concatenate(hashes) if hashes else np.zeros(0, _U)), np.concatenate(ends)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _U(0xD6E8FEB86659FD93)
    x += b
    return mix(x)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each position on; length ``len(h) - k + 1`` or 0.
    Windows over the end of a document are for the caller to leave out."""
    n = len(h)
    if n < k or k < 1:
        return np.zeros(0, _U)
    level = mix(h ^ _U((seed * 0x2545F4914F6CDD1D + k) & (2**64 - 1)))
    size, acc, got = 1, None, 0
    while True:
        if k & size:
            if acc is None:
                acc = level
            else:
                m = n - got - size + 1
                acc = _join(acc[:m], level[got:got + m])
            got += size
        if got == k:
            return acc
        level = _join(level[:len(level) - size], level[size:])
        size *= 2


def in_document(offs: np.ndarray, n: int) -> np.ndarray:
    """Document index of each of n words."""
    return np.repeat(np.arange(len(offs) - 1, dtype=np.int64), np.diff(offs))[:n]


def range_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 64-bit hash by its leading bits: sorted hashes give sorted buckets."""
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
