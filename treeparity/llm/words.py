"""Vectorised word splitting, word and shingle hashing, and MinHash on whole Arrow batches.

A block of texts is joined to one byte buffer and hashed with a polynomial over random byte
values modulo 2**64, taken from one prefix sum, so that the cost is a few numpy calls per block
and not a Python step per word. Long texts are cut at delimiters: memory is bounded by
``SEGMENT`` and by eight bytes per word, whatever the length of a text.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(int(_rng.integers(1 << 62, 1 << 63)) | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.uint64(int(_rng.integers(1 << 62, 1 << 63)) | 1)
_powers: list[np.ndarray] = []


class Alphabet:
    """Which bytes delimit words, and A-Z folded to a-z."""

    def __init__(self, delimiters: Iterable[int]):
        self.delim = np.zeros(256, bool)
        self.delim[list(delimiters)] = True
        fold = np.arange(256)
        fold[65:91] += 32
        self.delim[65:91] = self.delim[97:123]
        self.value = _VALUES[fold]
        self.split = re.compile(b"[" + b"".join(re.escape(bytes([i])) for i in np.flatnonzero(self.delim)) + b"]")
        self.lower = bytes(fold.tolist())

    def words(self, text: bytes) -> list[bytes]:
        """The words themselves, for an exact look."""
        return [w for w in self.split.split(text.translate(self.lower)) if w]


#: Words are runs of anything but ASCII white space.
SPACED = Alphabet([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters and digits and of all that is not ASCII.
ALNUM = Alphabet([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(SEGMENT * 2, 1 << int(n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    return _powers


def _segment(buf: bytes, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(buf, np.uint8)
    n = len(b)
    up, down = _power_tables(n + 1)
    outside = np.ones(n + 2, np.int8)
    outside[1:-1] = alphabet.delim[b]
    edges = np.flatnonzero(np.diff(outside))
    starts, ends = edges[0::2], edges[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(alphabet.value[b] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64)), starts


def hash_words(texts: list[bytes], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and the number of words of each text."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        if len(texts[i]) > SEGMENT:
            at, text = 0, texts[i]
            while at < len(text):
                cut = alphabet.split.search(text, min(len(text), at + SEGMENT))
                to = cut.start() if cut else len(text)
                h, _ = _segment(text[at:to], alphabet)
                hashes.append(h)
                counts[i] += len(h)
                at = to
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= SEGMENT:
            size += len(texts[j]) + 1
            j += 1
        h, starts = _segment(b" ".join(texts[i:j]), alphabet)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        counts[i:j] = np.diff(np.searchsorted(starts, bounds))
        hashes.append(h)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by its first word; the last k-1 runs are cut off."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _ORDER
        out += hashes[j : j + n]
    return mix(out ^ np.uint64(k))


def shingles(texts: list[bytes], k: int = 5, alphabet: Alphabet = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, repeats kept, and how many each has.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    h, counts = hash_words(texts, alphabet)
    ends = np.cumsum(counts)
    n_of = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    full = windows(h, k)
    out = np.empty(int(n_of.sum()), np.uint64)
    to = np.cumsum(n_of)
    at = np.arange(len(out), dtype=np.int64)
    at += np.repeat(ends - counts - (to - n_of), n_of)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(full):
        out[:] = full[np.minimum(at, len(full) - 1)]
    for i in short:
        out[to[i] - 1] = windows(h[ends[i] - counts[i] : ends[i]], int(counts[i]))[0]
    return out, n_of


def sets(texts: list[bytes], k: int = 5, alphabet: Alphabet = SPACED) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, n_of = shingles(texts, k, alphabet)
    at = 0
    for n in n_of:
        a = np.sort(h[at : at + n])
        at += n
        yield a[np.concatenate([[True], a[1:] != a[:-1]])] if n else a


class MinHash:
    """``n`` multiply-add hash functions with random odd factors, minima over each text's shingles."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        self.n = n

    def __call__(self, h: np.ndarray, n_of: np.ndarray) -> np.ndarray:
        """A row of n 32-bit minima for each text; of a text without shingles all are 2**32-1."""
        out = np.full((len(n_of), self.n), 0xFFFFFFFF, np.uint32)
        some = np.flatnonzero(n_of)
        i = 0
        while i < len(some):  # blocks that stay in the cache
            j, size = i, 0
            while j < len(some) and (j == i or size + n_of[some[j]] <= 1 << 15):
                size += n_of[some[j]]
                j += 1
            first = int(n_of[: some[i]].sum()) if i == 0 else last
            last = first + int(size)
            x = h[first:last]
            starts = np.cumsum(n_of[some[i:j]]) - n_of[some[i:j]]
            y = np.empty_like(x)
            for k in range(self.n):
                np.multiply(x, self.a[k], out=y)
                np.add(y, self.b[k], out=y)
                out[some[i:j], k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
            i = j
        return out


def blocks(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _release() -> None:
    """Give free memory back to the system, as a worker that waits for its next task else keeps it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, which gives back at the end of each task what it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _release()

    return run


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    if not isinstance(column, pa.Array):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
