"""Vectorised word handling on Arrow string columns.

Everything works on the concatenated UTF-8 bytes of a batch, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Large arrays come and go here: let glibc give their memory back at once instead of keeping it for the worker's life.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL("libc.so.6").mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD; setting it also stops it from growing

SPACE = 0
#: A byte table maps every byte to the byte it counts as; 0 separates words.
_BYTES = np.arange(256, dtype=np.uint8)


def whitespace_table(lower: bool = False) -> np.ndarray:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D; with ``lower``, A-Z count as a-z."""
    table = _BYTES.copy()
    table[0] = 255  # NUL is a word character here; 255 never occurs in UTF-8
    if lower:
        table[65:91] += 32
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    return table


def alnum_table() -> np.ndarray:
    """Words are runs of 0-9, A-Z (as a-z), a-z and non-ASCII characters."""
    table = _BYTES.copy()
    table[65:91] += 32
    table[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = SPACE
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    t = h >> np.uint64(30)
    h = h ^ t
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(27), out=t)
    h ^= t
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=t)
    h ^= t
    return h


_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the first k bytes
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pairs (a, b); not linear in either, so that no pattern of repeated values cancels out."""
    h = b * np.uint64(0x9FB21C651E98DF25)
    h += a
    t = h >> np.uint64(32)
    h ^= t
    h *= np.uint64(0xD6E8FEB86659FD93)
    np.right_shift(h, np.uint64(29), out=t)
    h ^= t
    return h


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` consecutive values, joined from runs of powers of two."""
    if len(values) < width:
        return np.empty(0, np.uint64)
    out, done, run, size, rest = None, 0, values, 1, width
    while True:
        if rest & 1:
            out = run if out is None else ordered(out[: len(run) - done], run[done:])
            done += size
        rest >>= 1
        if not rest:
            return mix(out + np.uint64(width))
        run = ordered(run[:-size], run[size:])
        size *= 2


class Spans:
    """Cheap hashes of byte spans of one array, linear in the bytes: for features and samples, not to tell words apart."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * powers(_BASE, n), dtype=np.uint64, out=self.total[1:])
        self.back = powers(_INVERSE, n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.total[end]
        h -= self.total[start]
        h *= self.back[start]
        return mix(h + (end - start).astype(np.uint64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte spans."""
    return Spans(data).hashes(start, end)


class Words:
    """The words of a batch of texts, in order.

    ``start``/``end`` are byte positions in ``data``; document d has the words first[d] to first[d+1]-1.
    Null texts have no words.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        self.raw = data
        self.data = table[data]
        word = self.data != SPACE
        first = np.zeros(len(word) + 1, bool)  # where a document begins or the batch ends
        first[self.offsets] = True
        before = np.empty(len(word), bool)
        after = np.empty(len(word), bool)
        if len(word):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = word[:-1], word[1:]
        self.start = np.flatnonzero(word & (~before | first[:-1]))
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words (told apart by their bytes), and the number of each word among them."""
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        body = pa.py_buffer(self.data[self.data != SPACE])
        coded = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), body]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy()

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that tell words apart, as two arrays: mixed bytes of words up to 16 bytes, a cryptographic hash of longer ones."""
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        loads = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        length = self.end - self.start
        a, b = loads[self.start], loads[self.start + 8]
        a &= _MASKS[np.minimum(length, 8)]
        b &= _MASKS[np.clip(length - 8, 0, 8)]  # no word has a zero byte, so its end is where zeros begin
        t = mix(b ^ np.uint64(0x9E6C63D0876A46E5))
        t += a
        a ^= np.uint64(0xC2B2AE3D27D4EB4F)
        b += mix(a)
        first, second = mix(t), mix(b)
        if len(long := np.flatnonzero(length > 16)):
            body = memoryview(self.data)
            digests = b"".join(hashlib.blake2b(body[s:e], digest_size=16).digest() for s, e in zip(self.start[long].tolist(), self.end[long].tolist(), strict=True))
            first[long], second[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        return first, second

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.keys()[0]

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``width`` words inside one document, and the index of their first words."""
        h = rolling(hashes, width)
        last = np.repeat(self.first[1:], self.counts)[: len(h)]
        inside = np.arange(len(h)) + width <= last
        return h[inside], np.flatnonzero(inside)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

