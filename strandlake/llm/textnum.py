"""Words, hashes and character classes of whole texts, vectorised over a batch.

A batch is one byte buffer with the UTF-8 of all its texts, each followed by a line
feed. All results are arrays over bytes, words or texts; no loop runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_M = np.uint64
PRIME, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Fixed value: the white space that parts words.
SPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
#: Bytes that are hashed together.
CHUNK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit keys."""
    h = h ^ (h >> _M(32))
    h = h * _M(0xD6E8FEB86659FD93)
    h = h ^ (h >> _M(32))
    h = h * _M(0xD6E8FEB86659FD93)
    return h ^ (h >> _M(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and its inverse modulo 2**64, for i below n at least."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", PRIME), ("i", INVERSE)):
            a = np.full(size, base, _M)
            a[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


class Texts:
    """A batch of texts. ``buf``: bytes; ``starts``, ``ends``: of each text in ``buf``."""

    def __init__(self, texts: list[str | None] | list[bytes]):
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        self.buf = np.frombuffer(self.data, np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.n = len(raw)

    def words(self) -> None:
        """Sets word_start, word_end (byte offsets), word_doc and words_from (first word of each text, n + 1)."""
        gap = np.ones(len(self.buf) + 1, bool)
        gap[1:] = _IS_SPACE[self.buf]
        step = np.flatnonzero(gap[1:] != gap[:-1])
        self.word_start, self.word_end = step[0::2], step[1::2]
        self.words_from = np.searchsorted(self.word_start, np.append(self.starts, len(self.buf)))
        self.word_doc = np.repeat(np.arange(self.n), np.diff(self.words_from))

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``fold``: ASCII letters in lower case.

        Words are taken in stretches of ``CHUNK`` bytes, and a longer word in parts, so
        that the arrays beside the buffer stay small whatever the length of a text.
        """
        n = len(self.word_start)
        out = np.empty(n, _M)
        i = 0
        with np.errstate(over="ignore"):
            while i < n:
                a = int(self.word_start[i])
                j = max(i + 1, int(np.searchsorted(self.word_end, a + CHUNK, "right")))
                b = int(self.word_end[j - 1])
                if b - a > CHUNK:
                    out[i] = self._long_word(a, b, fold)
                else:
                    p, inv = _power(CHUNK + 1)
                    seg = self._bytes(a, b, fold)
                    run = np.zeros(len(seg) + 1, _M)
                    np.cumsum((seg.astype(_M) + _M(1)) * p[: len(seg)], out=run[1:])
                    start = self.word_start[i:j] - a
                    out[i:j] = (run[self.word_end[i:j] - a] - run[start]) * inv[start]
                i = j
            return mix(out)

    def _bytes(self, a: int, b: int, fold: bool) -> np.ndarray:
        part = self.data[a:b]
        return np.frombuffer(part.lower() if fold else part, np.uint8)

    def _long_word(self, a: int, b: int, fold: bool) -> np.uint64:
        p, _ = _power(CHUNK + 1)
        total, times, step = 0, 1, pow(PRIME, CHUNK, 1 << 64)
        for k in range(a, b, CHUNK):
            seg = self._bytes(k, min(b, k + CHUNK), fold)
            total += times * int(((seg.astype(_M) + _M(1)) * p[: len(seg)]).sum(dtype=_M))
            times = times * step % (1 << 64)
        return _M(total % (1 << 64))


def shingles(h: np.ndarray, words_from: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``n`` words; a shorter text that has words is one shingle of all its words."""
    count = np.diff(words_from)
    short = np.flatnonzero((count > 0) & (count < n))
    with np.errstate(over="ignore"):
        if len(h) >= n:
            acc = h[: len(h) - n + 1].copy()
            for j in range(1, n):
                acc = acc * _M(PRIME) + h[j : len(h) - n + 1 + j]
        else:
            acc = np.zeros(0, _M)
        doc = np.repeat(np.arange(len(count)), count)
        same = doc[: len(acc)] == doc[n - 1 :] if len(acc) else np.zeros(0, bool)
        out, at = acc[same], doc[: len(acc)][same]
        if len(short):
            extra = []
            for d in short:
                x = 0
                for w in h[words_from[d] : words_from[d + 1]]:
                    x = (x * PRIME + int(w)) & (2**64 - 1)
                extra.append(x)
            out, at = np.append(out, np.array(extra, _M)), np.append(at, short)
    return mix(out), at


def trimmed(run):
    """The function of batches, after whose end the worker gives freed memory back, as workers live on between tasks."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return both


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 384 << 10) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches with about ``most`` bytes of text (one longer text is a batch of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(text_at)
        size = np.nan_to_num(pa.compute.binary_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64) + 1
        cut = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=0)) if len(size) else []
        at = [0, *[int(c) for c in cut if c], b.num_rows]
        for i, j in zip(at, at[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)
