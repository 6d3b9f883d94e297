"""Vectorised words, word hashes and n-gram hashes of whole batches of texts.

A word is a maximal run of ASCII digits, ASCII letters and characters beyond ASCII, after
lower-casing A-Z only. In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so
the runs can be found on bytes. Hashes are polynomial over the ring of 64-bit integers: a
prefix sum gives the hash of every span at once, without a Python loop over words. Sums are taken
over bounded chunks, so a very long text costs a few bytes of memory per byte.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1B54A32D192ED03 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_BASE_2 = 0xA0761D6478BD642F | 1
_LETTER_2 = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE_2))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = True
_IS_WORD[97:123] = True
_IS_WORD[128:] = True

#: Values whose prefix sums are held at once.
_CHUNK = 1 << 20
#: Texts that have a word, and words, as JVM patterns.
WORDY, WORD = "[0-9A-Za-z\u0080-\U0010ffff]", "[0-9A-Za-z\u0080-\U0010ffff]+"
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, n at most _CHUNK + 1; kept, and doubled when too short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, min(1 << max(0, n - 1).bit_length(), _CHUNK + 1))
        have = np.full(size, _U(base))
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def _power(base: int, n: int) -> np.uint64:
    return _U(pow(base, int(n), 1 << 64))


def _hashes(values, n: int, base: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of values[first:last] for disjoint spans in order; values(a, b) gives those of a..b-1.
    Only _CHUNK values are held at once; a span over several chunks is summed up."""
    out = np.zeros(len(first), np.uint64)
    back = pow(base, -1, 1 << 64)
    for begin in range(0, n, _CHUNK):
        end = min(begin + _CHUNK, n)
        i, j = np.searchsorted(last, begin, side="right"), np.searchsorted(first, end)
        if i >= j:
            continue
        prefix = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(values(begin, end) * powers(base, end - begin), out=prefix[1:])
        a, b = np.maximum(first[i:j], begin) - begin, np.minimum(last[i:j], end) - begin
        part = (prefix[b] - prefix[a]) * powers(back, end - begin + 1)[a]
        if first[i] < begin:
            part[:1] *= _power(base, begin - first[i])
        out[i:j] += part
    return mix(out + (last - first).astype(np.uint64))


@dataclass
class Words:
    """Words of a batch: hashes, the first word of each text (one more entry at the end), byte spans."""

    hashes: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def word(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i]].tobytes()

    def others(self) -> np.ndarray:
        """Hashes of the words that don't depend on the first ones."""
        return _word_hashes(self.data, self.first, self.last, _LETTER_2, _BASE_2)


def is_word(data: np.ndarray) -> np.ndarray:
    """Whether each lower-cased byte belongs to a word."""
    return _IS_WORD[data]


def byte_starts(w: Words, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n lower-cased bytes from each of `first` on."""
    out = np.full(len(first), _U(n))
    for i in range(n):
        out += _LETTER[w.data[first + i]] * _power(_BASE, i)
    return mix(out)


def _word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, letter: np.ndarray, base: int) -> np.ndarray:
    return _hashes(lambda a, b: letter[data[a:b]], len(data), base, first, last)


def words(texts: list[str | None]) -> Words:
    """Words of each text; None and texts without word characters have none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    data = _LOWER[np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)]
    del parts
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    first, last = np.ascontiguousarray(edge[0::2]), np.ascontiguousarray(edge[1::2])
    hashes = _word_hashes(data, first, last, _LETTER, _BASE)
    offsets = np.concatenate(([0], np.searchsorted(first, np.cumsum(sizes)))).astype(np.int64)
    return Words(hashes, offsets, first, last, data)


def every_span(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, across the borders of texts too."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, _U(n))
    for i in range(n):
        out += hashes[i : i + m] * _power(_WORD_BASE, i)
    return mix(out)


def span_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each of `at` on."""
    out = np.full(len(at), _U(n))
    for i in range(n):
        out += hashes[at + i] * _power(_WORD_BASE, i)
    return mix(out)


def ngrams(w: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, in order, and offsets by text.

    A text of fewer than k words, but not none, gives one gram of all its words if `short`."""
    counts = w.counts()
    few = (counts > 0) & (counts < k) if short else np.zeros(len(counts), bool)
    grams = np.where(few, 1, np.maximum(counts - k + 1, 0))
    offsets = np.concatenate(([0], np.cumsum(grams)))
    out = np.empty(int(offsets[-1]), np.uint64)
    whole = np.repeat(~few, grams)
    every = every_span(w.hashes, k)
    begins = np.zeros(len(every) + 1, np.int8)  # words that k words of the same text begin with
    many = counts >= k
    np.add.at(begins, w.offsets[:-1][many], 1)
    np.add.at(begins, w.offsets[1:][many] - k + 1, -1)
    out[whole] = every[np.cumsum(begins[:-1], dtype=np.int8) > 0]
    if few.any():
        out[~whole] = _hashes(lambda a, b: w.hashes[a:b], len(w.hashes), _WORD_BASE, w.offsets[:-1], w.offsets[1:])[few]
    return out, offsets


def text_hashes(w: Words, hashes: np.ndarray | None = None) -> np.ndarray:
    """One hash of each text's whole word sequence; texts without words share one."""
    h = w.hashes if hashes is None else hashes
    return _hashes(lambda a, b: h[a:b], len(h), _WORD_BASE, w.offsets[:-1], w.offsets[1:])


def shuffle(x: np.ndarray, factor: np.uint64, term: np.uint64) -> np.ndarray:
    """One of a family of hash functions on 64-bit integers whose high bits are well mixed."""
    y = x * factor
    y += term
    y ^= y >> _U(32)
    y *= factor
    return y


def _trimmer():
    """Gives freed memory back to the system, where the C library can."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_trim = _trimmer()


def batches(texts: list[str | None], most: int = 1_500_000, rows: int = 4096):
    """Ranges of at most `rows` texts of about `most` characters; a longer text is alone in its range.
    After each, freed memory goes back to the system: several Python workers share an executor."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and (held + n > most or i - begin == rows):
            yield begin, i
            _trim(0)
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)
        _trim(0)
