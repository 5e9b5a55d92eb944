"""Vectorised word tokenisation and hashing shared by the operators of this subpackage.

Texts arrive as Arrow string batches; everything below works on the flat byte buffer of a
whole batch with numpy, so no Python code runs per word or per character.

A *word* is a maximal run of letters, digits and underscores of the lower-cased text: the
ASCII ones, and every character beyond ASCII other than the white space, punctuation and
symbols of the Latin-1, General Punctuation and CJK Punctuation blocks.  A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random odd-ish value for each byte and the powers used to place bytes in a word and words in an n-gram.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(65, 91), 95]] = True
_WORD_BYTE[128:] = True
#: Characters beyond ASCII that separate words, by their UTF-8 bytes: lead, second byte from, to.
_GAPS2 = ((0xC2, 0xA0, 0xA9), (0xC2, 0xAB, 0xB4), (0xC2, 0xB6, 0xB9), (0xC2, 0xBB, 0xBF), (0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7))
#: lead, second byte, third byte from, to: U+2000 to U+206F and U+3000 to U+303F.
_GAPS3 = ((0xE2, 0x80, 0x80, 0xBF), (0xE2, 0x81, 0x80, 0xAF), (0xE3, 0x80, 0x80, 0xBF))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise: a bijection of 64-bit words that scatters them."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a batch of texts.

    ``hash``: 64-bit hash of each word, in text order; ``start``, ``end``: its byte offsets in
    ``data``; ``first``: index of each text's first word, with one entry more than texts;
    ``origin``: byte offset of each text in ``data``.
    """

    __slots__ = ("data", "end", "first", "hash", "origin", "start")

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = True, spaced: bool = False) -> None:
        """With ``spaced``, words are all that stands between white space and control characters of ASCII, marks included."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            # Words are the same runs in either case, so the n-th word here is the n-th of the text as it was.
            texts = pc.utf8_lower(texts)
        offsets, data = _buffers(texts)
        self.data, self.origin = data, offsets
        self._split(data, offsets, data > 32 if spaced else _word_bytes(data))

    def _split(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> None:
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] |= inside[cuts]  # a word never spans two texts
        start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        at = offsets[1:] - 1
        at = at[at >= 0]
        ends[at] |= inside[at]
        end = np.flatnonzero(ends) + 1
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        if not len(start):
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        length = end - start
        place = powers(int(length.max()) + 1)
        # Each byte's value times a power of its place in the word; bytes between words count nothing.
        pos = np.arange(len(data), dtype=np.int64)
        pos = pos[inside]
        pos -= np.repeat(start, length)
        value = _BYTE[data[inside]]
        value *= place[pos]
        cut = np.zeros(len(start), dtype=np.int64)
        np.cumsum(length[:-1], out=cut[1:])
        h = np.add.reduceat(value, cut)
        self.hash = mix(h)

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self)), self.counts)


def _word_bytes(data: np.ndarray) -> np.ndarray:
    inside = _WORD_BYTE[data]
    for lead, low, high in _GAPS2:
        at = np.flatnonzero(data[:-1] == lead)
        at = at[(data[at + 1] >= low) & (data[at + 1] <= high)]
        inside[at] = inside[at + 1] = False
    for lead, second, low, high in _GAPS3:
        at = np.flatnonzero(data[:-2] == lead)
        at = at[(data[at + 1] == second) & (data[at + 2] >= low) & (data[at + 2] <= high)]
        inside[at] = inside[at + 1] = inside[at + 2] = False
    return inside


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offs, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie within one text, and the word index at which each begins.

    A text of fewer than n words has one gram, of all its words; a text without words has none.
    """
    counts = np.diff(first)
    m = len(words) - n + 1
    if m > 0:
        g = words[:m].copy()
        for j in range(1, n):
            g *= _BASE
            g += words[j : j + m]
        long = counts >= n
        grams = np.where(long, counts - n + 1, 0)
        at = np.repeat(first[:-1], grams) + within(grams)
        g = mix(g[at] + _U(n))
    else:
        g, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        sg = np.empty(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            h = _U(0)
            with np.errstate(over="ignore"):
                for w in words[first[d] : first[d + 1]]:
                    h = h * _BASE + w
                sg[i] = h + _U(counts[d])
        g, at = np.concatenate([g, mix(sg)]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
    return g, at


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, and so on."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    begin = np.cumsum(counts) - counts
    out -= np.repeat(begin, counts)
    return out


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, sorted by hash within it, and the bounds of the texts."""
    g, at = ngrams(w.hash, w.first, n)
    owner = np.searchsorted(w.first, at, side="right") - 1
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[keep], owner[keep]
    return g, np.searchsorted(owner, np.arange(len(w) + 1))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words of the whole array in time independent of k (runs may cross texts)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    # With an odd base b, sum of w[i] * b^i over a prefix; a run's hash is the difference times b^-i.
    p = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * p[:-1], out=total[1:])
    inverse = powers(m, _U(pow(int(_BASE), -1, 2**64)))
    return mix((total[k:] - total[:-k]) * inverse)


def runs_rank(*sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of rows that are equal in all keys."""
    n = len(sorted_keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))
