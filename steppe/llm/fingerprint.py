"""Order MinHash fingerprints (Marçais et al., 2019).

Each of ``SIZE`` hash functions selects the ``TUPLE`` k-mers of words with the least values, where
the i-th occurrence of a k-mer has a value of its own, so that repetition counts.  The selected
k-mers are put back into text order and hashed as a tuple.  The share of places at which two signatures agree falls
with the edit distance of the texts: unlike a plain MinHash, it also sees words that were moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .words import Words, mix, ngrams, runs_rank

KMER, TUPLE, SIZE = 3, 2, 32
#: K-mers of a text that are hashed together: with 32 functions, 8 MB.
AT_ONCE = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multipliers(size: int) -> np.ndarray:
    """An odd multiplier for each hash function; its function takes a k-mer's key to their product."""
    return np.random.default_rng(4242).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def occurrence_keys(kmer: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A key for each k-mer that differs between its occurrences in one text."""
    order = np.lexsort((np.arange(len(kmer)), kmer, owner))
    occurrence = np.empty(len(kmer), dtype=np.int64)
    occurrence[order] = runs_rank(kmer[order], owner[order])
    return mix(kmer + occurrence.astype(np.uint64) * _STEP)


def signature(kmer: np.ndarray, key: np.ndarray, factors: np.ndarray, length: int, at_once: int = AT_ONCE) -> np.ndarray:
    """The signature of one text, from its k-mers in text order and their keys, of which so many are looked at together."""
    each = np.arange(len(factors))
    best, where = np.zeros((len(factors), 0), np.uint64), np.zeros((len(factors), 0), np.int64)
    for begin in range(0, len(key), at_once):
        value = key[None, begin : begin + at_once] * factors[:, None]
        least, places = [], []
        for _ in range(min(length, value.shape[1])):
            at = value.argmin(axis=1)
            least.append(value[each, at])
            places.append(at + begin)
            value[each, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        best, where = np.concatenate([best, np.stack(least, axis=1)], axis=1), np.concatenate([where, np.stack(places, axis=1)], axis=1)
        if best.shape[1] > length:
            order = np.lexsort((where, best), axis=1)[:, :length]
            best, where = np.take_along_axis(best, order, axis=1), np.take_along_axis(where, order, axis=1)
    places = np.sort(where, axis=1)
    out = np.full(len(factors), np.uint64(places.shape[1]))
    for j in range(places.shape[1]):
        out = mix(out * _STEP + kmer[places[:, j]])
    return out


def fingerprints(docs: DataFrame, k: int = KMER, length: int = TUPLE, size: int = SIZE) -> DataFrame:
    """A row (doc_id bigint, signature array<bigint>) for every row of the documents.

    Words are as in :mod:`.words`; a text of fewer than k words has one k-mer, all its words, and one of
    fewer k-mers than a tuple has tuples of all of them.  The signature of a null text or one without words is null.  Null
    ids and repeated rows are treated like any other row; of equal values the earlier place counts as less.  A text of any length is hashed
    whole, in memory of a few times its size.  An empty table gives an empty result.  Other columns are ignored.
    """
    factors = multipliers(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column(1))
            kmer, at = ngrams(w.hash, w.first, k)
            owner = np.searchsorted(w.first, at, side="right") - 1
            key = occurrence_keys(kmer, owner)
            first = np.searchsorted(owner, np.arange(len(w) + 1))
            out = [signature(kmer[a:b], key[a:b], factors, length).view(np.int64) if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(out, type=pa.list_(pa.int64()))], names=["doc_id", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, signature array<long>")
