"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is found in a document when at least ``THRESHOLD`` of the item's distinct word
shingles occur in the document.  A short item inside a long document has a Jaccard similarity
near zero, so that whole-document signatures can't find it.  As in an LSH ensemble, domains are
therefore partitioned by size and the containment threshold is turned into a Jaccard threshold
for each partition; the domains indexed here are windows of the documents, of a length that
follows the partition of the items:

* items are partitioned by their number q of distinct shingles of s words: q + s - 1, the words that an item without repetition has, is in (U/2, U]
  for U = 8, 16, 32, ...;
* for a partition a document is cut into blocks of U words and its domains are pairs of
  neighbouring blocks, so that any passage of up to U words lies within one of them;
* a domain holds at most 2 U shingles.  An item of q shingles contained by the share t has a
  Jaccard similarity of at least j = t q / (2 U + q (1 - t)) with it, and the partition's number of
  bands b, each of one row, is chosen so that a domain at j is missed with a probability of
  ``MISS`` at most: (1 - j) ** b <= MISS.

Bands are bounded in this way whatever the items, as q is at least U/2 - s + 2.  Items for which a signature is no use are searched by
their shingles themselves, all of which are looked up: those of ``TINY`` distinct shingles or fewer, and those that repeat
themselves so much that their words don't fit in a domain of their partition.

MinHash values are computed once, for the smallest blocks, and merged upwards by minimum.  Every
pair of a document and an item that agree in a band is then verified by counting the item's
shingles in the whole document.  The documents aren't shuffled: the items' bands are broadcast, in
slices of at most ``BROADCAST_BYTES``, each with a pass of its own over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .words import Words, gram_sets, ngrams, within

SHINGLE, THRESHOLD, MISS = 3, 0.6, 0.002
TINY = 4
#: Size of the items' shingles and bands that is broadcast at once.
BROADCAST_BYTES = 64 << 20
_SMALLEST = 8
_MAX = np.uint32(0xFFFFFFFF)


def bands(u: int, q: np.ndarray, threshold: float, miss: float) -> int:
    """Bands of one row needed for items of q shingles in the partition of up to u words."""
    j = threshold * q.min() / (2 * u + q.min() * (1 - threshold))
    return max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - j))))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed32(h: np.ndarray, multiplier: np.uint32) -> np.ndarray:
    """One member of a family of permutations of 32-bit values."""
    return h * multiplier


class Items:
    """The index of a slice of the benchmark."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, shingle: int, threshold: float, miss: float) -> None:
        w = Words(texts)
        grams, first = gram_sets(w, shingle)
        size = np.diff(first)
        order = np.flatnonzero(size > 0)
        self.ids, self.shingle, self.threshold = ids[order], shingle, threshold
        self.size = size[order]
        self.grams = [grams[first[i] : first[i + 1]] for i in order]
        words = w.counts[order]
        upper = np.maximum(_SMALLEST, 2 ** np.ceil(np.log2(np.maximum(self.size + shingle - 1, 1))).astype(np.int64))
        plain = (self.size > TINY) & (words <= upper)
        # Shingles of the items without signatures, sorted, and the items that have them.
        rest = np.flatnonzero(~plain)
        value, owner = (np.concatenate(x) if len(rest) else np.zeros(0, t) for x, t in (([self.grams[i] for i in rest], np.uint64), ([np.full(self.size[i], i) for i in rest], np.int64)))
        at = np.argsort(value, kind="stable")
        self.direct = value[at], owner[at]
        #: For each partition: its upper bound and, for each band, sorted values and the items that have them.
        self.partitions: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]] = []
        for u in np.unique(upper[plain]):
            own = np.flatnonzero(plain & (upper == u))
            b = bands(int(u), self.size[own], threshold, miss)
            flat = np.concatenate([(self.grams[i] >> np.uint64(32)).astype(np.uint32) for i in own])
            begin = np.cumsum(self.size[own]) - self.size[own]
            per_band = []
            for a in _multipliers(b):
                value = np.minimum.reduceat(_mixed32(flat, a), begin)
                at = np.argsort(value, kind="stable")
                per_band.append((value[at], own[at]))
            self.partitions.append((int(u), per_band))

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of text, index of item and containment of all pairs found."""
        w = Words(texts)
        n = len(w)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not len(self.ids) or not len(w.hash):
            return none
        grams, at = ngrams(w.hash, w.first, self.shingle)
        owner = np.searchsorted(w.first, at, side="right") - 1
        found = [*self._by_shingle(grams, owner), *self._by_signature(grams, owner, n)]
        if not found:
            return none
        pairs = np.unique(np.concatenate(found))
        doc, item = pairs // len(self.ids), pairs % len(self.ids)
        bounds = np.searchsorted(owner, np.arange(n + 1))
        share = np.empty(len(pairs))
        last, own = -1, None
        for i, (d, x) in enumerate(zip(doc, item, strict=True)):
            if d != last:
                last, own = d, np.sort(grams[bounds[d] : bounds[d + 1]])
            spot = np.minimum(np.searchsorted(own, self.grams[x]), len(own) - 1)
            share[i] = (own[spot] == self.grams[x]).sum() / self.size[x]
        good = share >= self.threshold - 1e-12
        return doc[good], item[good], share[good]

    def _by_shingle(self, grams: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs (text * items + item) that share a shingle of an item without a signature."""
        values, items = self.direct
        if len(values):
            lo = np.searchsorted(values, grams)
            hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == grams)
            lo, hi = lo[hit], np.searchsorted(values, grams[hit], side="right")
            which = items[np.repeat(lo, hi - lo) + within(hi - lo)]
            yield np.unique(np.repeat(owner[hit], hi - lo) * len(self.ids) + which)

    def _by_signature(self, grams: np.ndarray, owner: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Pairs (text * items + item) that agree in a band."""
        if not self.partitions:
            return
        count = np.bincount(owner, minlength=n)
        base = self.partitions[0][0]
        # Each text takes whole blocks and one empty block after them, so that no domain spans two texts.
        blocks = -(-count // base) + 1
        begin = np.concatenate([[0], np.cumsum(blocks)])
        h = np.zeros(int(begin[-1]) * base, dtype=np.uint32)
        filled = np.zeros(len(h), dtype=bool)
        place = np.repeat(begin[:-1] * base, count) + within(count)
        h[place] = (grams >> np.uint64(32)).astype(np.uint32)
        filled[place] = True
        empty = ~filled
        n_bands = max(len(p) for _, p in self.partitions)
        for k, a in enumerate(_multipliers(n_bands)):
            value = _mixed32(h, a)
            value[empty] = _MAX
            width = base
            while width > 1:
                value = np.minimum(value[0::2], value[1::2])
                width //= 2
            level, bounds = base, begin
            for u, per_band in self.partitions:
                while level < u:
                    # Blocks of twice the length; a text's last one may be half empty.
                    half = -(-np.diff(bounds) // 2)
                    after = np.concatenate([[0], np.cumsum(half)])
                    left = np.repeat(bounds[:-1], half) + 2 * within(half)
                    value = np.minimum.reduceat(value, left)
                    last = after[1:][(half > 0)]
                    # keep an empty block at the end of every text
                    value = np.insert(value, last, _MAX)
                    bounds = after + np.arange(n + 1)
                    level *= 2
                if k >= len(per_band):
                    continue
                domain = np.minimum(value[:-1], value[1:])
                values, items = per_band[k]
                lo = np.searchsorted(values, domain)
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == domain)
                # A domain that begins with a text's empty block would belong to the next text.
                hit = hit[value[hit] != _MAX]
                if len(hit):
                    lo, hi = lo[hit], np.searchsorted(values, domain[hit], side="right")
                    which = items[np.repeat(lo, hi - lo) + within(hi - lo)]
                    doc = np.repeat(np.searchsorted(bounds, hit, side="right") - 1, hi - lo)
                    yield np.unique(doc * len(self.ids) + which)


def _slices(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """Parts of the benchmark whose index stays under the limit."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    # An item of c characters has at most c / 2 shingles of 8 bytes, and bands of a few hundred bytes.
    total = items.agg(F.coalesce(F.sum(F.length("text") * 4 + 1000), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // limit))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _index(items: DataFrame, shingle: int, threshold: float, miss: float) -> Items:
    rows = items.orderBy("item_id", "text").toArrow()
    return Items(np.asarray(rows.column("item_id")).astype(np.int64), rows.column("text").combine_chunks(), shingle, threshold, miss)


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, miss: float = MISS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id bigint, item_id bigint, containment double): the items found in each document.

    Words are as in :mod:`.words`; a text of fewer words than a shingle has one, all its words.
    Documents and items with a null id or text, or without words, are never in the result.  A row
    repeated gives its result once; several texts under one id each count, the largest containment
    being reported.  Empty tables give an empty result.  Other columns are ignored.  The search is approximate:
    an item whose shingles are spread over a document rather than lying in one passage may be missed.  Texts and items of any length are
    searched whole.  Items that are equal are found each, and so are all that tie.
    """
    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in _slices(benchmark, limit):
        index = docs.sparkSession.sparkContext.broadcast(_index(part, shingle, threshold, miss))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                doc, item, share = index.value.search(batch.column(1))
                ids = np.asarray(batch.column(0))
                yield pa.record_batch([pa.array(ids[doc]), pa.array(index.value.ids[item]), pa.array(share)], names=["doc_id", "item_id", "containment"])

        found = source.mapInArrow(run, "doc_id long, item_id long, containment double")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, miss: float = MISS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of the documents, all columns as they are, whose text holds no test item, as :func:`decontaminate` finds them.

    Rows with a null or empty text or one without words stay, and so do all rows if there are no items.  The doc_id
    doesn't matter: rows with a null one and repeated rows are searched each.  Texts of any length are searched whole, columns may have
    any names.  An empty table gives an empty result.
    """
    where = docs.columns.index("text")
    for part in _slices(benchmark, limit):
        index = docs.sparkSession.sparkContext.broadcast(_index(part, shingle, threshold, miss))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                doc, _, _ = index.value.search(batch.column(where))
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[doc] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
