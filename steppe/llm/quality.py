"""A quality classifier with supervised subword embeddings.

Every word, every pair of neighbouring words (a word and itself is the same pair for all words) and every run of 3 and 4 characters of a word, its two ends marked, is
hashed to one of ``2 ** BITS`` learned vectors of ``DIM`` numbers.  Words are what stands between white space, as it is
written.  A document is the average of its features' vectors, and a softmax over the two
classes follows.  Vectors and output weights are trained together by stochastic
gradient descent in numpy, one document a step, with falling rates: one for the vectors, one for the output.

As the output is linear in the average, scoring needs only one number for each vector, its part in
the difference of the two logits: this table is what is broadcast, and the parts of a word and its characters are added up once
for each different word of a batch.  Training uses a bounded sample of the labelled
documents (see :func:`.toxicity.labelled`); scoring is one pass without a shuffle over every document and its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .toxicity import _sigmoid, labelled
from .words import Words, mix, powers, within

BITS, DIM = 18, 16
SAMPLE = 6000
EPOCHS, RATE, VECTOR_RATE = 2, 1.0, 30.0
#: A document is kept if its probability of being of good quality is at least this.
THRESHOLD = 0.5
_GRAMS = (3, 4)
_PAIR, _CHAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Features:
    """The features of a batch of texts, those of each different word once.

    ``word``: for each word of the batch the index of what it is among the different ones; ``own`` and ``bounds``: places of
    the features of these, the word's own first; ``pair`` and ``pair_first``: places of the pairs, and the bounds of the texts in them.
    """

    def __init__(self, texts: pa.Array, bits: int = BITS) -> None:
        w = Words(texts, lower=False, spaced=True)
        self.first, self.bits = w.first, bits
        _, seen, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.own, self.bounds = _subwords(w, seen, bits)
        a, b = w.hash[:-1], w.hash[1:]
        inside = np.ones(len(a), dtype=bool)
        cuts = w.first[1:-1]
        inside[cuts[(cuts > 0) & (cuts < len(w.hash))] - 1] = False
        a, b = a[inside], b[inside]
        # A word and itself again is the same pair whichever the word: repetition can be learned from other words.
        self.pair = (mix(np.where(a == b, _PAIR, a * _PAIR + b)) >> np.uint64(64 - bits)).astype(np.int32)
        self.pair_first = np.concatenate([[0], np.cumsum(np.maximum(w.counts - 1, 0))])

    def of(self, i: int) -> np.ndarray:
        """Places of all features of a text."""
        own = self.word[self.first[i] : self.first[i + 1]]
        size = np.diff(self.bounds)[own]
        return np.concatenate([self.own[np.repeat(self.bounds[own], size) + within(size)], self.pair[self.pair_first[i] : self.pair_first[i + 1]]])

    def means(self, value: np.ndarray) -> np.ndarray:
        """For each text the mean of the values of its features."""
        per_word = np.add.reduceat(value[self.own].astype(np.float64), self.bounds[:-1]) if len(self.own) else np.zeros(0)
        size = np.diff(self.bounds)
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (per_word[self.word], size[self.word], value[self.pair].astype(np.float64))]
        between = lambda x, f: x[f[1:]] - x[f[:-1]]
        count = between(sums[1], self.first) + np.diff(self.pair_first)
        return (between(sums[0], self.first) + between(sums[2], self.pair_first)) / np.maximum(count, 1)


def _subwords(w: Words, seen: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of the words at ``seen``, and their bounds: the word, then its runs of characters with an end mark on either side."""
    length = w.end[seen] - w.start[seen]
    # <word>: control characters, which no word has, mark its ends.
    begin = np.concatenate([[0], np.cumsum(length + 2)])
    data = np.empty(int(begin[-1]), dtype=np.uint8)
    data[begin[:-1]], data[begin[1:] - 1] = 2, 3
    data[np.repeat(begin[:-1] + 1, length) + within(length)] = w.data[np.repeat(w.start[seen], length) + within(length)]
    char = np.flatnonzero((data & 0xC0) != 0x80)  # where each character begins
    first = np.searchsorted(char, begin)
    power = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _CHAR) * power[:-1], dtype=np.uint64)])
    inverse = powers(len(data) + 1, np.uint64(pow(int(power[1]), -1, 2**64))) if len(data) else power
    char = np.append(char, len(data))
    count = np.diff(first)
    place, owner = [(w.hash[seen] >> np.uint64(64 - bits)).astype(np.int32)], [np.arange(len(seen))]
    for n in _GRAMS:
        size = np.maximum(count - n + 1, 0)
        at = np.repeat(first[:-1], size) + within(size)
        g = (total[char[at + n]] - total[char[at]]) * inverse[char[at]]
        place.append((mix(g + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32))
        owner.append(np.repeat(np.arange(len(seen)), size))
    place, owner = np.concatenate(place), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return place[order], np.searchsorted(owner[order], np.arange(len(seen) + 1))


def train_vectors(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, vector_rate: float = VECTOR_RATE) -> tuple[np.ndarray, float]:
    """Vectors trained on (places, counts) of documents, collapsed to a number for each place, and a bias."""
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / dim, 1 / dim, (2**bits, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, share = examples[i]
            left = 1 - step / steps
            eta = np.float32(rate * left)
            step += 1
            if not len(at):
                continue
            own = vectors[at]
            hidden = share @ own
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = weights @ p
            weights -= eta * np.outer(hidden, p)
            bias -= eta * p
            own -= (np.float32(vector_rate * left) * share)[:, None] * back
            vectors[at] = own
    return vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


def shares(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(places, return_counts=True)
    return at, (count / max(1, count.sum())).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    """The collapsed table and bias; zeros if there are no labels."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            f = Features(batch.column(2), bits)
            x = []
            for i in range(batch.num_rows):
                at, share = shares(f.of(i))
                x.append((at.astype(np.int32).tobytes(), share.tobytes()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([a for a, _ in x], type=pa.binary()), pa.array([s for _, s in x], type=pa.binary())], names=["h", "y", "x", "s"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found).sort_by([("h", "ascending"), ("x", "ascending")])
            x = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for a, s in zip(table.column("x").to_pylist(), table.column("s").to_pylist(), strict=True)]
            value, bias = train_vectors(x, np.asarray(table.column("y")), bits)
            yield pa.record_batch([pa.array([value.astype(np.float32).tobytes()]), pa.array([bias])], names=["value", "bias"])

    # The sample is bounded, so one task trains on all of it.
    x = labelled(docs, labels, "quality", sample).mapInArrow(extract, "h long, y int, x binary, s binary").repartition(1)
    found = x.mapInArrow(fit, "value binary, bias double").collect()
    if not found:
        return np.zeros(2**bits, np.float32), 0.0
    return np.frombuffer(found[0]["value"], np.float32), found[0]["bias"]


def score_texts(texts: pa.Array, value: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Probability of good quality of each text."""
    return _sigmoid(Features(texts, bits).means(value) + bias)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """A row (doc_id bigint, quality double, keep boolean) for every row of the documents.

    ``keep`` tells whether the probability of good quality is at least the threshold.  Null and empty texts have the
    probability that the bias alone gives, and aren't kept; null ids and repeated rows are scored like
    any other row; other columns are ignored.  A text of any length is scored whole.  Without usable labels every probability is 0.5.
    An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            p = score_texts(batch.column(1), *model.value)
            some = np.asarray(pc.fill_null(pc.greater(pc.binary_length(batch.column(1)), 0), False))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= threshold) & some)], names=["doc_id", "quality", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality double, keep boolean")
