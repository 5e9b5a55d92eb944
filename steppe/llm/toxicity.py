"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are which words, pairs of neighbouring words and pairs of words with one word
between it has, hashed to ``2 ** BITS`` places.  One pass of FTRL-proximal (McMahan et al., 2013)
an epoch keeps a rate of its own for each coordinate, and its L1 term leaves most weights at
exactly zero; what is broadcast for scoring is the list of the others.

Training uses a bounded sample of the labelled documents, ``SAMPLE`` rows and ``SAMPLE_BYTES`` of text at most: those whose
hashed doc_id is smallest.  Scoring is one pass without a shuffle over every document and its
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks
from .words import Words, mix

BITS = 20
SAMPLE = 20_000
#: Bounds of the text that training uses: of all of it together, and of each one.
SAMPLE_BYTES, LONGEST = 64 << 20, 1 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
THRESHOLD = 0.5
_BIGRAM, _SKIPGRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(w: Words, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, bigrams and skip-grams: places of the features, and the text each belongs to."""
    owner = w.owner()
    shift = np.uint64(64 - bits)
    out = [((w.hash >> shift).astype(np.int32), owner)]
    for gap, by in ((1, _BIGRAM), (2, _SKIPGRAM)):
        a, b = w.hash[:-gap], w.hash[gap:]
        same = owner[:-gap] == owner[gap:] if len(owner) > gap else np.zeros(0, bool)
        pair = mix(a[: len(same)][same] * by + b[: len(same)][same])
        out.append(((pair >> shift).astype(np.int32), owner[: len(same)][same]))
    return out


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on the distinct features of each example; returns places and values of the non-zero weights, and the bias."""
    z, n = np.zeros(2**bits), np.zeros(2**bits)
    z_bias = n_bias = 0.0

    def weight(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(examples, labels, strict=True):
            zs, ns = z[at], n[at]
            w, w_bias = weight(zs, ns), float(weight(z_bias, n_bias))
            g = _sigmoid(float(w.sum()) + w_bias) - y
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            z_bias += g - (np.sqrt(n_bias + g * g) - np.sqrt(n_bias)) / ALPHA * w_bias
            n_bias += g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32), float(weight(z_bias, n_bias))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, limit: int = SAMPLE_BYTES, longest: int = LONGEST) -> DataFrame:
    """The sampled labelled documents: (h, y, text), at most ``sample`` of them and ``limit`` bytes of text, each up to ``longest`` bytes.

    Taken are those of the least hash of doc_id and text.  Rows with a null id or label, or a label other than 0 and 1, are left out; an id with
    contradicting labels counts with the larger one.  A row that repeats counts once, several texts under one id once each.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.select("id", "y", F.xxhash64("id", F.lit(17)).alias("h")).orderBy("h", "id").limit(sample)
    # At most `sample` rows of 24 bytes, whatever the input: safe to broadcast.
    text = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= longest)
    text = text.withColumn("t", F.xxhash64("text"))
    found = text.join(F.broadcast(known), "id")
    # Which texts: of any number of them under these ids, small rows decide.
    small = found.select("h", "t", F.octet_length("text").cast("long").alias("size")).distinct().orderBy("h", "t").limit(sample)
    chosen = small.withColumn("total", F.sum("size").over(Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= limit).select("h", "t")
    return found.join(F.broadcast(chosen), ["h", "t"]).groupBy("h", "t").agg(F.max("y").alias("y"), F.max("text").alias("text")).select("h", "y", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights fitted on a bounded sample of labelled documents; none, and no bias, if there are no labels."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column(2))
            kinds = features(w, bits)
            at = np.concatenate([x for x, _ in kinds])
            owner = np.concatenate([o for _, o in kinds])
            at = at[np.argsort(owner, kind="stable")]
            bounds = np.cumsum(np.bincount(owner, minlength=len(w)))
            x = [np.unique(part).tobytes() for part in np.split(at, bounds[:-1])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, type=pa.binary())], names=["h", "y", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found).sort_by([("h", "ascending"), ("x", "ascending")])
            y, x = np.asarray(table.column("y")).astype(np.float64), table.column("x").to_pylist()
            del table, found  # one copy of the features is enough
            at, value, bias = ftrl([np.frombuffer(b, np.int32) for b in x], y, bits)
            yield pa.record_batch([pa.array([at.tobytes()]), pa.array([value.tobytes()]), pa.array([bias])], names=["at", "value", "bias"])

    # The sample is bounded, so one task trains on all of it.
    x = labelled(docs, labels, "toxic", sample).mapInArrow(extract, "h long, y int, x binary").repartition(1)
    found = x.mapInArrow(fit, "at binary, value binary, bias double").collect()
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["value"], np.float32), found[0]["bias"]


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Probability of toxicity of each text, with the dense weights."""
    w = Words(texts)
    hits = []
    for at, owner in features(w, bits):
        hit = np.flatnonzero(weights[at])
        hits.append(owner[hit].astype(np.int64) << bits | at[hit])
    # A feature counts once a text, whatever its kind; only those with a weight need be told apart.
    hits = np.unique(np.concatenate(hits))
    return _sigmoid(bias + np.bincount(hits >> bits, weights=weights[hits & (2**bits - 1)], minlength=len(w)))


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS):
    """A function of Arrow texts that gives their probabilities, from weights trained and broadcast now."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, bits))

    def score(texts: pa.Array) -> np.ndarray:
        at, value, bias = model.value
        dense = _DENSE.get(id(model.value))
        if dense is None:
            dense = np.zeros(2**bits, dtype=np.float32)
            dense[at] = value
            _DENSE.clear()
            _DENSE[id(model.value)] = dense
        return score_texts(texts, dense, bias, bits)

    return score


_DENSE: dict[int, np.ndarray] = {}


def _blank(texts: pa.Array) -> np.ndarray:
    """Whether each text is null or empty."""
    return np.asarray(pc.fill_null(pc.equal(pc.binary_length(texts), 0), True))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """A row (doc_id bigint, toxicity double, toxic boolean) for every row of the documents.

    ``toxic`` tells whether the probability exceeds the threshold.  Null and empty texts have the
    probability that the bias alone gives, but are never toxic; null ids and repeated rows are
    scored like any other row; other columns are ignored.  Without usable labels nothing is toxic
    (every probability is 0.5, which does not exceed the threshold).  An empty table gives an empty result.
    """
    score = scorer(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            p = score(batch.column(1))
            some = ~_blank(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p > threshold) & some)], names=["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of the documents, all columns as they are, whose text isn't toxic.

    Null and empty texts stay, and so does every row without usable labels to learn from.  Null ids and repeated rows are treated like any other
    row, texts of any length are scored whole, and columns may have any names.  An empty table gives an empty result.
    """
    score = scorer(docs, labels, sample)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column(where)
            keep = ~(score(texts) > threshold) | _blank(texts)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
