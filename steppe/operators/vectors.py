"""Arithmetic of embeddings and language scores, as native expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import let

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector divided by its length, which counts as 1e-12 at least."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda norm: F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array<array>) whose mask is 1; zeros if there are none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    n = F.greatest(F.size(kept), F.lit(1))
    return F.transform(total, lambda x: x / n)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def top_languages(docs: DataFrame, labels: DataFrame, k: int = 1, wanted: list[str] | None = None, mode: str = "before", vector: str = "embedding", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k most probable labels of each vector: keep, rank from 1, label and p.

    ``labels`` has (label, weights): a few thousand rows.  Mode "before" restricts the labels to those wanted and
    then takes the softmax, "after" takes it over all labels and then restricts.  Wanted labels
    that the table lacks are ignored; ``ValueError`` if it has none of them.
    """
    if mode not in ("before", "after"):
        raise ValueError("mode is before or after")
    if wanted is not None:
        wanted = list(dict.fromkeys(wanted))
        if labels.where(F.col("label").isin(wanted)).isEmpty():
            raise ValueError("none of the labels is known")
    used = labels.where(F.col("label").isin(wanted)) if wanted is not None and mode == "before" else labels
    table = used.agg(F.array_sort(F.collect_list(F.struct("label", "weights"))).alias("__labels"))
    scored = docs.crossJoin(F.broadcast(table)).withColumn("__p", softmax(F.transform("__labels", lambda x: dot(x["weights"], F.col(vector)))))
    pairs = F.transform(F.arrays_zip(F.col("__labels").alias("l"), F.col("__p").alias("p")), lambda z: F.struct((-z["p"]).alias("n"), z["l"]["label"].alias("label"), z["p"].alias("p")))
    if wanted is not None and mode == "after":
        pairs = F.filter(pairs, lambda x: x["label"].isin(wanted))
    best = F.slice(F.array_sort(pairs), 1, k)
    return scored.select(*keep, F.posexplode(best).alias("i", "x")).select(*keep, (F.col("i") + 1).alias("rank"), "x.label", "x.p")


def nearest(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, vector: str = "embedding") -> DataFrame:
    """The k rows of ``right`` nearest to each row of ``left`` by cosine, by brute force: (left_id, rank, right_id, cosine).

    ``left_id`` and ``right_id`` must be different names.  ``left`` is broadcast, as a set of queries that fits in memory; each task
    keeps the best k of its part of ``right`` before they are shuffled.
    """
    a = left.select(left_id, l2_normalize(F.col(vector)).alias("__a"))
    b = right.select(right_id, l2_normalize(F.col(vector)).alias("__b"))
    scored = b.crossJoin(F.broadcast(a)).select(left_id, right_id, dot(F.col("__a"), F.col("__b")).alias("cosine"))
    order = Window.partitionBy(left_id).orderBy(F.desc("cosine"), right_id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(left_id, "rank", right_id, "cosine")
