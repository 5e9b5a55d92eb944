"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked there; the k-th of a source's n
rows has the fractional rank (2 k - 1) / (2 n).  Sorting all rows by fractional rank interleaves
the sources in proportion, so that cutting this order into equal pieces gives shards that all have
the mixture of the whole: a shard's number of rows of a source is off by fewer rows than there are
sources, however large the shard.

No task ever holds a whole source.  Both sorts are bucketed by a uniform key (the leading digits of
the hash, then the fractional rank itself), counted a bucket at a time, and completed with the running
totals of the bucket counts, so a source with most of the rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 64, "interleave-1"
#: Buckets of either sort: 16 ** 3, by three digits of the hash.  With B buckets a task holds about a
#: B-th of a source, whatever the size of the source.
DIGITS = 3


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list) -> DataFrame:
    """Add ``rank`` (1, 2, ...) of each row in its group by bucket and order, and ``total``, the size of the group."""
    keys = [*group, bucket]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("in_bucket"))
    # A row per group and bucket: small whatever the number of rows.
    whole = Window.partitionBy(*group)
    before = counts.select(
        *[F.col(g).alias(f"{g}_r") for g in keys],
        (F.sum("in_bucket").over(whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")).alias("before"),
        F.sum("in_bucket").over(whole).alias("total"),
    )
    placed = rows.withColumn("in_order", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(g).eqNullSafe(F.col(f"{g}_r")) for g in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return placed.join(before, on).withColumn("rank", F.col("before") + F.col("in_order")).drop("before", "in_order", *[f"{g}_r" for g in keys])


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, digits: int = DIGITS) -> DataFrame:
    """The shard of every row: (doc_id bigint, source, shard bigint, position bigint).

    ``shard`` runs from 0 and ``position`` from 0 within a shard.  Shard sizes differ by one row at most.  A null source is
    a source of its own.  Rows with a null id are sharded under it; rows that are equal in id and
    source are ranked one after the other, in either order, which gives the same result.
    An empty table gives an empty result.  Other columns are ignored: the result is the
    manifest by which :func:`with_shards` places the documents themselves.
    """
    return _interleaved(docs, shards, seed, digits, [], [])


def _interleaved(docs: DataFrame, shards: int, seed: str, digits: int, more: list[Column], ties: list[str]) -> DataFrame:
    """The manifest with ``more`` columns of the rows; rows equal in id and source are ranked by the columns named in ``ties``."""
    buckets = 16**digits
    # Columns of our own from the start, as the table may have any names.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *more)
    names = rows.columns[2:]
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    ranked = _ranked(rows, ["source"], "bucket", ["h", F.col("doc_id").asc_nulls_first(), *ties]).select("doc_id", "source", *names, "h", F.col("rank").alias("k"), F.col("total").alias("n"))
    # (2 k - 1) / (2 n), and the bucket that it falls in, in whole numbers.
    ranked = ranked.withColumn("part", F.expr(f"((2 * k - 1) * {buckets}) div (2 * n)")).withColumn("fraction", (2 * F.col("k") - 1) / (2 * F.col("n")))
    ranked = ranked.withColumn("all", F.lit(0))
    placed = _ranked(ranked, ["all"], "part", ["fraction", F.col("source").asc_nulls_first(), "h", F.col("doc_id").asc_nulls_first(), *ties])
    at = placed.select("doc_id", "source", *names, (F.col("rank") - 1).alias("at"), "total").withColumn("shard", F.expr(f"(at * {shards}) div total"))
    # The first place of shard s is the least a with a * shards >= s * total.
    return at.select("doc_id", "source", *names, "shard", (F.col("at") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("position"))


def with_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The documents with their shard and position, all columns kept.

    Rows are ranked with all their columns, so that each has one place of the manifest, also those with a null id or
    an id that repeats; rows equal in id and source are ranked by a hash of all columns.
    """
    kept = [c for c in docs.columns if c not in ("shard", "position")]
    row = F.struct(*[F.col(c) for c in kept]).alias("row")
    placed = _interleaved(docs, shards, seed, DIGITS, [row, F.xxhash64(*kept).alias("tie")], ["tie"])
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", "position")
