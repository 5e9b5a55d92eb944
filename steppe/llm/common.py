"""What the operators share: batches cut by size, reliable checkpoints, packed arrays."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once in a Python worker; a single longer document is handled whole.
CHUNK_BYTES = 2 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``limit`` bytes of text, keeping every row and its order."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.cumsum(np.asarray(size, dtype=np.int64) + 16)
        begin, before = 0, 0
        while begin < n:
            stop = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin, before = stop, int(total[stop - 1])


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session is set to; operators split their keys accordingly."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as named in ``spark.checkpoint.dir``.

    It is read from the session.  Where none is named, a local session, as in tests, gets one of this machine; on a
    cluster that is an error, as its machines would each write to a folder of their own.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return where or tempfile.mkdtemp(prefix="steppe-")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that was written in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def u64(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Non-null 64-bit integers as unsigned numpy values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The contents of all binary values of a column, one after the other."""
    parts_ = []
    for chunk in column.chunks:
        if len(chunk):
            chunk = chunk.cast(pa.large_binary())
            offs = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            if chunk.buffers()[2] is not None:
                parts_.append(np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]])
    raw = np.concatenate(parts_) if parts_ else np.zeros(0, np.uint8)
    return raw.view(np.dtype(dtype)) if len(raw) else np.zeros(0, np.dtype(dtype))


def pack48(x: np.ndarray) -> bytes:
    """Little-endian low 48 bits of each value."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return start, np.diff(np.append(start, len(sorted_keys)))
