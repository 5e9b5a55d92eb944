"""The same operators over streams.

Every operator on single documents is a column expression, and runs under Structured Streaming as
it is; here are the pieces around them.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scripts import detect_script


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Transform all that is there into Parquet files, exactly once, and stop.

    ``checkpoint`` must be a folder that the whole cluster shares.
    """
    query = transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def scripts_by_window(stream: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, script, documents): scripts of the documents of each window; later ones than the watermark are dropped."""
    marked = stream.withWatermark(time, late).select(time, F.coalesce(detect_script(F.col("text")), F.lit("none")).alias("script"))
    counted = marked.groupBy(F.window(time, window), "script").agg(F.count("*").alias("documents"))
    return counted.select(F.col("window.start").alias("start"), "script", "documents")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares, from ``spark.checkpoint.dir``.

    Where none is named a session on one machine, as in tests, gets one of that machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return where or tempfile.mkdtemp(prefix="steppe-")
