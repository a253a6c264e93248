"""The trace fold as a stream: the same aggregate as the batch fold, in complete mode or by watermarked windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.sequence import fold_trace


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_fold(events: DataFrame, node: list[str], at: str, kind: str, start: str, retry: str) -> DataFrame:
    """Equal to fold_trace over all rows so far; use complete or update mode. State is one row per node."""
    return fold_trace(events, node, at, kind, start, retry)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, kind, n per tumbling window; rows later than the watermark are dropped and closed windows leave the state."""
    own = events.schema[at].dataType
    # A watermark needs a time with a zone; the starts come back in the column's own type.
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast(own).alias("start"), kind, "n")
