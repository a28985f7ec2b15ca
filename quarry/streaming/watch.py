"""Searches over streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.match import matches, matching_lines
from quarry.spec import SearchSpec


def watched(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_matches(docs: DataFrame, spec: SearchSpec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """matching_lines of a stream: stateless, so it appends."""
    return matching_lines(docs, spec, key, text)


def windowed_counts(
    events: DataFrame, spec: SearchSpec, ts: str, text: str, window: str = "5 minutes", late: str = "10 minutes"
) -> DataFrame:
    """(start, n) of matching events by time window, with a watermark for late ones; works on streams and tables."""
    hits = events.withWatermark(ts, late).filter(matches(F.col(text), spec))
    return hits.groupBy(F.window(ts, window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
