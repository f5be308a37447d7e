"""Streams of timed text. Parsing keeps no state, so it runs on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strophe.plans.convert import convert, parse


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Whole text files as they arrive: (text, path)."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return stream.selectExpr("value AS text", "_metadata.file_path AS path")


def parse_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return parse(stream, text)


def convert_stream(stream: DataFrame, to: str, out_path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Converted rows to Parquet, exactly once, for what has arrived so far."""
    done = convert(stream, to, text)
    return done.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
