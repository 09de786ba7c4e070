"""Table schemas. Every reader names its schema; nothing is inferred.

``day`` is the partition column of ``activity`` and ``turns``; ``bucket`` that
of ``postings``. Operators also accept TIMESTAMP_NTZ for the time columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

SCHEMA_VERSION = 1
_VERSION_KEY = "schema_version"

ACTIVITY = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("device", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("day", T.DateType()),
    T.StructField("kind", T.StringType()),
    T.StructField("track", T.StringType()),
    T.StructField("display_id", T.StringType()),
    T.StructField("app", T.StringType()),
    T.StructField("window", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_len", T.IntegerType()),
    T.StructField("media_path", T.StringType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])

WORD = T.StructType([
    T.StructField("w", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("conf", T.DoubleType()),
])

SEGMENTS = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("chunk_ts", T.TimestampType()),
    T.StructField("track", T.StringType()),
    T.StructField("seg_no", T.IntegerType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("words", T.ArrayType(WORD)),
])

ENVELOPES = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("chunk_ts", T.TimestampType()),
    T.StructField("track", T.StringType()),
    T.StructField("step_ms", T.IntegerType()),
    T.StructField("rms", T.ArrayType(T.FloatType())),
])

MEDIA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
])

POSTINGS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("day", T.DateType()),
    T.StructField("tf", T.LongType()),
    T.StructField("dl", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
])

TURNS = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("day", T.DateType()),
    T.StructField("turn_no", T.LongType()),
    T.StructField("origin", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_len", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("order_confidence", T.StringType()),
])


def stamp_version(df: DataFrame, column: str = "event_id", version: int = SCHEMA_VERSION) -> DataFrame:
    """Record the schema version as column metadata, which Parquet footers keep."""
    return df.withColumn(column, F.col(column).alias(column, metadata={_VERSION_KEY: version}))


def stored_version(df: DataFrame) -> int | None:
    """The schema version a table read without an explicit schema carries, if any."""
    found = [f.metadata[_VERSION_KEY] for f in df.schema.fields if _VERSION_KEY in f.metadata]
    return max(found) if found else None
