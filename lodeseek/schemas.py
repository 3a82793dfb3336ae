"""Fixed schemas of the index tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2



CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("file_hash", T.StringType()),
        T.StructField("identifiers", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
SYNC_STATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
FILES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("modified_at", T.TimestampType())])
