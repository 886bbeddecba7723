"""Column lists and types of the four tables the library works on."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("content", T.StringType(), True),
        T.StructField("size", T.LongType(), True),
        T.StructField("mtime", T.TimestampType(), True),
        T.StructField("ctime", T.TimestampType(), True),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), True),
        T.StructField("end_line", T.IntegerType(), True),
        T.StructField("file_hash", T.StringType(), True),
        T.StructField("chunk_hash", T.StringType(), True),
        T.StructField("file_mtime", T.TimestampType(), True),
        T.StructField("file_ctime", T.TimestampType(), True),
        T.StructField("content", T.StringType(), True),
    ]
)

INDEX = T.StructType(
    [f for f in CHUNK.fields if f.name != "content"]
    + [T.StructField("vector", T.ArrayType(T.FloatType()), True)]
)

CHUNK_COLUMNS = CHUNK.fieldNames()
INDEX_COLUMNS = INDEX.fieldNames()
# What a read of the index returns unless vectors are asked for.
INDEX_READ_COLUMNS = [c for c in INDEX_COLUMNS if c != "vector"]
