"""Declared schemas. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

GENERATION = T.StructType(
    [
        T.StructField("period", T.TimestampNTZType(), False),
        T.StructField("respondent", T.StringType(), False),
        T.StructField("respondent_name", T.StringType(), False),
        T.StructField("fueltype", T.StringType(), False),
        T.StructField("type_name", T.StringType(), False),
        T.StructField("value_units", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
    ]
)

REGION = T.StructType(
    [
        T.StructField("period", T.TimestampNTZType(), False),
        T.StructField("respondent", T.StringType(), False),
        T.StructField("respondent_name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("type_name", T.StringType(), False),
        T.StructField("value_units", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
    ]
)

# Raw API record as landed: every scalar is read as text (quoted and unquoted numbers
# alike), both key spellings are declared, unknown keys are ignored.
_RAW_COMMON = [
    T.StructField("period", T.StringType()),
    T.StructField("respondent", T.StringType()),
    T.StructField("respondent-name", T.StringType()),
    T.StructField("respondent_name", T.StringType()),
    T.StructField("type-name", T.StringType()),
    T.StructField("type_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("value-units", T.StringType()),
    T.StructField("value_units", T.StringType()),
]
RAW_GENERATION_RECORD = T.StructType(_RAW_COMMON + [T.StructField("fueltype", T.StringType())])
RAW_REGION_RECORD = T.StructType(_RAW_COMMON + [T.StructField("type", T.StringType())])


def envelope(record: T.StructType) -> T.StructType:
    """``{"response": {"total": ..., "data": [record, ...]}}``; total read as text."""
    inner = T.StructType(
        [
            T.StructField("total", T.StringType()),
            T.StructField("data", T.ArrayType(record)),
        ]
    )
    return T.StructType([T.StructField("response", inner)])


PAGES = T.StructType(
    [
        T.StructField("source_pdf", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("page_text", T.StringType(), True),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("source_pdf", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)

CHUNK_VECTORS = T.StructType(
    CHUNKS.fields + [T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)]
)
