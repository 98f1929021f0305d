"""Schemas of the library's own tables. Readers take these; nothing is inferred."""

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("geo", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("sensitivity", T.StringType()),
        T.StructField("kg_value", T.IntegerType()),
        T.StructField("doc_type", T.StringType()),
    ]
)
CONDITION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("unit_canon", T.StringType())])
VALUE = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("material", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("comparator", T.StringType()),
        T.StructField("unit_canon", T.StringType()),
        T.StructField("unit_raw", T.StringType()),
        T.StructField("value_low", T.DoubleType()),
        T.StructField("value_high", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("span_start", T.IntegerType()),
        T.StructField("span_end", T.IntegerType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
    ]
)
MENTION = T.StructType(
    [
        T.StructField("canon", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("span_start", T.IntegerType()),
        T.StructField("span_end", T.IntegerType()),
        T.StructField("form", T.StringType()),
    ]
)
PARAMETER = T.StructType(
    [
        T.StructField("pkey", T.StringType(), False),
        T.StructField("doc_id", T.StringType()),
        T.StructField("canon", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("unit_canon", T.StringType()),
        T.StructField("value_low", T.DoubleType()),
        T.StructField("value_high", T.DoubleType()),
        T.StructField("comparator", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("quote", T.StringType()),
        T.StructField("conditions", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("extracted_at", T.TimestampType()),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("src_label", T.StringType()),
        T.StructField("src_key", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("dst_label", T.StringType()),
        T.StructField("dst_key", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
    ]
)
SUBSCRIPTION = T.StructType([T.StructField("user", T.StringType()), T.StructField("query", T.StringType()), T.StructField("last_seen", T.TimestampType())])
AUDIT = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("role", T.StringType()), T.StructField("event", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("n_results", T.LongType())])
