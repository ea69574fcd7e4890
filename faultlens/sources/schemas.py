"""Explicit schemas for every input (no inference)."""

from pyspark.sql import types as T

TAG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

PROCESS = T.StructType([
    T.StructField("serviceName", T.StringType()),
    T.StructField("tags", T.ArrayType(TAG)),
])

REFERENCE = T.StructType([T.StructField("spanID", T.StringType())])

SPANS = T.StructType([
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("spanID", T.StringType()),
    T.StructField("operationName", T.StringType()),
    T.StructField("duration", T.LongType()),
    T.StructField("process", PROCESS),
    T.StructField("references", T.ArrayType(REFERENCE)),
    T.StructField("tags", T.ArrayType(TAG)),
])

LOGS = T.StructType([
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("time_beijing", T.StringType()),
    T.StructField("k8_pod", T.StringType()),
    T.StructField("k8_node_name", T.StringType()),
    T.StructField("message", T.StringType()),
])

# Tall metric table: one row per (source, entity, metric, sample).
METRIC_POINTS = T.StructType([
    T.StructField("source", T.StringType()),      # service | pod | tidb | node | infra_pod
    T.StructField("service", T.StringType()),
    T.StructField("pod", T.StringType()),
    T.StructField("node", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("value", T.DoubleType()),
])
