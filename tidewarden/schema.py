"""Canonical record shapes and fixed values of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("features", T.MapType(T.StringType(), T.StringType())),
        T.StructField("feature_vector", T.ArrayType(T.DoubleType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

SCORED_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("feature_vector", T.ArrayType(T.DoubleType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("burst_count", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("dashboard_url", T.StringType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("task_id", T.IntegerType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("failed_at_ms", T.LongType()),
    ]
)

# --- fixed values -----------------------------------------------------------

SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_STATUSES = ["ACTIVE", "ACKNOWLEDGED", "RESOLVED"]
LABELS = ["TP", "FP", "TN", "FN"]
JOB_STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED"]

# Lower bounds of the alert severity ladder, highest first, and the burst limit.
ALERT_LADDER = [("CRITICAL", 0.95), ("HIGH", 0.90), ("MEDIUM", 0.80), ("LOW", 0.70)]
BURST_LIMIT = 10
BURST_WINDOW_MS = 60_000

# Lower bounds of the scoring worker's ladder (below the last bound: LOW).
WORKER_LADDER = [("CRITICAL", 0.9), ("HIGH", 0.75), ("MEDIUM", 0.5)]

# Lower bounds of the lower-case ladder (below the last bound: low).
LOWERCASE_LADDER = [("critical", 0.95), ("high", 0.85), ("medium", 0.75)]

SLA_SECONDS = {"NONE": 0, "LOW": 5, "MEDIUM": 10, "HIGH": 30, "CRITICAL": 60}
CHANNELS = {
    "slack": ["MEDIUM", "HIGH", "CRITICAL"],
    "email": ["HIGH", "CRITICAL"],
    "pagerduty": ["CRITICAL"],
}

ANOMALY_THRESHOLD = 0.7

# Five serving features and the ones among them that are right-skewed.
SERVING_FEATURES = [
    "packet_length",
    "flow_duration",
    "fwd_packets/s",
    "bwd_packets/s",
    "flag_counts",
]
SERVING_SKEWED = ["packet_length", "flow_duration"]

# The full list: network, financial, server, temporal and derived features.
ALL_FEATURES = [
    "packet_length",
    "flow_duration",
    "fwd_packets/s",
    "bwd_packets/s",
    "flag_counts",
    "price",
    "volume",
    "bid_ask_spread",
    "price_return_1m",
    "volume_z_score",
    "cpu_pct",
    "mem_pct",
    "disk_io_bytes",
    "net_rx_bytes",
    "error_rate",
    "hour_of_day",
    "day_of_week",
    "is_market_hours",
    "rolling_mean_5m",
    "rolling_std_5m",
    "deviation_from_mean",
]
ALL_SKEWED = ["packet_length", "flow_duration", "disk_io_bytes", "net_rx_bytes", "volume"]

# Upper bounds, in seconds, of the scoring latency histogram.
LATENCY_BOUNDS_S = [
    0.0005,
    0.001,
    0.002,
    0.005,
    0.010,
    0.020,
    0.050,
    0.100,
    0.200,
    0.500,
    1.000,
]

# Days or hours each event stream is kept.
STREAM_RETENTION = {
    "raw-events": "24 hours",
    "scored-events": "72 hours",
    "alerts": "7 days",
    "model-updates": "30 days",
}
TABLE_RETENTION_DAYS = 90

# What refused requests are told, and where alerts point to by default.
REFUSAL = {
    "acknowledge": "Cannot acknowledge a resolved alert.",
    "alert": "Alert not found",
    "label": "Invalid label. Must be TP, FP, TN, or FN.",
    "event": "Event not found",
}
DASHBOARD = "http://localhost:3000"
# Fixed values of synthetic and replayed events.
SEED_TOPS = {"cpu_util": 100, "mem_util": 100, "net_rx_mbps": 1000, "net_tx_mbps": 1000, "latency_ms": 500}
PROBE_FEATURES = {"f1": 0.98, "f2": 0.96, "f3": 0.99}
REPLAY_SOURCE, REPLAY_TYPE = "cicids-replay", "network_flow"

COMPACT_AFTER_DAYS = 7

# The Avro record of raw events.
RAW_EVENT_AVRO = """{"type": "record", "name": "RawEvent", "fields": [
  {"name": "event_id", "type": "string"}, {"name": "source_id", "type": "string"}, {"name": "event_type", "type": "string"},
  {"name": "features", "type": {"type": "map", "values": "double"}},
  {"name": "event_time", "type": {"type": "long", "logicalType": "timestamp-millis"}}]}"""
