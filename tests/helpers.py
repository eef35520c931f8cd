"""Small builders for test frames."""

import datetime

from pyspark.sql import functions as F

FLOW_SCHEMA = (
    "traffic_source_id string, at double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "packet_count long, byte_count long, duration_ms long, tcp_flags string, failed_connection boolean, label string"
)


def flow(at, source="s", src="10.0.0.1", dst="8.8.8.8", sport=1, dport=80, proto="TCP", packets=1, size=100, duration=10, flags=None, failed=None, label="BENIGN"):
    return (source, float(at), src, dst, sport, dport, proto, packets, size, duration, flags, failed, label)


def flows(spark, *rows):
    df = spark.createDataFrame(list(rows), FLOW_SCHEMA)
    return df.withColumn("observed_at", F.timestamp_micros((F.col("at") * 1000000).cast("long"))).drop("at")


def moment(second):
    return datetime.datetime.fromtimestamp(second, datetime.timezone.utc).replace(tzinfo=None)


def windows(spark, rows, fields):
    """Rows of (source, window number, ...) with one-minute starts."""
    df = spark.createDataFrame(rows, "traffic_source_id string, n long, " + fields)
    return df.withColumn("window_start", F.timestamp_seconds(F.col("n") * 60))
