"""Flows, raw rows and triage requests derived from the driver's tables.

The test data holds no flow table, so ``events`` is mapped to flows with arithmetic that both
engines share.  ``FLOWS`` is the same mapping as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.session import use_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def k_of(props: Column) -> Column:
    return F.regexp_extract(props, "([0-9]+)", 1).cast("bigint")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        k_of(F.col("props")).alias("k"),
        F.floor(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def flows(spark: SparkSession, folder: str, sources: int = 4) -> DataFrame:
    e = events(spark, folder)
    k, user = F.col("k"), F.col("user_id")
    ports = F.array(*[F.lit(p) for p in (80, 443, 53, 22, 21, 8080, 3389, 445)])
    hour = F.hour("ts")
    label = (
        F.when((F.col("event_type") == "error") & hour.between(3, 4), "PortScan")
        .when((F.col("event_type") == "error") & (hour == 5), "SSH_Patator")
        .when((F.col("event_type") == "error") & hour.between(6, 7), "DDoS_LOIC")
        .otherwise("BENIGN")
    )
    flags = {"click": "SYN,ACK", "view": "PSH,ACK", "purchase": "SYN,ACK,FIN", "signup": "SYN", "error": "SYN,RST"}
    tcp_flags = None
    for kind, text in flags.items():
        hit = F.col("event_type") == kind
        tcp_flags = F.when(hit, text) if tcp_flags is None else tcp_flags.when(hit, text)
    failed = (
        F.when(F.col("event_type") == "error", True)
        .when((F.col("event_type") == "signup") & (k % 3 == 0), True)
        .when(k % 8 == 2, F.lit(None))
        .otherwise(False)
    )
    return e.select(
        F.concat(F.lit("s"), (user % sources).cast("string")).alias("traffic_source_id"),
        "event_id",
        F.col("ts").alias("observed_at"),
        F.concat(F.lit("192.168."), (F.floor(user / 250) % 250).cast("string"), F.lit("."), (user % 250).cast("string")).alias("src_ip"),
        F.when(k % 3 == 0, F.concat(F.lit("10.0.0."), k.cast("string")))
        .otherwise(F.concat(F.lit("8.8."), k.cast("string"), F.lit(".8"))).alias("dst_ip"),
        (1024 + F.col("event_id") % 60000).cast("int").alias("src_port"),
        F.get(ports, (k % 8).cast("int")).alias("dst_port"),
        F.when(k % 8 == 2, "UDP").when(k % 17 == 0, "ICMP").otherwise("TCP").alias("protocol"),
        (1 + F.floor(F.col("cents") / 100)).cast("bigint").alias("packet_count"),
        F.col("cents").alias("byte_count"),
        F.floor(F.col("cents") / 10).cast("bigint").alias("duration_ms"),
        tcp_flags.alias("tcp_flags"),
        failed.alias("failed_connection"),
        label.alias("label"),
    )


# The same flows in the check engine's SQL.  ``us`` is the time in microseconds.
EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CAST(floor(value * 100) AS BIGINT) AS cents, epoch_us(ts) AS us FROM events)"""


def flows_sql(sources: int = 4) -> str:
    return EVENTS + f""", flows AS (SELECT 's' || (user_id % {sources}) AS traffic_source_id, event_id, ts, us,
  '192.168.' || ((user_id // 250) % 250) || '.' || (user_id % 250) AS src_ip,
  CASE WHEN k % 3 = 0 THEN '10.0.0.' || k ELSE '8.8.' || k || '.8' END AS dst_ip,
  CAST(1024 + event_id % 60000 AS INTEGER) AS src_port,
  CAST([80, 443, 53, 22, 21, 8080, 3389, 445][(k % 8) + 1] AS INTEGER) AS dst_port,
  CASE WHEN k % 8 = 2 THEN 'UDP' WHEN k % 17 = 0 THEN 'ICMP' ELSE 'TCP' END AS protocol,
  1 + cents // 100 AS packet_count, cents AS byte_count, cents // 10 AS duration_ms,
  CASE event_type WHEN 'click' THEN 'SYN,ACK' WHEN 'view' THEN 'PSH,ACK' WHEN 'purchase' THEN 'SYN,ACK,FIN'
    WHEN 'signup' THEN 'SYN' WHEN 'error' THEN 'SYN,RST' END AS tcp_flags,
  CASE WHEN event_type = 'error' THEN true WHEN event_type = 'signup' AND k % 3 = 0 THEN true
    WHEN k % 8 = 2 THEN NULL ELSE false END AS failed_connection,
  CASE WHEN event_type = 'error' AND hour(ts) BETWEEN 3 AND 4 THEN 'PortScan'
    WHEN event_type = 'error' AND hour(ts) = 5 THEN 'SSH_Patator'
    WHEN event_type = 'error' AND hour(ts) BETWEEN 6 AND 7 THEN 'DDoS_LOIC' ELSE 'BENIGN' END AS label
  FROM ev)"""


def r6(column: Column) -> Column:
    """Six digits, and never a negative zero."""
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def q6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"


def seconds_of(column: str) -> Column:
    return F.unix_seconds(column)
