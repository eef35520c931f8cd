"""The 37-feature vector of a window.

Two passes over disjoint columns of the flows, both combined on the map side:

* plain sums and shares per window, which shuffle one row per task and window, and
* counts per (window, key) for the four distinct counts, the retry rate and the two entropies.
  One ``groupingSets`` aggregation covers all keys, so the address and port columns are scanned
  once and a hot window is spread over its keys before the second, tiny aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions.addresses import is_private_flow
from flowcast.functions.risk import ratio
from flowcast.operators.timeline import time_chunk, with_previous
from flowcast.operators.windows import SOURCE, window_start

_KEYS = ("src_ip", "dst_ip", "src_port", "dst_port")
_SETS = {
    "src_ip": ("src_ip",),
    "dst_ip": ("dst_ip",),
    "src_port": ("src_port",),
    "dst_port": ("dst_port",),
    "service": ("src_ip", "dst_ip", "dst_port"),
}


def _carries(flag: str) -> Column:
    return F.find_in_set(F.lit(flag), F.coalesce(F.col("tcp_flags"), F.lit(""))) > 0


def window_sums(flows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Sums, means and flag counts per window."""
    duration = F.coalesce(F.col("duration_ms"), F.lit(0))
    packet_size = ratio(F.col("byte_count"), F.col("packet_count"))
    windowed = flows.withColumn("window_start", window_start(seconds))
    return windowed.groupBy(*by, "window_start").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.sum("packet_count").alias("packet_count"),
        F.sum("byte_count").alias("byte_count"),
        F.avg(duration).alias("avg_duration_ms"),
        F.stddev_pop(packet_size).alias("packet_length_std"),
        *[F.count_if(F.col("protocol") == p).alias(f"_{p.lower()}") for p in ("TCP", "UDP", "ICMP")],
        *[F.count_if(_carries(f)).alias(f"_{f.lower()}") for f in ("SYN", "ACK", "FIN", "RST")],
        F.count_if(F.col("failed_connection")).alias("_failed"),
        F.count_if(duration < fv.SHORT_FLOW_MS).alias("_short"),
        F.count_if(is_private_flow(F.col("dst_ip"))).alias("_inbound"),
    )


def window_keys(flows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Exact distinct counts, distinct services and entropies per window."""
    windowed = flows.select(*by, window_start(seconds).alias("window_start"), *_KEYS)
    group = [*by, "window_start"]
    columns = [F.col(c) for c in (*group, *_KEYS)]
    sets = [[F.col(c) for c in (*group, *keys)] for keys in _SETS.values()]
    counted = windowed.groupingSets(sets, *columns).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*columns).alias("_set")
    )

    # grouping_id has a 1 bit for every key column that is rolled up.
    def set_id(keys: tuple[str, ...]) -> int:
        bits = ["0"] * len(group) + ["0" if k in keys else "1" for k in _KEYS]
        return int("".join(bits), 2)

    def of(name: str) -> Column:
        hit = F.col("_set") == set_id(_SETS[name])
        return hit & F.col(name).isNotNull() if name in _KEYS else hit

    def entropy(name: str) -> Column:
        n = F.when(of(name), F.col("n"))
        total = F.sum(n)
        bits = F.log2(total) - F.sum(n * F.log2(n)) / total
        return F.coalesce(F.greatest(bits, F.lit(0.0)), F.lit(0.0))

    return counted.groupBy(*group).agg(
        *[F.count_if(of(k)).alias(f"unique_{k}s") for k in _KEYS],
        F.count_if(of("service")).alias("_services"),
        entropy("src_ip").alias("src_ip_entropy"),
        entropy("dst_port").alias("dst_port_entropy"),
    )


def sum_features(sums: DataFrame, seconds: int) -> DataFrame:
    """Averages, shares and rates from ``window_sums``; the helper counts stay for the momentum."""
    n = F.col("flow_count")
    share = {
        "protocol_tcp_ratio": "_tcp", "protocol_udp_ratio": "_udp", "protocol_icmp_ratio": "_icmp",
        "syn_ratio": "_syn", "ack_ratio": "_ack", "fin_ratio": "_fin", "rst_ratio": "_rst",
        "failed_conn_ratio": "_failed", "short_flow_ratio": "_short",
    }
    rates = {"packet_rate_per_sec": "packet_count", "byte_rate_per_sec": "byte_count", "flow_rate_per_sec": "flow_count"}
    return sums.withColumns(
        {
            "avg_packets_per_flow": F.col("packet_count") / n,
            "avg_bytes_per_flow": F.col("byte_count") / n,
            "packet_length_mean": ratio(F.col("byte_count"), F.col("packet_count")),
            **{name: F.col(count) / n for name, count in share.items()},
            "syn_ack_ratio": F.col("_syn") / (F.col("_ack") + 1),
            "inbound_outbound_ratio": F.col("_inbound") / (n - F.col("_inbound") + 1),
            **{name: F.col(total) / F.lit(seconds) for name, total in rates.items()},
        }
    )


_MOMENTUM_INPUTS = (
    "packet_count", "_syn", "packet_rate_per_sec", "byte_rate_per_sec", "syn_ratio", "failed_conn_ratio", "unique_dst_ports",
)


def burst(value: Column, previous: Column, min_history: int = 1) -> Column:
    """Value over (mean of the previous windows + 1); neutral 1.0 with less than ``min_history`` of them."""
    size = F.size(previous)
    total = F.aggregate(previous, F.lit(0.0), lambda acc, x: acc + x)
    score = value / (total / F.greatest(size, F.lit(1)) + 1)
    return F.when(size >= min_history, score).otherwise(F.lit(1.0))


def with_momentum(base: DataFrame, seconds: int, by: Sequence[str] = SOURCE, min_history: int = 1) -> DataFrame:
    """Burst scores over the last three windows and deltas to the previous one.

    ``delta_packet_burst_score`` needs the previous window's own burst score, hence four windows back.
    """
    depth = fv.BURST_LOOKBACK + 1
    chunk = time_chunk(F.col("window_start"), seconds)
    df = with_previous(base, by, "window_start", list(_MOMENTUM_INPUTS), depth, chunk)
    past = F.col("_previous")
    count = F.size(past)
    last = F.get(past, count - 1)

    def recent(field: str, skip: int = 0) -> Column:
        """The up to three windows before the current one (or before the previous one)."""
        end = count - skip
        begin = F.greatest(end - fv.BURST_LOOKBACK, F.lit(0))
        return F.transform(F.slice(past, begin + 1, F.greatest(end - begin, F.lit(0))), lambda r: r[field].cast("double"))

    packet_burst = burst(F.col("packet_count"), recent("packet_count"), min_history)
    previous_burst = burst(last["packet_count"], recent("packet_count", 1), min_history)

    def delta(field: str) -> Column:
        return F.coalesce(F.col(field) - last[field], F.lit(0))

    return df.withColumns(
        {
            "packet_burst_score": packet_burst,
            "syn_burst_score": burst(F.col("_syn"), recent("_syn"), min_history),
            "delta_packet_rate": delta("packet_rate_per_sec"),
            "delta_byte_rate": delta("byte_rate_per_sec"),
            "delta_syn_ratio": delta("syn_ratio"),
            "delta_failed_conn_ratio": delta("failed_conn_ratio"),
            "delta_unique_dst_ports": delta("unique_dst_ports"),
            "delta_packet_burst_score": F.when(count > 0, packet_burst - previous_burst).otherwise(F.lit(0.0)),
        }
    ).drop("_previous")


def base_features(flows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """The features that need one window only.  Both sides are already partitioned by the join key."""
    sums = sum_features(window_sums(flows, seconds, by), seconds)
    keys = window_keys(flows, seconds, by)
    joined = sums.join(keys, [*by, "window_start"])
    retries = (F.col("flow_count") - F.col("_services")) / F.col("flow_count")
    return joined.withColumn("retry_rate", retries)


def window_features(flows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE, min_history: int = 1) -> DataFrame:
    """All 37 features in contract order, with schema version and completeness."""
    return contract_columns(with_momentum(base_features(flows, seconds, by), seconds, by, min_history), seconds, by)


def contract_columns(full: DataFrame, seconds: int, by: Sequence[str] = SOURCE, *others: str) -> DataFrame:
    """Keys, window bounds, the features in contract order and type, schema version and completeness."""
    casts = {"integer": "bigint", "number": "double"}
    return full.select(
        *by,
        "window_start",
        F.timestamp_seconds(F.unix_seconds("window_start") + seconds).alias("window_end"),
        *[F.col(name).cast(casts[kind]).alias(name) for name, kind, _, _ in fv.FEATURE_SPECS],
        F.lit(fv.FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
        F.lit(True).alias("is_complete"),
        F.array().cast("array<string>").alias("missing_fields"),
        *others,
    )


def feature_violations(features: DataFrame, schema_version: str = fv.FEATURE_SCHEMA_VERSION, given: Sequence[str] = ()) -> DataFrame:
    """Add ``violations``: every way a vector breaks the contract, in feature order.

    A missing column counts as missing in every row; text columns must hold numbers.  ``given`` names the columns that
    are meant as features; one that the contract does not know is a violation wherever it holds a value.
    """
    types = dict(features.dtypes)
    checks: list[Column] = []
    if "feature_schema_version" in types:
        mismatch = ~F.col("feature_schema_version").eqNullSafe(F.lit(schema_version))
        checks.append(F.when(mismatch, "FEATURE_SCHEMA_MISMATCH"))
    for name, kind, low, high in fv.FEATURE_SPECS:
        checks.append(_violation(name, types.get(name), kind, low, high))
    if "flow_count" in types:
        checks.append(F.when(F.col("flow_count").try_cast("double") == 0, "flow_count: must be >= 1"))
    for name in sorted(set(given) - set(fv.FEATURE_NAMES)):
        checks.append(F.when(F.col(name).isNotNull(), f"{name}: unexpected"))
    return features.withColumn("violations", F.array_compact(F.array(*checks)))


def broken_vector(vector: Column) -> Column:
    """Whether a struct of numeric features breaks the contract."""
    problems = [_violation(name, "double", kind, low, high, vector[name]) for name, kind, low, high in fv.FEATURE_SPECS]
    return F.coalesce(*problems, F.when(vector["flow_count"] == 0, "flow_count")).isNotNull()


def _violation(name: str, dtype: str | None, kind: str, low: float | None, high: float | None, value: Column | None = None) -> Column:
    if dtype is None:
        return F.lit(f"{name}: missing")
    value = F.col(name) if value is None else value
    if dtype in ("string", "boolean", "timestamp", "binary"):
        return F.when(value.isNull(), f"{name}: missing").otherwise(F.lit(f"{name}: not numeric"))
    number = value.cast("double")
    problem = F.when(value.isNull(), f"{name}: missing").when(
        F.isnan(number) | (F.abs(number) == float("inf")), f"{name}: NaN or inf"
    )
    if kind == "integer":
        problem = problem.when(number != F.floor(number), f"{name}: must be an integer")
    if low is not None:
        problem = problem.when(number < low, f"{name}: below minimum {low}")
    if high is not None:
        problem = problem.when(number > high, f"{name}: above maximum {high}")
    return problem


def valid_features(features: DataFrame) -> DataFrame:
    return feature_violations(features).filter(F.size("violations") == 0).drop("violations")


# --- Research features ------------------------------------------------------------------


def normalized_entropy(features: DataFrame) -> DataFrame:
    """Entropies as a share of their maximum; 0 for windows of one flow."""
    n = F.col("flow_count").cast("double")
    ports = F.col("dst_port_entropy") / F.log2(F.least(n, F.lit(65536.0)))
    sources = F.col("src_ip_entropy") / F.log2(n)
    return features.withColumns(
        {
            "dst_port_entropy_norm": F.when(n > 1, ports).otherwise(F.lit(0.0)),
            "src_ip_entropy_norm": F.when(n > 1, sources).otherwise(F.lit(0.0)),
        }
    )


def volume_momentum(features: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE, depth: int = 3) -> DataFrame:
    """Log packet momentum, byte momentum and burst z-score against the previous windows (NULL without any)."""
    chunk = time_chunk(F.col("window_start"), seconds)
    df = with_previous(features, by, "window_start", ["packet_count", "byte_count"], depth, chunk)

    def mean(field: str) -> Column:
        return F.aggregate("_previous", F.lit(0.0), lambda acc, r: acc + r[field]) / n

    n = F.nullif(F.size("_previous"), F.lit(0))
    packets = mean("packet_count")
    spread = F.sqrt(F.aggregate("_previous", F.lit(0.0), lambda acc, r: acc + F.pow(r["packet_count"] - packets, F.lit(2))) / n)
    return df.withColumns(
        {
            "log_packet_momentum": F.log((F.col("packet_count") + 1.0) / (packets + 1.0)),
            "byte_momentum": F.col("byte_count") / (mean("byte_count") + 1.0),
            "burst_z_score": (F.col("packet_count") - packets) / (spread + 1e-3),
        }
    ).drop("_previous")


def acceleration(
    features: DataFrame, names: Sequence[str], seconds: int = 60, by: Sequence[str] = SOURCE
) -> DataFrame:
    """Second differences f(t) - 2 f(t-1) + f(t-2), NULL before the third window."""
    chunk = time_chunk(F.col("window_start"), seconds)
    df = with_previous(features, by, "window_start", list(names), 2, chunk)
    past = F.col("_previous")
    second = {f"{n}_acceleration": F.col(n) - 2 * F.get(past, F.lit(1))[n] + F.get(past, F.lit(0))[n] for n in names}
    return df.withColumns(second).drop("_previous")
