"""Queries over windows, features and ordered operators, each over the whole table.

One-hour windows, because the test events spread over thirty days.  Times leave as epoch seconds
and doubles with six digits, so that both engines print the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.testbed import events, flows, flows_sql, q6, r6
from flowcast import fixed_values as fv
from flowcast.operators import evaluation, features, labeling, windows

W = 3600
BY = ["traffic_source_id"]
INTEGERS = [n for n, kind, _, _ in fv.FEATURE_SPECS if kind == "integer"]


def show(df: DataFrame, names, keys=("traffic_source_id",)) -> DataFrame:
    """Keys, window start in seconds, and the named columns in comparable form."""
    types = dict(df.dtypes)
    shown = [r6(F.col(n)).alias(n) if types[n] in ("double", "float") else F.col(n).alias(n) for n in names]
    return df.select(*keys, F.unix_seconds("window_start").alias("window_start"), *shown)


def feats(spark, folder, sources: int = 4) -> DataFrame:
    return features.window_features(flows(spark, folder, sources), W)


def wins(spark, folder, seconds: int = W, sources: int = 4) -> DataFrame:
    return windows.flow_windows(flows(spark, folder, sources), seconds)


# --- SQL of the feature vector ---------------------------------------------------------------


def windowed_sql(seconds: int = W, sources: int = 4) -> str:
    return f"WITH {flows_sql(sources)}, w AS (SELECT *, us // 1000000 // {seconds} * {seconds} AS ws FROM flows)"


def base_sql(seconds: int = W, sources: int = 4) -> str:
    def has(flag):
        return f"count(*) FILTER (list_contains(string_split(tcp_flags, ','), '{flag}'))"

    return windowed_sql(seconds, sources) + f""", sums AS (SELECT traffic_source_id, ws, count(*) AS flow_count,
      CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(byte_count) AS BIGINT) AS byte_count, avg(duration_ms) AS avg_duration_ms,
      stddev_pop(byte_count / packet_count) AS packet_length_std,
      count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT src_port) AS unique_src_ports,
      count(DISTINCT dst_port) AS unique_dst_ports, entropy(src_ip) AS src_ip_entropy, entropy(dst_port) AS dst_port_entropy,
      count(*) FILTER (protocol = 'TCP') AS tcp, count(*) FILTER (protocol = 'UDP') AS udp, count(*) FILTER (protocol = 'ICMP') AS icmp,
      {has('SYN')} AS syn, {has('ACK')} AS ack, {has('FIN')} AS fin, {has('RST')} AS rst, count(*) FILTER (failed_connection) AS failed,
      count(*) FILTER (duration_ms < 100) AS short, count(*) FILTER (dst_ip LIKE '10.%') AS inbound,
      count(DISTINCT (src_ip, dst_ip, dst_port)) AS services FROM w GROUP BY ALL),
    base AS (SELECT *, packet_count / flow_count AS avg_packets_per_flow, byte_count / flow_count AS avg_bytes_per_flow,
      byte_count / packet_count AS packet_length_mean, tcp / flow_count AS protocol_tcp_ratio, udp / flow_count AS protocol_udp_ratio,
      icmp / flow_count AS protocol_icmp_ratio, syn / flow_count AS syn_ratio, ack / flow_count AS ack_ratio, fin / flow_count AS fin_ratio,
      rst / flow_count AS rst_ratio, syn / (ack + 1) AS syn_ack_ratio, failed / flow_count AS failed_conn_ratio,
      short / flow_count AS short_flow_ratio, inbound / (flow_count - inbound + 1) AS inbound_outbound_ratio,
      (flow_count - services) / flow_count AS retry_rate, packet_count / {seconds} AS packet_rate_per_sec,
      byte_count / {seconds} AS byte_rate_per_sec, flow_count / {seconds} AS flow_rate_per_sec FROM sums)"""


def feats_sql(seconds: int = W, sources: int = 4) -> str:
    return base_sql(seconds, sources) + """, burst AS (SELECT *,
      coalesce(packet_count / (avg(packet_count) OVER three + 1), 1.0) AS packet_burst_score,
      coalesce(syn / (avg(syn) OVER three + 1), 1.0) AS syn_burst_score FROM base
      WINDOW three AS (PARTITION BY traffic_source_id ORDER BY ws ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    feats AS (SELECT *, coalesce(packet_rate_per_sec - lag(packet_rate_per_sec) OVER s, 0) AS delta_packet_rate,
      coalesce(byte_rate_per_sec - lag(byte_rate_per_sec) OVER s, 0) AS delta_byte_rate, coalesce(syn_ratio - lag(syn_ratio) OVER s, 0) AS delta_syn_ratio,
      coalesce(failed_conn_ratio - lag(failed_conn_ratio) OVER s, 0) AS delta_failed_conn_ratio,
      coalesce(unique_dst_ports - lag(unique_dst_ports) OVER s, 0) AS delta_unique_dst_ports,
      coalesce(packet_burst_score - lag(packet_burst_score) OVER s, 0) AS delta_packet_burst_score FROM burst
      WINDOW s AS (PARTITION BY traffic_source_id ORDER BY ws))"""


def columns_sql(names) -> str:
    return ", ".join(n if n in INTEGERS else f"{q6(n)} AS {n}" for n in names)


def labeled_sql(seconds: int = W, sources: int = 4) -> str:
    """Feature vectors with the stage and risk of their window."""
    return feats_sql(seconds, sources) + """, stages AS (SELECT traffic_source_id, ws, max(CASE label WHEN 'PortScan' THEN 1 WHEN 'SSH_Patator' THEN 2
      WHEN 'DDoS_LOIC' THEN 5 ELSE 0 END) AS stage FROM w GROUP BY ALL),
    lab AS (SELECT feats.*, stage, CAST(stage <> 0 AS INTEGER) AS risk,
      row_number() OVER (PARTITION BY feats.traffic_source_id ORDER BY feats.ws) - 1 AS row_index,
      count(*) OVER (PARTITION BY feats.traffic_source_id) AS total FROM feats JOIN stages USING (traffic_source_id, ws))"""


SPLIT_SQL = """CASE WHEN row_index >= CAST(floor(total * 0.5) AS BIGINT) THEN 'test'
  WHEN row_index >= greatest(CAST(floor(total * 0.5) AS BIGINT) - 10, 0) THEN 'purged' ELSE 'train' END"""


def split_sql() -> str:
    return labeled_sql() + f", sp AS (SELECT *, {SPLIT_SQL} AS split FROM lab)"


def labeled(spark, folder, sources: int = 4) -> DataFrame:
    return labeling.labeled_windows(flows(spark, folder, sources), W)


def split(spark, folder) -> DataFrame:
    return labeling.chrono_split(labeled(spark, folder), W)


GROUPS = {
    "volume_features": fv.FEATURE_NAMES[0:8],
    "diversity_features": fv.FEATURE_NAMES[8:12],
    "entropy_features": fv.FEATURE_NAMES[12:14],
    "protocol_mix": fv.FEATURE_NAMES[14:17],
    "tcp_health": fv.FEATURE_NAMES[17:24],
    "direction_retry": fv.FEATURE_NAMES[24:26],
    "rate_features": fv.FEATURE_NAMES[26:29],
    "burst_scores": fv.FEATURE_NAMES[29:31],
    "window_deltas": fv.FEATURE_NAMES[31:37],
}


def group_query(name):
    names = GROUPS[name]

    def run(spark, folder):
        source = flows(spark, folder)
        if name in ("volume_features", "protocol_mix", "tcp_health", "rate_features"):
            return show(features.sum_features(features.window_sums(source, W), W), names)
        if name in ("diversity_features", "entropy_features"):
            return show(features.window_keys(source, W), names)
        if name == "direction_retry":
            return show(features.base_features(source, W), names)
        return show(features.window_features(source, W), names)

    return run


def query_window_features(spark, folder):
    return show(feats(spark, folder), [*fv.FEATURE_NAMES, "feature_schema_version", "is_complete"])


def query_flow_windows(spark, folder):
    return show(wins(spark, folder, 60), ["flow_count", "packet_count", "byte_count"])


def query_scoped(spark, folder):
    scoped = windows.scoped_windows(flows(spark, folder), "host", W)
    return show(scoped, ["flow_count", "packet_count", "byte_count"], ("traffic_source_id", "scope_key"))


def query_sliding(spark, folder):
    return show(windows.sliding_windows(flows(spark, folder), "macro"), ["flow_count", "packet_count", "byte_count"])


def query_incomplete(spark, folder):
    missing = windows.incomplete_windows(wins(spark, folder), W)
    return missing.select(*BY, F.unix_seconds("window_start").alias("window_start"), F.array_join("missing_fields", ",").alias("reason"))


def query_top(spark, folder):
    top = windows.top_destinations(flows(spark, folder), 86400)
    return show(top, ["dst_ip", "dst_port", "protocol", "flows", "packets", "bytes", "rank"])


TOP_SQL = """, newest AS (SELECT traffic_source_id, max(ws) AS ws FROM w GROUP BY ALL),
  tops AS (SELECT *, row_number() OVER (PARTITION BY traffic_source_id ORDER BY bytes DESC, dst_ip, dst_port, protocol) AS rank FROM (
  SELECT traffic_source_id, ws, dst_ip, dst_port, protocol, count(*) AS flows, CAST(sum(packet_count) AS BIGINT) AS packets,
  CAST(sum(byte_count) AS BIGINT) AS bytes FROM w JOIN newest USING (traffic_source_id, ws) GROUP BY ALL))"""


def query_hosts(spark, folder):
    hosts = windows.host_entities(flows(spark, folder), 86400)
    return hosts.select(*BY, "ip_address", "entity_type", F.unix_seconds("first_seen_at").alias("first_seen"), F.unix_seconds("last_seen_at").alias("last_seen"))


def query_overview(spark, folder):
    overview = windows.traffic_overview(wins(spark, folder), feats(spark, folder))
    latest = F.get_json_object("latest_features", "$.packet_rate_per_sec").cast("double")
    return overview.select(*BY, F.unix_seconds("window_end").alias("window_end"), "packets", "bytes", "flows", "window_count", r6(latest).alias("latest_packet_rate"))


def query_timeline_summary(spark, folder):
    return windows.timeline_summary(wins(spark, folder))


def query_latest(spark, folder):
    return show(windows.latest_window(wins(spark, folder)), ["flow_count", "packet_count", "byte_count"])


def query_window_flow_join(spark, folder):
    f = flows(spark, folder)
    newest = windows.latest_window(windows.flow_windows(f, W))
    joined = windows.window_flow_range_join(f, newest, W)
    return show(joined, ["event_id", "byte_count"])


def query_window_feature_join(spark, folder):
    joined = windows.window_feature_join(wins(spark, folder), feats(spark, folder))
    picked = joined.withColumns({"feature_flows": F.col("features.flow_count"), "burst": F.col("features.packet_burst_score")})
    return show(picked, ["flow_count", "feature_flows", "burst"])


def query_page_windows(spark, folder):
    page = windows.page_windows(wins(spark, folder), "s1", after=_moment("2024-01-10 00:00:00"), limit=25)
    return show(page.withColumn("next_cursor", F.unix_seconds("next_cursor")), ["flow_count", "packet_count", "next_cursor"])


def _moment(text):
    import datetime

    return datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)


def query_history(spark, folder):
    samples = labeling.history_sequences(labeled(spark, folder), W)
    listed = F.transform("history", lambda h: F.unix_seconds(h["window_start"]))
    total = F.aggregate("history", F.lit(0).cast("bigint"), lambda acc, h: acc + h["byte_count"])
    shown = samples.withColumns({"first": listed[0], "last": listed[9], "history_bytes": total})
    return show(shown, ["first", "last", "history_bytes", "byte_count", "risk", "stage"])


def query_chrono(spark, folder):
    return show(split(spark, folder), ["row_index", "split"])


def query_embargo(spark, folder):
    ended = wins(spark, folder)
    return show(labeling.embargo_split(ended, "2024-01-16 00:00:00", W, 300), ["split"])


def scored(spark, folder) -> DataFrame:
    """Windows with the rule probability as score and the window's risk as truth."""
    from flowcast.operators.forecasts import rule_forecast

    forecast = rule_forecast(labeled(spark, folder))
    return forecast.select("traffic_source_id", "window_start", F.col("risk").alias("y_true"), (F.col("risk_score") / 100.0).alias("y_score"), F.lit("rules").alias("model"))


def query_episodes(spark, folder):
    truth = labeling.window_labels(flows(spark, folder), W).withColumn("y_true", F.col("risk"))
    episodes = evaluation.attack_episodes(truth, W)
    return episodes.select(*BY, "first_index", "last_index", F.unix_seconds("first_start").alias("first_start"), F.unix_seconds("last_start").alias("last_start"))


def query_transitions(spark, folder):
    stages = labeling.window_labels(flows(spark, folder), W)
    return show(evaluation.stage_transitions(stages, W), ["from_stage", "to_stage"])


def query_window_labels(spark, folder):
    return show(labeling.window_labels(flows(spark, folder), W), ["stage", "risk", "stage_name"])


def query_labeled(spark, folder):
    return show(labeled(spark, folder), [*fv.FEATURE_NAMES, "stage", "risk"])


def query_horizon(spark, folder):
    f = flows(spark, folder)
    epochs = windows.flow_windows(f, 300).select("traffic_source_id", F.col("window_end").alias("epoch"))
    out = labeling.horizon_labels(epochs, f, 1800, 300)
    return out.select(*BY, F.unix_seconds("epoch").alias("epoch"), "target_binary", "target_stage", F.array_join("attack_classes", ",").alias("attack_classes"))


def timeline(spark, folder) -> DataFrame:
    """Reviewed intervals, one to three per day, overlapping, from the days the events cover."""
    day = F.date_trunc("day", "ts")
    days = events(spark, folder).select(day.alias("d")).distinct()
    at = F.unix_seconds("d")
    kinds = F.array(
        F.struct(F.lit(0).alias("line"), F.lit("PortScan").alias("label"), F.lit(10800).alias("from_s"), F.lit(18000).alias("to_s")),
        F.struct(F.lit(1).alias("line"), F.lit("SSH_Patator").alias("label"), F.lit(14400).alias("from_s"), F.lit(21600).alias("to_s")),
        F.struct(F.lit(2).alias("line"), F.lit("DDoS_LOIC").alias("label"), F.lit(14400).alias("from_s"), F.lit(93600).alias("to_s")),
    )
    rows = days.select(at.alias("at"), F.explode(kinds).alias("k"))
    return rows.select(
        F.timestamp_seconds(F.col("at") + F.col("k.from_s")).alias("start"), F.timestamp_seconds(F.col("at") + F.col("k.to_s")).alias("end"),
        (F.col("at") + F.col("k.line")).alias("line_no"), F.col("k.label").alias("label"),
    )


def query_interval_join(spark, folder):
    joined = labeling.label_interval_join(flows(spark, folder), timeline(spark, folder))
    return joined.select("event_id", "label")


INTERVAL_SQL = f"""WITH {flows_sql()}, days AS (SELECT DISTINCT epoch_us(date_trunc('day', ts)) // 1000000 AS d FROM events),
  tl AS (SELECT d + 10800 AS a, d + 18000 AS b, d AS line, 'PortScan' AS lab FROM days UNION ALL SELECT d + 14400, d + 21600, d + 1, 'SSH_Patator' FROM days
    UNION ALL SELECT d + 14400, d + 93600, d + 2, 'DDoS_LOIC' FROM days)
  SELECT event_id, min_by(lab, (a, line)) AS label FROM flows JOIN tl ON us >= a * 1000000 AND us < b * 1000000 GROUP BY event_id"""


def query_preflight(spark, folder):
    return labeling.dataset_preflight(split(spark, folder))


def query_scaling(spark, folder):
    stats = labeling.scaling_stats(split(spark, folder))
    names = fv.FEATURE_NAMES
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), r6(F.col(f"mean.{n}")).alias("mean"), r6(F.col(f"std.{n}")).alias("std")) for n in names])
    return stats.select(*BY, F.explode(entries).alias("e")).select(*BY, "e.feature", "e.mean", "e.std")


def _stats_sql() -> str:
    parts = ", ".join(
        f"avg({n}) FILTER (split = 'train') AS m_{n}, CASE WHEN stddev_pop({n}) FILTER (split = 'train') < 1e-6 THEN 1.0 ELSE stddev_pop({n}) FILTER (split = 'train') END AS s_{n}"
        for n in fv.FEATURE_NAMES
    )
    return split_sql() + f", st AS (SELECT traffic_source_id, {parts} FROM sp GROUP BY ALL)"


def query_standardized(spark, folder):
    s = split(spark, folder)
    return show(labeling.standardized(s, labeling.scaling_stats(s)), fv.FEATURE_NAMES)


def query_weights(spark, folder):
    w = labeling.class_weights(split(spark, folder))
    return w.select(*BY, "windows", "positives", "negatives", r6(F.col("pos_weight")).alias("pos_weight"), r6(F.col("attack_weight")).alias("attack_weight"), r6(F.col("benign_weight")).alias("benign_weight"))


def query_violations(spark, folder):
    """Vectors with defects injected by window, so that every kind of violation occurs."""
    f = feats(spark, folder)
    hour = F.hour("window_start")
    broken = f.withColumns(
        {
            "syn_ratio": F.when(hour == 1, 1.5).otherwise(F.col("syn_ratio")),
            "packet_count": F.when(hour == 2, F.lit(float("nan"))).otherwise(F.col("packet_count").cast("double")),
            "byte_count": F.when(hour == 3, F.lit(float("inf"))).otherwise(F.col("byte_count").cast("double")),
            "unique_src_ips": F.when(hour == 4, 2.5).otherwise(F.col("unique_src_ips").cast("double")),
            "flow_count": F.when(hour == 5, 0).otherwise(F.col("flow_count")),
            "retry_rate": F.when(hour == 6, F.lit(None)).otherwise(F.col("retry_rate")),
            "delta_syn_ratio": F.when(hour == 7, -1.25).otherwise(F.col("delta_syn_ratio")),
            "feature_schema_version": F.when(hour == 8, "v0").otherwise(F.col("feature_schema_version")),
        }
    )
    judged = features.feature_violations(broken)
    return show(judged.withColumn("text", F.array_join("violations", "; ")), ["text"])


VIOLATIONS = {1: "syn_ratio: above maximum 1", 2: "packet_count: NaN or inf", 3: "byte_count: NaN or inf", 4: "unique_src_ips: must be an integer",
              5: "flow_count: must be >= 1", 6: "retry_rate: missing", 7: "delta_syn_ratio: below minimum -1", 8: "FEATURE_SCHEMA_MISMATCH"}


def query_normalized_entropy(spark, folder):
    return show(features.normalized_entropy(feats(spark, folder)), ["dst_port_entropy_norm", "src_ip_entropy_norm"])


def query_momentum(spark, folder):
    return show(features.volume_momentum(feats(spark, folder), W), ["log_packet_momentum", "byte_momentum", "burst_z_score"])


def query_acceleration(spark, folder):
    names = ["flow_rate_per_sec", "dst_port_entropy", "unique_dst_ports"]
    return show(features.acceleration(feats(spark, folder), names, W), [f"{n}_acceleration" for n in names])


def query_ema(spark, folder):
    return show(evaluation.ema_oscillator(feats(spark, folder), "packet_rate_per_sec", W), ["ema_fast", "ema_slow", "oscillator"])


QUERIES = {
    "flow_windows": query_flow_windows,
    "scoped_windows": query_scoped,
    "sliding_windows": query_sliding,
    **{name: group_query(name) for name in GROUPS},
    "window_features": query_window_features,
    "incomplete_windows": query_incomplete,
    "top_destinations": query_top,
    "host_entities": query_hosts,
    "traffic_overview": query_overview,
    "timeline_summary": query_timeline_summary,
    "latest_window": query_latest,
    "window_flow_range_join": query_window_flow_join,
    "window_feature_join": query_window_feature_join,
    "page_windows": query_page_windows,
    "history_sequences": query_history,
    "chrono_split": query_chrono,
    "embargo_split": query_embargo,
    "attack_episodes": query_episodes,
    "stage_transitions": query_transitions,
    "window_labels": query_window_labels,
    "labeled_windows": query_labeled,
    "horizon_labels": query_horizon,
    "label_interval_join": query_interval_join,
    "dataset_preflight": query_preflight,
    "scaling_stats": query_scaling,
    "standardized": query_standardized,
    "class_weights": query_weights,
    "feature_violations": query_violations,
    "normalized_entropy": query_normalized_entropy,
    "volume_momentum": query_momentum,
    "acceleration": query_acceleration,
    "ema_oscillator": query_ema,
}

KEYS = "traffic_source_id, ws AS window_start"
TOTALS = "count(DISTINCT (src_ip, dst_ip, src_port, dst_port, protocol)) AS flow_count, CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(byte_count) AS BIGINT) AS byte_count"


def fw_sql(seconds: int = W) -> str:
    return windowed_sql(seconds) + f", fw AS (SELECT traffic_source_id, ws, {TOTALS} FROM w GROUP BY ALL)"


ACCELERATED = ["flow_rate_per_sec", "dst_port_entropy", "unique_dst_ports"]

SQL = {
    "flow_windows": fw_sql(60) + f" SELECT {KEYS}, flow_count, packet_count, byte_count FROM fw",
    "scoped_windows": windowed_sql() + f" SELECT traffic_source_id, dst_ip AS scope_key, ws AS window_start, {TOTALS} FROM w GROUP BY ALL",
    "sliding_windows": f"""WITH {flows_sql()}, w AS (SELECT f.*, us // 1000000 // 10 * 10 - i * 10 AS ws FROM flows f, range(6) r(i))
      SELECT {KEYS}, {TOTALS} FROM w GROUP BY traffic_source_id, ws""",
    **{name: (feats_sql() + f" SELECT {KEYS}, {columns_sql(names)} FROM feats") for name, names in GROUPS.items()},
    "window_features": feats_sql() + f" SELECT {KEYS}, {columns_sql(fv.FEATURE_NAMES)}, 'v1' AS feature_schema_version, true AS is_complete FROM feats",
    "incomplete_windows": windowed_sql() + f""", seen AS (SELECT DISTINCT traffic_source_id, ws FROM w), span AS (SELECT traffic_source_id, min(ws) AS a, max(ws) AS b FROM seen GROUP BY ALL),
      grid AS (SELECT traffic_source_id, unnest(range(a, b + 1, {W})) AS ws FROM span)
      SELECT traffic_source_id, ws AS window_start, 'no_flows_reject' AS reason FROM grid ANTI JOIN seen USING (traffic_source_id, ws)""",
    "top_destinations": windowed_sql(86400) + TOP_SQL + f" SELECT {KEYS}, dst_ip, dst_port, protocol, flows, packets, bytes, rank FROM tops WHERE rank <= 5",
    "host_entities": windowed_sql(86400) + TOP_SQL + """ SELECT traffic_source_id, dst_ip AS ip_address, CASE WHEN dst_ip LIKE '10.%' THEN 'internal' ELSE 'external' END AS entity_type,
      ws + 86400 AS first_seen, ws + 86400 AS last_seen FROM tops WHERE rank = 1""",
    "traffic_overview": feats_sql() + f""", fw AS (SELECT traffic_source_id, ws, {TOTALS} FROM w GROUP BY ALL)
      SELECT traffic_source_id, ws + {W} AS window_end, fw.packet_count AS packets, fw.byte_count AS bytes, fw.flow_count AS flows,
      count(*) OVER (PARTITION BY traffic_source_id) AS window_count,
      CASE WHEN ws = max(ws) OVER (PARTITION BY traffic_source_id) THEN {q6('packet_rate_per_sec')} END AS latest_packet_rate FROM fw JOIN feats USING (traffic_source_id, ws)""",
    "timeline_summary": fw_sql() + """ SELECT traffic_source_id, count(*) AS windows, CAST(sum(flow_count) AS BIGINT) AS flows, max(packet_count) AS peak_packets,
      arg_max(packet_count, ws) AS latest_packets FROM (SELECT *, row_number() OVER (PARTITION BY traffic_source_id ORDER BY ws DESC) AS age FROM fw) WHERE age <= 60 GROUP BY ALL""",
    "latest_window": fw_sql() + f" SELECT {KEYS}, flow_count, packet_count, byte_count FROM fw QUALIFY ws = max(ws) OVER (PARTITION BY traffic_source_id)",
    "window_flow_range_join": windowed_sql() + """, newest AS (SELECT traffic_source_id, max(ws) AS a FROM w GROUP BY ALL)
      SELECT f.traffic_source_id, a AS window_start, event_id, byte_count FROM flows f JOIN newest n ON f.traffic_source_id = n.traffic_source_id
      AND us >= a * 1000000 AND us < (a + 3600) * 1000000""",
    "window_feature_join": feats_sql() + f""", fw AS (SELECT traffic_source_id, ws, {TOTALS} FROM w GROUP BY ALL)
      SELECT {KEYS}, fw.flow_count AS flow_count, feats.flow_count AS feature_flows, {q6('packet_burst_score')} AS burst FROM fw JOIN feats USING (traffic_source_id, ws)""",
    "page_windows": fw_sql() + f""", rest AS (SELECT *, row_number() OVER (ORDER BY ws) AS pos, count(*) OVER () AS n FROM fw WHERE traffic_source_id = 's1' AND ws > 1704844800)
      SELECT {KEYS}, flow_count, packet_count, CASE WHEN pos = 25 AND n > 25 THEN ws END AS next_cursor FROM rest WHERE pos <= 25""",
    "history_sequences": labeled_sql() + f""" SELECT {KEYS}, lag(ws, 10) OVER s AS first, lag(ws, 1) OVER s AS last,
      CAST(sum(byte_count) OVER (PARTITION BY traffic_source_id ORDER BY ws ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS BIGINT) AS history_bytes,
      byte_count, risk, stage FROM lab WINDOW s AS (PARTITION BY traffic_source_id ORDER BY ws) QUALIFY row_index >= 10""",
    "chrono_split": split_sql() + f" SELECT {KEYS}, row_index, split FROM sp",
    "embargo_split": fw_sql() + f""" SELECT {KEYS}, CASE WHEN ws + {W} + 300 <= 1705363200 THEN 'train' WHEN ws + {W} >= 1705363200 + {W} + 300 THEN 'test' ELSE 'purged' END AS split FROM fw""",
    "attack_episodes": labeled_sql() + """, att AS (SELECT *, row_index - row_number() OVER (PARTITION BY traffic_source_id ORDER BY ws) AS island FROM lab WHERE risk = 1)
      SELECT traffic_source_id, min(row_index) AS first_index, max(row_index) AS last_index, min(ws) AS first_start, max(ws) AS last_start FROM att GROUP BY traffic_source_id, island""",
    "stage_transitions": labeled_sql() + f""" SELECT {KEYS}, before AS from_stage, stage AS to_stage FROM (SELECT *, lag(stage) OVER (PARTITION BY traffic_source_id ORDER BY ws) AS before FROM lab) WHERE before <> stage""",
    "window_labels": labeled_sql() + f" SELECT {KEYS}, stage, risk, (['Benign', 'Reconnaissance', 'Initial Access', 'Lateral Movement', 'Command & Control', 'Impact'])[stage + 1] AS stage_name FROM lab",
    "labeled_windows": labeled_sql() + f" SELECT {KEYS}, {columns_sql(fv.FEATURE_NAMES)}, stage, risk FROM lab",
    "horizon_labels": windowed_sql(300) + """, ep AS (SELECT DISTINCT traffic_source_id, ws + 300 AS epoch FROM w), hit AS (SELECT e.traffic_source_id, epoch, label FROM ep e JOIN flows f
      ON e.traffic_source_id = f.traffic_source_id AND f.label <> 'BENIGN' AND f.us > epoch * 1000000 AND f.us <= (epoch + 1800) * 1000000),
      agg AS (SELECT traffic_source_id, epoch, max(CASE label WHEN 'PortScan' THEN 1 WHEN 'SSH_Patator' THEN 2 ELSE 3 END) AS sev,
      array_to_string(list_sort(list(DISTINCT label)), ',') AS classes FROM hit GROUP BY ALL)
      SELECT traffic_source_id, epoch, CAST(sev IS NOT NULL AS INTEGER) AS target_binary, coalesce(sev, 0) AS target_stage, coalesce(classes, '') AS attack_classes
      FROM ep LEFT JOIN agg USING (traffic_source_id, epoch)""",
    "label_interval_join": INTERVAL_SQL,
    "dataset_preflight": split_sql() + """, c AS (SELECT traffic_source_id, count(*) AS windows, count(*) FILTER (risk = 1) AS attack_windows, count(*) FILTER (risk = 0) AS benign_windows,
      count(*) FILTER (split = 'train') AS train_windows, count(*) FILTER (split = 'purged') AS purged_windows, count(*) FILTER (split = 'test') AS held_out_windows,
      count(DISTINCT risk) FILTER (split = 'train') AS a, count(DISTINCT risk) FILTER (split = 'test') AS b FROM sp GROUP BY ALL)
      SELECT * EXCLUDE (a, b), a = 2 AND b = 2 AS ready, CASE WHEN a < 2 THEN 'training part lacks benign or attack windows' WHEN b < 2 THEN 'held-out part lacks benign or attack windows'
      ELSE 'both parts hold benign and attack windows' END AS message FROM c""",
    "scaling_stats": _stats_sql() + " " + " UNION ALL ".join(
        f"SELECT traffic_source_id, '{n}' AS feature, {q6('m_' + n)} AS mean, {q6('s_' + n)} AS std FROM st" for n in fv.FEATURE_NAMES
    ),
    "standardized": _stats_sql() + f" SELECT {KEYS}, " + ", ".join(f"{q6(f'({n} - m_{n}) / s_{n}')} AS {n}" for n in fv.FEATURE_NAMES) + " FROM sp JOIN st USING (traffic_source_id)",
    "class_weights": split_sql() + f""", c AS (SELECT traffic_source_id, count(*) AS windows, CAST(sum(risk) AS BIGINT) AS positives FROM sp WHERE split = 'train' GROUP BY ALL)
      SELECT traffic_source_id, windows, positives, windows - positives AS negatives, {q6('greatest(CASE WHEN positives = 0 THEN 0 ELSE (windows - positives) / positives END, 1.0)')} AS pos_weight,
      {q6('CASE WHEN positives > 0 THEN windows / (2.0 * positives) END')} AS attack_weight, {q6('CASE WHEN windows > positives THEN windows / (2.0 * (windows - positives)) END')} AS benign_weight FROM c""",
    "feature_violations": fw_sql() + f" SELECT {KEYS}, CASE ws % 86400 // 3600 " + " ".join(f"WHEN {h} THEN '{t}'" for h, t in VIOLATIONS.items()) + " ELSE '' END AS text FROM fw",
    "normalized_entropy": feats_sql() + f""" SELECT {KEYS}, {q6('CASE WHEN flow_count > 1 THEN dst_port_entropy / log2(least(flow_count, 65536)) ELSE 0 END')} AS dst_port_entropy_norm,
      {q6('CASE WHEN flow_count > 1 THEN src_ip_entropy / log2(flow_count) ELSE 0 END')} AS src_ip_entropy_norm FROM feats""",
    "volume_momentum": feats_sql() + f""" SELECT {KEYS}, {q6('ln((packet_count + 1.0) / (avg(packet_count) OVER t + 1.0))')} AS log_packet_momentum,
      {q6('byte_count / (avg(byte_count) OVER t + 1.0)')} AS byte_momentum, {q6('(packet_count - avg(packet_count) OVER t) / (stddev_pop(packet_count) OVER t + 0.001)')} AS burst_z_score
      FROM feats WINDOW t AS (PARTITION BY traffic_source_id ORDER BY ws ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "acceleration": feats_sql() + f" SELECT {KEYS}, " + ", ".join(
        (f"{n} - 2 * lag({n}, 1) OVER s + lag({n}, 2) OVER s" if n in INTEGERS else q6(f"{n} - 2 * lag({n}, 1) OVER s + lag({n}, 2) OVER s")) + f" AS {n}_acceleration" for n in ACCELERATED
    ) + " FROM feats WINDOW s AS (PARTITION BY traffic_source_id ORDER BY ws)",
    "ema_oscillator": feats_sql().replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f""", n AS (SELECT traffic_source_id AS src, ws, packet_rate_per_sec AS x, row_number() OVER (PARTITION BY traffic_source_id ORDER BY ws) AS i FROM feats),
      e AS (SELECT src, ws, i, x AS f, x AS s FROM n WHERE i = 1 UNION ALL SELECT n.src, n.ws, n.i, 0.5 * n.x + 0.5 * e.f, (2.0 / 11) * n.x + (9.0 / 11) * e.s FROM e JOIN n ON n.src = e.src AND n.i = e.i + 1)
      SELECT src AS traffic_source_id, ws AS window_start, {q6('f')} AS ema_fast, {q6('s')} AS ema_slow, {q6('f - s')} AS oscillator FROM e""",
}
