import math

import pytest
from helpers import flow, flows, moment
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.operators import features, forecasts, labeling, windows


def test_windows_count_distinct_five_tuples(spark):
    df = flows(spark, flow(0, packets=4, size=300), flow(59, packets=6, size=340), flow(30, sport=2, packets=0, size=0), flow(31, sport=None, packets=0, size=0), flow(32, sport=None, packets=0, size=0))
    row = windows.flow_windows(df).first()
    assert (row.flow_count, row.packet_count, row.byte_count, row.window_end) == (3, 10, 640, moment(60))
    assert windows.flow_windows(flows(spark, flow(59), flow(60))).count() == 2
    slid = windows.sliding_windows(flows(spark, flow(65), flow(65)), "macro").collect()
    assert sorted(r.window_start.timestamp() for r in slid) == [10, 20, 30, 40, 50, 60] and {r.flow_count for r in slid} == {1}


def test_hand_computed_features(spark):
    ports = [21, 22, 22, 23, 80, 80, 80, 80]
    df = flows(spark, *[flow(i, sport=i, dport=p, packets=1 + i % 2, size=100 * (1 + i % 2)) for i, p in enumerate(ports)])
    row = features.window_features(df).first()
    assert row.dst_port_entropy == pytest.approx(1.75) and row.src_ip_entropy == 0.0
    assert (row.flow_count, row.unique_dst_ports, row.unique_src_ports, row.packet_length_std, row.packet_length_mean) == (8, 4, 8, 0.0, 100.0)
    assert row.retry_rate == pytest.approx(4 / 8) and row.inbound_outbound_ratio == 0 and row.packet_burst_score == 1.0

    mixed = flows(
        spark, flow(31, src="10.44.0.3", dst="10.44.7.1", packets=12, size=3600, duration=150, flags="SYN,ACK"),
        flow(37, src="10.44.0.9", dst="10.44.7.1", dport=8443, packets=25, size=10000, duration=420, flags="ACK", failed=True),
        flow(44, src="10.44.0.3", dst="9.9.9.9", dport=None, proto="UDP", packets=2, size=170, duration=30, failed=False),
    )
    row = features.window_features(mixed).first()
    assert (row.packet_count, row.byte_count) == (39, 13770) and row.avg_duration_ms == pytest.approx(200)
    assert row.syn_ack_ratio == pytest.approx(1 / 3) and row.failed_conn_ratio == pytest.approx(1 / 3) and row.short_flow_ratio == pytest.approx(1 / 3)
    assert row.inbound_outbound_ratio == 1.0 and row.packet_rate_per_sec == pytest.approx(39 / 60) and row.unique_dst_ports == 2
    sizes = [300, 400, 85]
    mean = sum(sizes) / 3
    assert row.packet_length_std == pytest.approx(math.sqrt(sum((s - mean) ** 2 for s in sizes) / 3))


def test_momentum_looks_back_over_non_empty_windows(spark):
    packets = [10, 20, 60, 100, 500, 7]
    df = flows(spark, *[flow(m * 60, packets=p, flags="SYN") for m, p in zip([0, 1, 2, 9, 10, 50], packets)])
    rows = features.window_features(df).orderBy("window_start").collect()
    bursts = [1.0, 20 / 11, 60 / 16, 100 / 31, 500 / 61, 7 / 221]
    assert [r.packet_burst_score for r in rows] == pytest.approx(bursts)
    assert [r.delta_packet_burst_score for r in rows] == pytest.approx([0.0, *[b - a for a, b in zip(bursts, bursts[1:])]])
    assert [r.delta_packet_rate for r in rows] == pytest.approx([0, *[(b - a) / 60 for a, b in zip(packets, packets[1:])]])
    late = features.window_features(df, min_history=3).orderBy("window_start").collect()
    assert [r.packet_burst_score for r in late][:3] == [1.0, 1.0, 1.0]


def test_no_look_ahead_and_horizon_labels(spark):
    df = flows(spark, flow(20), flow(95, label="PortScan"), flow(61), flow(120, label="DDoS_LOIC"))
    assert labeling.leakage_check(df, moment(60)).count() == 0
    epochs = spark.createDataFrame([("s", e) for e in (0, 60, 120, 300)], "traffic_source_id string, e long").select("traffic_source_id", F.timestamp_seconds("e").alias("epoch"))
    got = {r.epoch.timestamp(): (r.target_binary, r.target_stage, r.attack_classes) for r in labeling.horizon_labels(epochs, df, 60, 60).collect()}
    assert got == {0: (0, 0, []), 60: (1, 3, ["DDoS_LOIC", "PortScan"]), 120: (0, 0, []), 300: (0, 0, [])}
    split = labeling.embargo_split(windows.flow_windows(flows(spark, *[flow(m * 60) for m in range(30)])), moment(900)).orderBy("window_start").collect()
    assert [r.split for r in split] == ["train"] * 10 + ["purged"] * 10 + ["test"] * 10


# A quiet vector derived from the contract: counts of 40, ratios of one tenth, other values at one per mille of their
# range, and nothing that changes.
BENIGN = {
    name: 0.0 if name.startswith("delta_") else 1.0 if name.endswith("burst_score") else 40 if kind == "integer"
    else 0.1 if high == 1 else 1.0 for name, kind, low, high in fv.FEATURE_SPECS
}
SCENARIOS = {
    "quiet": ({}, "BENIGN", "low"),
    "scan": ({"dst_port_entropy": 7.9, "short_flow_ratio": 0.95, "syn_ack_ratio": 40.0, "delta_unique_dst_ports": 300, "rst_ratio": 0.7}, "Reconnaissance", "critical"),
    "guessing": ({"failed_conn_ratio": 0.9, "retry_rate": 0.75, "rst_ratio": 0.65, "delta_failed_conn_ratio": 0.5}, "BruteForce", "critical"),
    "flood": ({"syn_burst_score": 9.5, "packet_burst_score": 9.0, "syn_ratio": 0.99, "src_ip_entropy": 7.9, "delta_packet_rate": 4000.0}, "DDoS", "critical"),
    "first_signs": ({"dst_port_entropy": 4.6, "syn_ack_ratio": 5.2, "short_flow_ratio": 0.52}, "Reconnaissance", "medium"),
}


def vectors(spark, changes):
    kinds = ", ".join(f"{n} double" for n in fv.FEATURE_NAMES)
    rows = [(name, i, *[None if {**BENIGN, **c}[n] is None else float({**BENIGN, **c}[n]) for n in fv.FEATURE_NAMES]) for i, (name, c) in enumerate(changes.items())]
    df = spark.createDataFrame(rows, f"traffic_source_id string, i long, {kinds}")
    return df.withColumns({"window_start": F.timestamp_seconds("i"), "window_end": F.timestamp_seconds(F.col("i") + 60)})


def test_rule_scenarios(spark):
    df = vectors(spark, {k: v[0] for k, v in SCENARIOS.items()})
    explained = forecasts.rule_explanations(forecasts.rule_forecast(df)).collect()
    for r in explained:
        _, kind, level = SCENARIOS[r.traffic_source_id]
        assert (r.predicted_attack_type, r.risk_level) == (kind, level)
        assert r.alert_triggered == (r.risk_score >= 50) and r.is_uncertain == (r.confidence_score < 0.55)
        assert r.summary.startswith("Uncertain forecast. ") == r.is_uncertain and r.top_features and r.mitigation == fv.MITIGATIONS[kind]
    with pytest.raises(ValueError):
        forecasts.rule_forecast(df, horizon=90)
    medium = forecasts.rule_forecast(df, alert_threshold=20.0).filter("traffic_source_id = 'first_signs'").first()
    assert 20 <= medium.risk_score < 50 and medium.alert_triggered


def test_invalid_vectors_get_no_forecast(spark):
    changes = {"ratio": {"syn_ratio": 1.5}, "zero": {"flow_count": 0}, "nan": {"packet_count": math.nan}, "inf": {"byte_count": math.inf}, "part": {"unique_src_ips": 1.5}, "gone": {"retry_rate": None}, "fine": {}}
    df = vectors(spark, changes)
    found = {r.traffic_source_id: r.violations for r in features.feature_violations(df).collect()}
    assert found == {"ratio": ["syn_ratio: above maximum 1"], "zero": ["flow_count: must be >= 1"], "nan": ["packet_count: NaN or inf"], "inf": ["byte_count: NaN or inf"],
                     "part": ["unique_src_ips: must be an integer"], "gone": ["retry_rate: missing"], "fine": []}
    assert [r.traffic_source_id for r in forecasts.forecast_policy(df).collect()] == ["fine"]
    sources = df.select("traffic_source_id").unionByName(spark.createDataFrame([("empty",)], "traffic_source_id string"))
    rejected = {r.traffic_source_id: r.error_code for r in forecasts.rejected_forecasts(sources, df).collect()}
    assert rejected.pop("empty") == "NOT_ENOUGH_WINDOWS" and set(rejected.values()) == {"INVALID_FEATURES"} and len(rejected) == 6
    missing = features.feature_violations(df.filter("traffic_source_id = 'fine'").drop("packet_burst_score").withColumn("unique_dst_ports", F.lit("12"))).first()
    assert missing.violations == ["unique_dst_ports: not numeric", "packet_burst_score: missing"]
    unknown = features.feature_violations(df.filter("traffic_source_id = 'fine'").withColumn("extra_rate", F.lit(1.0)), given=[*fv.FEATURE_NAMES, "extra_rate"]).first()
    assert unknown.violations == ["extra_rate: unexpected"]
