import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions import addresses, dataset, labels, rows, sensor
from flowcast.operators import normalize


def apply(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def rule(spark, values, make):
    outcome = lambda t: F.struct(make(rows.stripped(t)).value.alias("value"), make(rows.stripped(t)).invalid.alias("invalid"))
    return [(r.value, r.invalid) for r in apply(spark, values, outcome)]


def test_addresses_agree_with_the_standard_library(spark):
    random.seed(5)
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "::1", "2001:DB8::0:1", "fe80::1%eth0", "fe80::1%", "1:2:3:4:5:6:7:8", "::", "1::2::3", ":::", "::ffff:1.2.3.4",
             "64:ff9b:1::1", "2001:0:0:1:0:0:0:1", "abc", "", "1:2:3:4:5:6:7::", "192.0.0.9", "172.32.0.1", "fd00::", "2001:20::1", "::1.2.3.4", "100::1", "240.0.0.1",
             "::ffff:8.8.8.8", "12345::", "::g", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8:9", "1.2.3", "1.2.3.4.5", " 1.2.3.4"]
    for _ in range(150):
        texts.append(str(ipaddress.IPv4Address(random.getrandbits(32))))
        groups = [random.choice(["0", "0", f"{random.getrandbits(16):X}", "00ab"]) for _ in range(8)]
        texts.append(":".join(groups))
        texts.append(str(ipaddress.IPv6Address(random.getrandbits(128) >> random.choice([0, 64, 96]))))
    for network in (*fv.PRIVATE_V4, *fv.PRIVATE_V6, *fv.PUBLIC_V4, *fv.PUBLIC_V6):
        net = ipaddress.ip_network(network)
        for number in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= number < 2**net.max_prefixlen:
                texts.append(str(type(net[0])(number)))
    got = apply(spark, texts, lambda t: F.struct(addresses.canonical_ip(t).alias("c"), addresses.is_private_ip(t).alias("p")))
    for text, row in zip(texts, got):
        try:
            want = ipaddress.ip_address(text)
            assert (row.c, row.p) == (str(want), want.is_private), text
        except ValueError:
            assert (row.c, row.p) == (None, None), text


def test_times_need_a_zone_or_are_epoch_seconds(spark):
    texts = ["2026-08-28T18:00:00.000Z", "1760000000", "1726000000.5", "2026-08-28T18:00:00", "2026-08-28 18:00:00+05:30", "20260828T180000Z", "2026-08-28T18:00+0200", "bad", "2026-13-01T00:00:00Z", "99999999999999", ""]
    got = rule(spark, texts, rows.event_time)
    shown = [str(v) if v else None for v, _ in got]
    assert shown == ["2026-08-28 18:00:00", "2025-10-09 08:53:20", "2024-09-10 20:26:40.500000", None, "2026-08-28 12:30:00", "2026-08-28 18:00:00", "2026-08-28 16:00:00", None, None, None, None]
    assert [bad for _, bad in got] == [v is None for v in shown]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (rows.duration, {"1250.5": (1250, False), "1251.5": (1252, False), "": (None, False), None: (None, False), "-0.4": (0, False), "-0.6": (None, True), "nan": (None, True), "inf": (None, True), "1d": (None, True), "x": (None, True)}),
        (rows.port, {"80": (80, False), "65535": (65535, False), "65536": (None, True), "-1": (None, True), "": (None, False), "80.0": (None, True)}),
        (rows.count, {"18": (18, False), "0": (0, False), "18.0": (None, True), "-1": (None, True), "": (None, True), "1_0": (None, True)}),
        (rows.flags, {"psh,ack": ("PSH,ACK", False), "NONE": (None, False), "": (None, False), "INVALID_FLAG": (None, True), "SYN, syn": ("SYN", False), ",": (None, True), "SYN,BOGUS": (None, True)}),
        (rows.failed_connection, {"ZERO_WIN": (True, False), "SYN_NO_ACK": (True, False), "RST_ABORT": (True, False), "CLEAN": (False, False), "NA": (None, False), None: (None, False), "CORRUPT": (None, True), "S0": (None, True)}),
        (rows.protocol, {"tcp": ("TCP", False), "17": ("UDP", False), "1": ("ICMP", False), "SCTP": ("OTHER", False), "": (None, True)}),
    ],
)
def test_row_rules(spark, make, cases):
    assert rule(spark, list(cases), make) == list(cases.values())


def test_bad_rows_are_skipped_and_kept_in_quarantine(spark):
    columns = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "duration_ms", "flags", "failed_conn_info", "label"]
    good = ("2025-03-04T05:06:07.089Z", "198.51.100.30", "203.0.113.31", "50505", "993", "TCP", "21", "6543", "1250.5", "FIN", "CLEAN", "BENIGN")
    bad = ("bad-time", "not-an-ip", *good[2:])
    bogus = (*good[:9], "BOGUS", *good[10:])
    raw = spark.createDataFrame([good, bad, bogus], columns)
    kept = normalize.normalize_flows(raw).collect()
    assert len(kept) == 1 and kept[0].duration_ms == 1250 and kept[0].extra == {"label": "BENIGN"}
    refused = normalize.quarantine_flows(raw).select("timestamp", "problems").collect()
    assert [r.problems for r in refused] == [["timestamp", "src_ip"], ["flags"]] and refused[0].timestamp == "bad-time"
    counts = normalize.load_counts(normalize.parse_flows(raw)).first()
    assert (counts.total_rows, counts.accepted_rows, counts.skipped_rows) == (3, 1, 2)


def test_contract_violations(spark):
    columns = list(fv.LABELED_FLOW_COLUMNS)
    good = dict(zip(columns, ("2026-08-28T18:00:00Z", "10.0.0.1", "8.8.8.8", "1", "2", "TCP", "1", "0", "0.5", "SYN,ACK", "CLEAN", "BENIGN")))
    mutations = [{}, {"dst_port": "70001"}, {"src_port": "-7"}, {"src_ip": "10.0.0.256"}, {"packets": "-3"}, {"bytes": "-1"}, {"duration_ms": "-2.25"}, {"protocol": "GRE"}, {"flags": "SYN+ACK"}, {"failed_conn_info": "HALF_OPEN"}, {"label": "Worm"}, {"timestamp": "28/08/2026 18:00"}]
    rows_ = [tuple({**good, **m}[c] for c in columns) + (i,) for i, m in enumerate(mutations)]
    df = spark.createDataFrame(rows_, columns + ["i"])
    found = {r.i: r.violations for r in normalize.flow_contract_violations(df, ["i"]).collect()}
    assert found == {i: list(m) for i, m in enumerate(mutations) if m}


def test_labels_cover_every_spelling_and_stage(spark):
    spellings = list(fv.LABEL_SPELLINGS)
    assert apply(spark, spellings, labels.timeline_label) == [fv.LABEL_SPELLINGS[s] for s in spellings]
    assert apply(spark, ["Web Attack \x96 XSS", "Bot - Attempted", "no such", None], labels.dataset_label) == ["Web_XSS", "Botnet", "BENIGN", "BENIGN"]
    attack = list(fv.LABEL_FAMILIES)
    assert apply(spark, attack, labels.label_stage) == [fv.FAMILY_STAGES[fv.LABEL_FAMILIES[a]] for a in attack]
    sizes = apply(spark, list(fv.STAGES), lambda t: F.size(labels.stage_candidates(t)))
    assert sizes == [0, 1, 10, 1, 1, 6]
    assert {row[0] for row in fv.ATTACK_REFERENCE} == set(fv.LABEL_FAMILIES)


def test_dataset_rules(spark):
    assert dataset.unique_headers(["Flow ID", " Source IP", " Fwd Header Length", " Fwd Header Length.1", "﻿A\xa0 b"]) == ["Flow ID", "Source IP", "Fwd Header Length", "Fwd Header Length.1", "A b"]
    assert apply(spark, ["Infinity", "-inf", "NaN", None, " 1.5 ", "x", "1e3"], dataset.clean_numeric) == [0, 0, 0, 0, 1.5, 0, 1000]
    times = ["14/02/2018 10:00:00", "3/7/2017 8:55", "07/04/2017 08:55:01 PM", "12/31/2017 1:00", "2017-07-07 08:30:00.5", "soon", "2017-07-07T08:30:00+02:00"]
    shown = [str(v) if v else None for v in apply(spark, times, dataset.flexible_time)]
    assert shown == ["2018-02-14 10:00:00", "2017-07-03 08:55:00", "2017-04-07 20:55:01", "2017-12-31 01:00:00", "2017-07-07 08:30:00", None, "2017-07-07 06:30:00"]
    assert apply(spark, ["ShADadFf", "d", None], sensor.history_flags) == ["SYN,ACK,FIN", None, None]
    assert apply(spark, ["S0", "rsto", "REJ", "SF", None], sensor.connection_state) == ["SYN_NO_ACK", "RST_ABORT", "RST_ABORT", "CLEAN", "CLEAN"]
