import datetime
import gzip
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from checks import runs
from flowcast.operators import labeling
from flowcast.operators.normalize import normalize_flows
from flowcast.plans import pipeline
from flowcast.session import Staging, shared_folder
from flowcast.sources import flow_files, tables

NOW = datetime.datetime(2026, 9, 1)
HEADER = "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,packets,bytes,duration_ms,flags,failed_conn_info,label\n"


def csv(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_flow_csv_with_alias_headers_and_quotes(spark, tmp_path):
    text = "﻿TCP Flags,byte_count,label,packet_count,Destination IP,duration,time,proto,Source Port,Source IP,Destination Port\n"
    text += '"FIN, PSH",7731,Bot,9,203.0.113.77,431,1711111111,6,40404,198.51.100.4,8443\n'
    row = flow_files.read_flow_csv(spark, csv(tmp_path, text), "x").first()
    assert row.problems == [] and row.protocol == "TCP" and row.tcp_flags == "FIN,PSH" and (row.src_ip, row.dst_ip) == ("198.51.100.4", "203.0.113.77")
    assert (row.packet_count, row.byte_count, row.duration_ms, row.extra) == (9, 7731, 431, {"label": "Bot"})


def test_each_file_is_read_under_its_own_header(spark, tmp_path):
    one = csv(tmp_path, "time,dst_ip,src_ip,proto,packets,bytes,note\n1711111111,203.0.113.1,198.51.100.1,udp,1,10,a\n", "one.csv")
    two = csv(tmp_path, "src_ip,dst_ip,time,proto,bytes,packets\n198.51.100.2,203.0.113.2,1711111112,udp,20,2\n198.51.100.3,203.0.113.3,1711111113,udp,30,3\n", "two.csv")
    rows = flow_files.read_flow_csv(spark, [one, two]).orderBy("packet_count").collect()
    assert [(r.src_ip, r.dst_ip, r.packet_count, r.byte_count) for r in rows] == [(f"198.51.100.{i}", f"203.0.113.{i}", i, 10 * i) for i in (1, 2, 3)]
    assert [r.extra for r in rows] == [{"note": "a"}, {}, {}]
    head = "Source IP,Destination IP,Timestamp,Total Fwd Packets,Label\n"
    full = csv(tmp_path, head + "198.51.100.7,203.0.113.7,03/07/2017 10:00:00,4,BENIGN\n", "year.csv")
    short = csv(tmp_path, "Label,Src IP,Dst IP,Tot Fwd Pkts,Timestamp\nBot,198.51.100.8,203.0.113.8,5,10:00.5\n", "short.csv")
    both = flow_files.read_cicids_csv(spark, [full, short]).orderBy("packets").collect()
    assert [(r.src_ip, r.dst_ip, r.packets, r.label, r.timestamp) for r in both] == [
        ("198.51.100.7", "203.0.113.7", 4, "BENIGN", "2017-07-03T10:00:00Z"), ("198.51.100.8", "203.0.113.8", 5, "Botnet", "2017-07-03T00:00:00Z")]


def test_flow_csv_header_errors():
    with pytest.raises(flow_files.FlowFileError, match="src_ip"):
        flow_files.flow_headers(["timestamp", "dst_ip", "protocol", "packets", "bytes"])
    with pytest.raises(flow_files.FlowFileError, match="more than one column stands for timestamp"):
        flow_files.flow_headers(["timestamp", "time", "src_ip", "dst_ip", "protocol", "packets", "bytes"])


def test_headers_are_found_without_reading_the_data(spark, tmp_path):
    for i in range(3):
        csv(tmp_path, "\n  \na,b\n1,2\n" if i else "b,a\n1,2\n", f"f {i}.csv")
    csv(tmp_path, "", "empty.csv")
    with gzip.open(tmp_path / "packed.csv.gz", "wt", encoding="utf-8") as out:
        out.write("a,b\n5,6\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        groups = flow_files.files_by_header(spark, str(tmp_path))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [[os.path.basename(f) for f in group] for group in groups] == [["f 0.csv"], ["f 1.csv", "f 2.csv", "packed.csv.gz"]]
    assert list(jobs) == []
    assert spark.read.option("header", True).csv(groups[1]).count() == 3


def test_ordered_readers_stage_few_columns_and_clean_up(spark, tmp_path):
    wide = [f"Extra {i}" for i in range(40)]
    csv(tmp_path, ",".join(["Timestamp", "Source Port", "Label", *wide]) + "\n" + "".join(",".join(["05:00.1", str(i), "BENIGN", *["x"] * 40]) + "\n" for i in range(60)), "day.csv")
    with Staging(spark) as stage:
        rows = flow_files.read_cicids_csv(spark, str(tmp_path / "day.csv"), stage)
        days = flow_files.read_archive_days(spark, str(tmp_path), 4, ["day.csv"], stage)
        assert sorted((r.src_port, r.timestamp[-3:]) for r in rows.collect()) == [(i, f"{i * 20 // 1000:02d}Z") for i in range(60)]
        assert sorted(r.src_port for r in days.collect()) == list(range(0, 60, 4))
        assert rows.columns == days.columns[:-1]
        stored = [spark.read.parquet(f"{stage.root}/{i + 1}") for i in range(stage.tables)]
        assert max(len(t.columns) for t in stored) < 20
        assert all("Scan csv" not in df._jdf.queryExecution().toString() for df in (rows, days))  # the files are read once, by the staging
    assert not os.path.exists(stage.root.removeprefix("file://"))
    assert stage.root.startswith(shared_folder(spark))
    csv(tmp_path, "", "none.csv")
    with pytest.raises(flow_files.FlowFileError, match="no header line"):
        flow_files.read_archive_days(spark, str(tmp_path), 4, ["none.csv"])


def test_dataset_short_headers_and_defaults(spark, tmp_path):
    text = "Label,TotLen Bwd Pkts,TotLen Fwd Pkts,Tot Bwd Pkts,Tot Fwd Pkts,Flow Duration,Timestamp,Protocol,Dst Port,Src Port,Dst IP,Src IP\n"
    text += "SSH-Bruteforce,77,1200,1,11,2500000,22/11/2019 07:08:09,6,22,61001,203.0.113.9,198.51.100.9\n"
    row = flow_files.read_cicids_csv(spark, csv(tmp_path, text)).first()
    assert (row.src_ip, row.packets, row.bytes, row.duration_ms, row.label) == ("198.51.100.9", 12, 1277, 2500.0, "SSH_Patator")
    assert row.timestamp == "2019-11-22T07:08:09Z" and row.flags == "NONE" and row.failed_conn_info == "CLEAN"
    bare = flow_files.read_cicids_csv(spark, csv(tmp_path, "Src IP dec,Dst IP dec,Timestamp\n3232235777,junk,12:30.5\n3232235778,-1,12:31.0\n", "b.csv")).orderBy("src_ip").collect()
    assert [(r.src_ip, r.dst_ip, r.timestamp, r.protocol, r.label, r.packets) for r in bare] == [
        ("192.168.1.1", "172.16.0.1", "2017-07-03T00:00:00Z", "TCP", "BENIGN", 1), ("192.168.1.2", "172.16.0.1", "2017-07-03T00:00:00Z", "TCP", "BENIGN", 1)]


def test_archive_days_keep_every_nth_row_in_file_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name, n in (("monday.csv", 1000), ("tuesday.csv", 7)):
            csv(tmp_path, "Source Port,Label\n" + "".join(f"{i},BENIGN\n" for i in range(n)), name)
        df = flow_files.read_archive_days(spark, str(tmp_path), 4, ["monday.csv", "tuesday.csv"])
        rows = sorted((r.day, r.src_port, r.timestamp) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[1] for r in rows if r[0] == 0] == list(range(0, 1000, 4)) and [r[1] for r in rows if r[0] == 1] == [0, 4]
    assert rows[13][2] == "2017-07-03T00:00:01Z" and rows[-1][2] == "2017-07-04T00:00:00Z"


def test_file_order_holds_when_a_later_scan_is_split_otherwise(spark, tmp_path):
    csv(tmp_path, "Source Port,Label\n" + "".join(f"{i},BENIGN\n" for i in range(1000)), "monday.csv")
    ordered = flow_files.with_file_order(flow_files.read_in_order(spark, str(tmp_path / "monday.csv")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = ordered.select("row_index", "Source Port").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r[0], int(r[1])) for r in rows) == [(i, i) for i in range(1000)]


def test_an_archive_day_of_several_files_has_one_order(spark, tmp_path):
    (tmp_path / "day").mkdir()
    for part in range(2):
        csv(tmp_path / "day", "Source Port,Label\n" + "".join(f"{part * 10 + i},BENIGN\n" for i in range(10)), f"part-{part}.csv")
    df = flow_files.read_archive_days(spark, str(tmp_path), 4, ["day"])
    assert [r.src_port for r in df.orderBy("timestamp", "src_port").collect()] == [0, 4, 8, 12, 16]


RECORD = {"ts": 1733000000.25, "id.orig_h": "198.51.100.21", "id.resp_h": "203.0.113.22", "id.orig_p": 33001, "id.resp_p": 123, "proto": "udp", "orig_pkts": 4, "resp_pkts": 3,
          "orig_bytes": 304, "resp_bytes": 228, "duration": 1.5, "history": "d", "conn_state": "SF"}


def test_sensor_log(spark, tmp_path):
    lines = [json.dumps(RECORD), "not json", "[1, 2]", json.dumps({"ts": 1, "id.orig_h": "10.0.0.1"}), json.dumps({**RECORD, "orig_bytes": "-", "duration": "-", "id.orig_p": "-", "history": "ShADF", "conn_state": "REJ"})]
    raw = flow_files.read_zeek_json(spark, csv(tmp_path, "\n".join(lines), "conn.log"))
    first, second = sorted(raw.collect(), key=lambda r: int(r.bytes), reverse=True)
    assert first.asDict() == {"uid": None, "timestamp": "2024-11-30T20:53:20.250000Z", "src_ip": "198.51.100.21", "dst_ip": "203.0.113.22", "src_port": "33001", "dst_port": "123", "protocol": "UDP",
                              "packets": "7", "bytes": "532", "duration_ms": "1500", "flags": None, "failed_conn_info": "CLEAN"}
    assert (second.bytes, second.duration_ms, second.src_port, second.flags, second.failed_conn_info) == ("228", None, None, "SYN,ACK,FIN", "RST_ABORT")
    assert normalize_flows(raw).count() == 2


def test_a_written_log_has_more_files_the_more_records_it_holds(spark, tmp_path, monkeypatch):
    rows = [(i if i % 9 else None, datetime.datetime(2024, 1, 1, 0, i), i, "click", '{"k": 3}', 12.5) for i in range(35)]
    events = spark.createDataFrame([*rows, rows[1]], "event_id long, ts timestamp, user_id long, event_type string, props string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(runs, "LOG_ROWS", 10, raising=False)
    per_file = spark.read.text(runs._written_log(spark, str(tmp_path))).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > 1 and sum(n for _, n in per_file) == 36
    assert runs.query_read_zeek(spark, str(tmp_path)).count() == 36


def test_timeline_labels_flows_and_first_interval_wins(spark, tmp_path):
    path = csv(tmp_path, "start,end,label\n2023-11-14T22:13:00Z,2023-11-14T22:14:00Z,SSH-Patator\n2023-11-14T22:13:10Z,2023-11-14T22:13:30Z,Bot\n2023-11-14T22:13:00Z,2023-11-14T22:20:00Z,ddos\n")
    timeline = flow_files.read_label_timeline(spark, path)
    times = [1700000000, 1700000020, 1700000039.999999, 1700000040, 1700000399, 1700000400, 1699999000]
    flows = spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "i int, t double").select(
        "i", F.timestamp_micros((F.col("t") * 1000000).cast("long")).alias("observed_at"), F.lit("10.0.0.1").alias("src_ip"), F.lit(1).alias("src_port"))
    want = {0: "SSH_Patator", 1: "SSH_Patator", 2: "SSH_Patator", 3: "DDoS_LOIC", 4: "DDoS_LOIC"}
    assert {r.i: r.label for r in labeling.label_interval_join(flows, timeline).collect()} == want
    filled = labeling.label_interval_join(flows, timeline, benign_fill=True)
    assert {r.i: r.label for r in filled.collect()} == {**want, 5: "BENIGN", 6: "BENIGN"}
    counts = labeling.coverage_counts(flows, labeling.label_interval_join(flows, timeline)).first()
    assert (counts.accepted, counts.uncovered) == (5, 2)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("start,end,label\n2023-11-14T22:13:00Z,2023-11-14T22:14:00Z,definitely-an-attack\n", "Unsupported label"),
        ("start,end,label\n2023-11-14T22:13:00,2023-11-14T22:14:00Z,Bot\n", "timezone"),
        ("start,end,label\n2023-11-14T22:14:00Z,2023-11-14T22:14:00Z,Bot\n", "end after"),
        ("start,end,label\n", "empty"),
        ("start,end,tag\n2023-11-14T22:14:00Z,2023-11-14T22:14:00Z,Bot\n", "exactly"),
    ],
)
def test_timeline_errors(spark, tmp_path, text, message):
    with pytest.raises(flow_files.FlowFileError, match=message):
        flow_files.read_label_timeline(spark, csv(tmp_path, text))


def test_repeated_load_is_skipped_and_tables_are_rewritten_by_key(spark, tmp_path):
    good = "2025-03-04T05:06:07.089Z,198.51.100.30,203.0.113.31,50505,993,TCP,21,6543,87.5,ACK,CLEAN,BENIGN\n"
    raw = flow_files.read_raw_flows(spark, csv(tmp_path, HEADER + good + good + "bad" + good))
    again = flow_files.read_raw_flows(spark, csv(tmp_path, HEADER + "bad" + good + good + good, "again.csv"))
    where = (str(tmp_path / "flows"), str(tmp_path / "loads"), NOW)
    first, second = tables.load_flows(raw, "a", *where), tables.load_flows(again, "a", *where)
    assert (first["total_rows"], first["accepted_rows"], first["skipped_rows"], first["duplicate"]) == (3, 2, 1, False)
    assert second["duplicate"] and second["load_id"] == first["load_id"]
    assert not tables.load_flows(raw, "b", *where)["duplicate"]
    assert spark.read.parquet(where[0]).count() == 4
    ports = lambda a, b: raw.limit(1).withColumns({"src_port": F.lit(a), "dst_port": F.lit(b)})
    loads = [tables.load_flows(ports(*p), "c", *where)["duplicate"] for p in (("80", None), (None, "80"))]
    assert loads == [False, False]  # the same cells under another column are another load

    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "p string, k int, v int")
    tables.upsert_table(make([("x", 1, 1), ("x", 2, 1), ("y", 1, 1)]), path, ["p", "k"], ["p"])
    for _ in range(2):
        tables.upsert_table(make([("x", 2, 5), ("z", 9, 5)]), path, ["p", "k"], ["p"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("p", "k", "v").collect()) == [("x", 1, 1), ("x", 2, 5), ("y", 1, 1), ("z", 9, 5)]


def test_loads_and_models_of_several_callers_at_once_are_kept_once(spark, tmp_path):
    good = "2025-03-04T05:06:07.089Z,198.51.100.30,203.0.113.31,50505,993,TCP,21,6543,87.5,ACK,CLEAN,BENIGN\n"
    path = csv(tmp_path, HEADER + good + "bad" + good + good.replace("-04T", "-05T"))
    where = (str(tmp_path / "flows"), str(tmp_path / "loads"), NOW)
    with ThreadPoolExecutor(4) as pool:
        loads = list(pool.map(lambda _: tables.load_flows(flow_files.read_raw_flows(spark, path), "a/b", *where), range(4)))
    assert sorted(load["duplicate"] for load in loads) == [False, True, True, True]
    assert len({load["load_id"] for load in loads}) == 1 and all(load["total_rows"] == 3 for load in loads)
    assert sorted(str(r.flow_date) for r in spark.read.parquet(where[0]).collect()) == ["2025-03-04", "2025-03-05"]
    assert spark.read.parquet(where[1]).count() == 1 and os.listdir(tmp_path / "flows" / "_incoming") == []
    with ThreadPoolExecutor(4) as pool:
        new = list(pool.map(lambda i: tables.register_model(spark, str(tmp_path / "models"), "m", "1", "s", str(i), NOW), range(4)))
    assert sorted(new) == [False, False, False, True] and tables.register_model(spark, str(tmp_path / "models"), "m", "2", "s", "", NOW)
    assert sorted(r.version for r in spark.read.parquet(str(tmp_path / "models")).collect()) == ["1", "2"]


def test_a_load_left_behind_is_taken_over_and_an_empty_one_is_recorded(spark, tmp_path):
    good = "2025-03-04T05:06:07.089Z,198.51.100.30,203.0.113.31,50505,993,TCP,21,6543,87.5,ACK,CLEAN,BENIGN\n"
    raw = flow_files.read_raw_flows(spark, csv(tmp_path, HEADER + good))
    where = (str(tmp_path / "flows"), str(tmp_path / "loads"), NOW)

    def fails():
        raise RuntimeError("no room")

    load_id = tables.load_flows(raw, "a", str(tmp_path / "f"), str(tmp_path / "l"), NOW)["load_id"]
    for _ in range(2):  # a failure gives its claim back
        with pytest.raises(RuntimeError):
            tables.put_once(spark, where[1], load_id, fails)
    claims = tmp_path / "loads" / "_claims" / next((tmp_path / "loads" / "_claims").iterdir()).name
    (claims / "0").touch()  # a maker that died after it moved a part of the rows
    (tmp_path / "flows" / "traffic_source_id=a" / f"load_id={load_id}" / "flow_date=2025-03-04").mkdir(parents=True)
    load = tables.load_flows(raw, "a", *where, lease=0.1)
    assert not load["duplicate"] and load["load_id"] == load_id and spark.read.parquet(where[0]).count() == 1
    none = [tables.load_flows(raw.limit(0), "a", *where) for _ in range(2)]
    assert [(n["duplicate"], n["total_rows"]) for n in none] == [(False, 0), (True, 0)]


def test_written_labelled_flows_come_back(spark, tmp_path):
    good = "2025-03-04T05:06:07.089Z,198.51.100.30,203.0.113.31,50505,993,TCP,21,6543,87.5,\"SYN,ACK\",CLEAN,BENIGN\n"
    parsed = flow_files.read_flow_csv(spark, csv(tmp_path, HEADER + good)).withColumn("label", F.col("extra")["label"])
    out = str(tmp_path / "out")
    flow_files.write_labeled_flows(flow_files.labeled_columns(parsed), out)
    row = flow_files.read_flow_csv(spark, out).first()
    assert row.problems == [] and row.tcp_flags == "SYN,ACK" and row.extra == {"label": "BENIGN"} and row.failed_connection is False
    with pytest.raises(flow_files.FlowFileError):
        flow_files.write_labeled_flows(flow_files.labeled_columns(parsed.filter("false")), out + "2")


def test_a_labelled_capture_keeps_the_connection_state(spark, tmp_path):
    records = [{**RECORD, "proto": "tcp", "conn_state": state, "ts": 1733000000 + i} for i, state in enumerate(("REJ", "S0", "SF"))]
    log = csv(tmp_path, "\n".join(json.dumps(r) for r in records), "conn.log")
    intervals = csv(tmp_path, "start,end,label\n2024-11-30T20:53:20Z,2024-11-30T20:53:22Z,Bot\n", "intervals.csv")
    assert pipeline.label_capture(spark, log, intervals, str(tmp_path / "a")) == {"accepted": 2, "uncovered": 1}
    assert pipeline.label_capture(spark, log, intervals, str(tmp_path / "b"), True) == {"accepted": 3, "uncovered": 0}
    rows = spark.read.option("header", True).csv(str(tmp_path / "b")).orderBy("timestamp").collect()
    assert [(r.failed_conn_info, r.label) for r in rows] == [("RST_ABORT", "Botnet"), ("SYN_NO_ACK", "Botnet"), ("CLEAN", "BENIGN")]
