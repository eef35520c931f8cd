"""Queries without a plain SQL counterpart: file readers, fitted models and streams.

Each one derives its input from the whole given table, goes through the real reader, fit or stream,
and returns the result.  Files go to a fresh folder per run.
"""

from __future__ import annotations

import datetime
import os

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.rules import EV, PARSED_CTE, upload
from checks.testbed import events, flows, flows_sql, q6, r6
from checks.windows import BY, W, feats, labeled, query_window_features, show, split
from flowcast import fixed_values as fv
from flowcast.functions import dataset
from flowcast.operators import labeling, models
from flowcast.session import cut_lineage, shared_folder
from flowcast.sources import flow_files, tables
from flowcast.streaming import live

NOW = datetime.datetime(2024, 2, 1, tzinfo=datetime.timezone.utc)


def folder_for(spark) -> str:
    """Fresh folder in the one that driver and executors share."""
    return f"{shared_folder(spark)}/flowcast-{os.urandom(8).hex()}"


def r3(column):
    return F.round(column.cast("double"), 3) + F.lit(0.0)


def query_flexible_time(spark, sf):
    kind = F.col("event_id") % 6
    patterns = ["dd/MM/yyyy HH:mm:ss", "d/M/yyyy h:mm a", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy HH:mm"]
    text = F.lit("soon")
    for i, pattern in enumerate(patterns):
        text = F.when(kind == i, F.date_format("ts", pattern)).otherwise(text)
    return events(spark, sf).select("event_id", F.unix_seconds(dataset.flexible_time(text)).alias("seconds"))


def query_replay_timeline(spark, sf):
    made = flow_files.replay_timeline(F.col("event_id"), fv.REPLAY_BASE, 20)
    return events(spark, sf).select("event_id", F.unix_seconds(made).alias("seconds"))


def _written_csv(spark, sf) -> list[str]:
    """The upload in two folders: odd events under other names of the columns, in another order."""
    root, rows = folder_for(spark), upload(spark, sf)
    other = {"timestamp": "Time", "src_ip": "Source IP", "dst_ip": "Destination IP", "packets": "packet_count", "bytes": "byte_count"}
    halves = [rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1").withColumnsRenamed(other)]
    halves[1] = halves[1].select(*reversed(halves[1].columns))
    for i, half in enumerate(halves):
        half.write.option("header", True).option("escape", '"').csv(f"{root}/upload-{i}")
    return [f"{root}/upload-{i}" for i in range(2)]


PARSED_SHOWN = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count", "byte_count", "duration_ms", "tcp_flags", "failed_connection")


def query_read_flow_csv(spark, sf):
    """Every row by event: its values, or the columns at fault."""
    parsed = flow_files.read_flow_csv(spark, _written_csv(spark, sf), "upload")
    good = F.size("problems") == 0
    shown = {"observed_us": F.unix_micros("observed_at"), **{c: F.col(c) for c in PARSED_SHOWN}, "label": F.try_element_at("extra", F.lit("label"))}
    return parsed.select(
        F.try_element_at("extra", F.lit("event_id")).cast("bigint").alias("event_id"), F.array_join("problems", ",").alias("problems"),
        "traffic_source_id", *[F.when(good, c).alias(n) for n, c in shown.items()])


_PARSED_SQL = {"src_port": "sp", "dst_port": "dp", "label": "nullif(label, '')"}
READ_SQL = PARSED_CTE + " SELECT event_id, problems, 'upload' AS traffic_source_id, " + ", ".join(
    f"CASE WHEN problems = '' THEN {_PARSED_SQL.get(c, c)} END AS {c}" for c in ("observed_us", *PARSED_SHOWN, "label")) + " FROM judged"


def _wide(spark, sf, short: bool = False):
    """The flows with the headers of the first dataset year; ``short`` times are ``mm:ss`` only."""
    f = flows(spark, sf)
    stamp = F.date_format("observed_at", "mm:ss.S" if short else "dd/MM/yyyy HH:mm:ss")
    has = lambda flag: (F.find_in_set(F.lit(flag), "tcp_flags") > 0).cast("int")
    return f.select(
        "event_id",
        F.col("src_ip").alias(" Source IP"), F.col("src_port").alias(" Source Port"), F.col("dst_ip").alias(" Destination IP"),
        F.col("dst_port").alias(" Destination Port"), F.when(F.col("protocol") == "UDP", 17).when(F.col("protocol") == "ICMP", 1).otherwise(6).alias(" Protocol"),
        stamp.alias(" Timestamp"), (F.col("duration_ms") * 1000).alias(" Flow Duration"), F.col("packet_count").alias(" Total Fwd Packets"),
        F.lit(0).alias(" Total Backward Packets"), F.col("byte_count").alias("Total Length of Fwd Packets"), F.lit(0).alias(" Total Length of Bwd Packets"),
        has("SYN").alias(" SYN Flag Count"), has("ACK").alias(" ACK Flag Count"), has("FIN").alias("FIN Flag Count"), has("RST").alias(" RST Flag Count"),
        F.col("label").alias(" Label"),
    )


def query_read_cicids(spark, sf):
    """Every row of a dataset whose even events lie in files with long headers, odd ones in files with short headers."""
    root, wide = folder_for(spark), _wide(spark, sf)
    short = {long: name for name, long in fv.DATASET_ALIASES.items()}
    odd = wide.filter("event_id % 2 = 1").drop("event_id")
    odd = odd.toDF(*[short.get(c.strip(), c.strip()) for c in odd.columns])
    for name, half in (("long", wide.filter("event_id % 2 = 0").drop("event_id")), ("short", odd)):
        half.write.option("header", True).csv(f"{root}/{name}")
    return flow_files.read_cicids_csv(spark, [f"{root}/long", f"{root}/short"])


_DATASET_COLUMNS = """src_ip, dst_ip, src_port, dst_port, protocol, packet_count AS packets, byte_count AS bytes, CAST(duration_ms AS DOUBLE) AS duration_ms,
  CASE tcp_flags WHEN 'PSH,ACK' THEN 'ACK' ELSE tcp_flags END AS flags,
  CASE WHEN protocol <> 'TCP' THEN 'NA' WHEN contains(tcp_flags, 'RST') THEN 'RST_ABORT' WHEN tcp_flags = 'SYN' THEN 'SYN_NO_ACK' ELSE 'CLEAN' END AS failed_conn_info, label, false AS unknown_label"""
DATASET_SQL = f"""WITH {flows_sql()} SELECT strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, {_DATASET_COLUMNS} FROM flows"""


def query_archive(spark, sf):
    """Two archive days of several files in the order of events: the whole table each, every fourth row kept."""
    root = folder_for(spark)
    _wide(spark, sf, short=True).orderBy("event_id").drop("event_id").write.option("header", True).csv(f"{root}/day")
    return flow_files.read_archive_days(spark, root, 4, ["day", "day"])


ARCHIVE_SQL = f"""WITH {flows_sql()}, placed AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM flows), days AS (SELECT unnest([0, 1]) AS day)
  SELECT CAST(day AS INTEGER) AS day, strftime(make_timestamp((1499040000::BIGINT + day * 86400 + i // 4 * 80 // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, {_DATASET_COLUMNS}
  FROM placed, days WHERE i % 4 = 0"""


LOG_ROWS = 500_000  # records of a log file, at most about: a file is one task's work


def _written_log(spark, sf, files: int = 1) -> str:
    """The flows as log files of even size: ``files``, or more where they would hold more than ``LOG_ROWS`` records."""
    path, rows = folder_for(spark) + "/log", flows(spark, sf)
    files = max(files, -(-rows.count() // LOG_ROWS))
    rows.repartition(files, "event_id", "observed_at", "src_ip").select(F.to_json(_record()).alias("value")).write.text(path)
    return path


def _record():
    """A flow as a record of the sensor's log."""
    return F.struct(
        (F.unix_micros("observed_at") / 1e6).alias("ts"), F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("uid"),
        F.col("src_ip").alias("id.orig_h"), F.col("dst_ip").alias("id.resp_h"), F.col("src_port").alias("id.orig_p"), F.col("dst_port").alias("id.resp_p"),
        F.lower("protocol").alias("proto"), F.col("packet_count").alias("orig_pkts"), F.lit(0).alias("resp_pkts"), F.col("byte_count").alias("orig_bytes"),
        F.lit("-").alias("resp_bytes"), (F.col("duration_ms") / 1000.0).alias("duration"),
        F.when(F.col("tcp_flags") == "SYN", "S").otherwise("ShAD").alias("history"), F.when(F.col("failed_connection"), "S0").otherwise("SF").alias("conn_state"),
    )


def query_read_zeek(spark, sf):
    return flow_files.read_zeek_json(spark, _written_log(spark, sf))


ZEEK_SQL = f"""WITH {flows_sql()} SELECT 'C' || event_id AS uid, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, src_ip, dst_ip, CAST(src_port AS VARCHAR) AS src_port, CAST(dst_port AS VARCHAR) AS dst_port,
  protocol, CAST(packet_count AS VARCHAR) AS packets, CAST(byte_count AS VARCHAR) AS bytes, CAST(CAST(trunc(CAST(duration_ms AS DOUBLE) / 1000 * 1000) AS BIGINT) AS VARCHAR) AS duration_ms,
  CASE WHEN tcp_flags = 'SYN' THEN 'SYN' ELSE 'SYN,ACK' END AS flags, CASE WHEN failed_connection THEN 'SYN_NO_ACK' ELSE 'CLEAN' END AS failed_conn_info FROM flows"""


def query_read_timeline(spark, sf):
    from checks.windows import timeline

    path = folder_for(spark) + "/timeline"
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    timeline(spark, sf).select(stamp("start"), stamp("end"), "label").write.option("header", True).csv(path)
    read = flow_files.read_label_timeline(spark, path)
    return read.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.unix_seconds(F.min("start")).alias("first"), F.unix_seconds(F.max("end")).alias("last"))


def query_write_labeled(spark, sf):
    path = folder_for(spark) + "/labeled"
    flow_files.write_labeled_flows(flow_files.labeled_columns(flows(spark, sf)), path)
    return spark.read.option("header", True).csv(path)


def query_manifest(spark, sf):
    """The same upload twice: the second load is recognised, whatever the row order."""
    root, raw = folder_for(spark), upload(spark, sf).drop("event_id")
    first = tables.load_flows(raw, "up", root + "/flows", root + "/loads", NOW)
    again = tables.load_flows(raw.orderBy("src_port", "timestamp"), "up", root + "/flows", root + "/loads", NOW)
    stored = spark.read.parquet(root + "/flows").agg(F.count(F.lit(1)).alias("stored_rows"))
    jobs = spark.read.parquet(root + "/loads").select("total_rows", "accepted_rows", "skipped_rows", "status")
    # The same cells under the other port column are a load of their own.
    one = upload(spark, sf).drop("event_id").withColumn("dst_port", F.lit(None).cast("string"))
    other = one.withColumns({"src_port": F.col("dst_port"), "dst_port": F.col("src_port")})
    shifted = [tables.load_flows(part, "shift", root + "/shifted", root + "/shifted-loads", NOW)["duplicate"] for part in (one, other)]
    return jobs.withColumn("second_is_duplicate", F.lit(again["duplicate"] and not first["duplicate"])).withColumn("shifted_is_duplicate", F.lit(any(shifted))).withColumn(
        "stored_rows", F.lit(stored.first().stored_rows))


def query_upsert(spark, sf):
    """Windows written twice: the repeat leaves the table as it is."""
    from checks.windows import wins

    path = folder_for(spark) + "/windows"
    rows = wins(spark, sf).withColumn("window_date", F.to_date(F.date_trunc("month", "window_start")))
    for _ in range(2):
        tables.upsert_table(rows, path, [*BY, "window_start"], [*BY, "window_date"])
    return show(spark.read.parquet(path), ["flow_count", "packet_count", "byte_count"])


def query_leakage(spark, sf):
    return labeling.leakage_check(flows(spark, sf), "2024-01-16 00:00:00", W).groupBy(*BY).agg(F.count(F.lit(1)).alias("windows"))


def training(spark, sf):
    """The labelled and split windows, made once, and the scaling of their training part."""
    s = cut_lineage(split(spark, sf))
    return s, models.fit_scaling(s)


# Given parameters, so that scores can be compared: scaling (i, 1 + i % 3) and weights of feature i, and a bias per model.
_MEAN = [float(i) for i in range(len(fv.FEATURE_NAMES))]
_STD = [1.0 + i % 3 for i in range(len(fv.FEATURE_NAMES))]
_RISK = [((7 * i) % 11 - 5) / 2000.0 for i in range(len(fv.FEATURE_NAMES))]
_STAGE = [[((5 * i + 3 * k) % 13 - 6) / 3000.0 for i in range(len(fv.FEATURE_NAMES))] for k in range(len(fv.STAGES))]


def given_model() -> models.ForecastModel:
    """Persistence: the next window is like the newest one, every value a tenth closer to the mean."""
    n = len(fv.FEATURE_NAMES)
    dynamics = np.zeros((n * fv.HISTORY_WINDOWS + 1, n))
    dynamics[-1 - n:-1] = 0.9 * np.eye(n)
    return models.ForecastModel(
        models.Scaling(tuple(_MEAN), tuple(_STD)), dynamics, models.LinearScore(np.array([_RISK]), np.array([-0.2])),
        models.LinearScore(np.array(_STAGE), np.zeros(len(fv.STAGES))))


def query_risk_model(spark, sf):
    """Every window scored by the given risk model."""
    model = given_model()
    return show(models.risk_scores(feats(spark, sf), model.scaling, model.risk), ["y_score"])


def query_learned(spark, sf):
    """The learned path from features to flag: forecasts of the given model, and which newest windows lie outside its training."""
    found = models.learned_forecasts(feats(spark, sf), given_model())
    first = F.col("risk_timeline")[0]
    return found.select(*BY, "is_ood", r6(first["risk_score"]).alias("first_risk"), r6(F.col("peak_risk")).alias("peak_risk"), "peak_risk_window", first["stage"].alias("first_stage"))


def _zero(value):
    """Three digits, and no negative zero."""
    return F.round(value, 3) + F.lit(0.0)


def _parameter(place, names=tuple(fv.FEATURE_NAMES)):
    return F.coalesce(F.get(F.array(*map(F.lit, names)), place.cast("int")), F.lit("bias"))


def query_risk_fit(spark, sf):
    """Optimality of both risk fits -- on one window, and on the ten windows before -- per parameter."""
    s, scaling = training(spark, sf)
    out = None
    for name, rows, history in (("window", s, False), ("history", cut_lineage(labeling.history_sequences(s, W)), True)):
        found = models.risk_gradients(rows, scaling, models.fit_risk(rows, scaling, history), history)
        n = len(fv.FEATURE_NAMES)
        last = n * fv.HISTORY_WINDOWS if history else n
        lag = F.when(F.col("place") == last, 0).otherwise(fv.HISTORY_WINDOWS - F.floor(F.col("place") / n)) if history else F.lit(0)
        parameter = F.when(F.col("place") == last, "bias").otherwise(_parameter(F.col("place") % n))
        part = found.select(F.lit(name).alias("input"), lag.cast("int").alias("lag"), parameter.alias("parameter"), "rows", _zero(F.col("gradient")).alias("gradient"))
        out = part if out is None else out.unionByName(part)
    return out


def query_stage_model(spark, sf):
    """Optimality of the stage fit per stage and parameter, with the stage's training windows."""
    s, scaling = training(spark, sf)
    found = models.stage_gradients(s, scaling, models.fit_stage(s, scaling))
    windows = s.filter("split = 'train'").groupBy("stage").agg(F.count(F.lit(1)).alias("windows"))
    return found.join(windows, "stage").select(F.col("stage").cast("int").alias("stage"), _parameter(F.col("place")).alias("parameter"), "windows", "rows", _zero(F.col("gradient")).alias("gradient"))


def query_dynamics(spark, sf):
    """What is left of the dynamics fit's normal equations, per target, input and lag."""
    s, scaling = training(spark, sf)
    samples = cut_lineage(labeling.history_sequences(s, W))
    found = models.dynamics_residuals(samples, scaling, models.fit_dynamics(samples, scaling))
    n = len(fv.FEATURE_NAMES)
    bias = F.col("place") == n * fv.HISTORY_WINDOWS
    return found.select(
        _parameter(F.col("target")).alias("target"), F.when(bias, "bias").otherwise(_parameter(F.col("place") % n)).alias("input"),
        F.when(bias, 0).otherwise(fv.HISTORY_WINDOWS - F.floor(F.col("place") / n)).cast("int").alias("lag"), "rows", _zero(F.col("residual")).alias("residual"))


def _rolled(spark, sf):
    return models.forecast_rollout(labeling.history_sequences(split(spark, sf), W), given_model())


def query_rollout(spark, sf):
    """Five steps ahead of every window with ten before it, by the given model."""
    points = _rolled(spark, sf).select(*BY, "window_start", F.explode("risk_timeline").alias("p"))
    return points.select(*BY, F.unix_seconds("window_start").alias("window_start"), "p.step", r6(F.col("p.risk_score")).alias("risk_score"), "p.stage", r3(F.col("p.stage_confidence")).alias("stage_confidence"))


def query_contributions(spark, sf):
    """How much of each forecast the five strongest features carry, by the given model."""
    parts = _rolled(spark, sf).select(*BY, "window_start", F.posexplode("contributors").alias("rank", "c"))
    return parts.select(*BY, F.unix_seconds("window_start").alias("window_start"), "rank", r6(F.col("c.contribution")).alias("contribution"))


def query_comparison(spark, sf):
    """The given model's two scorers on the held-out windows."""
    found = models.model_comparison(training(spark, sf)[0], given_model(), seconds=W)
    measures = ("precision", "recall", "f1", "false_positive_rate", "roc_auc", "pr_auc", "calibrated_threshold")
    return found.select("model", "tn", "fp", "fn", "tp", "support", "positive_support", *[r6(F.col(c)).alias(c) for c in measures], "episodes", "warned_episodes", "max_lead_time_sec", "caveat")


def query_registry(spark, sf):
    """The given model with how many windows of each source it scores as risky, registered twice and kept once."""
    model = given_model()
    path = folder_for(spark) + "/models"
    risky = models.risk_scores(feats(spark, sf), model.scaling, model.risk).groupBy(*BY).agg(F.count_if(F.col("y_score") >= 0.5).alias("n")).orderBy(*BY).collect()
    metrics = ",".join(f"{r.traffic_source_id}:{r.n}" for r in risky)  # one entry per source
    new = [tables.register_model(spark, path, fv.LEARNED_MODEL_NAME, model.version, fv.FEATURE_SCHEMA_VERSION, metrics, NOW) for _ in range(2)]
    return spark.read.parquet(path).select("name", "version", "feature_schema_version", "metrics", F.lit(new == [True, False]).alias("inserted_once"))


# --- Streams ----------------------------------------------------------------------------------


def _drain(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def query_stream_zeek(spark, sf):
    root = folder_for(spark)
    stream = live.stream_zeek(spark, _written_log(spark, sf, 4), "live", 2).withColumn("extra", F.to_json("extra"))
    _drain(stream.writeStream.format("parquet").option("path", root + "/flows").option("checkpointLocation", root + "/cp"))
    return spark.read.parquet(root + "/flows").groupBy("protocol", "tcp_flags", "failed_connection").agg(F.count(F.lit(1)).alias("rows"), F.sum("byte_count").alias("bytes"))


def query_stream_live(spark, sf):
    """One file per day of the log and one without any record; a day with a record that has no responder is refused whole."""
    root = folder_for(spark)
    path = folder_for(spark) + "/log"
    day = F.to_date("observed_at")
    broken = (F.dayofmonth("observed_at") % 5 == 2) & (F.col("event_id") % 97 == 3)
    rows = flows(spark, sf).withColumn("dst_ip", F.when(broken, "nowhere").otherwise(F.col("dst_ip"))).withColumn("day", day)
    rows.select("day", F.to_json(_record()).alias("value")).repartition("day").write.partitionBy("day").text(path)
    rows.limit(1).select(F.lit("no record").alias("value")).write.text(f"{path}/day=none")
    _drain(live.stream_live_batches(spark, path + "/*", "live", "q", root + "/flows", root + "/jobs", root + "/cp"))
    jobs = live.live_jobs(spark, root + "/jobs").groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("total_rows").alias("total_rows"), F.sum("accepted_rows").alias("accepted_rows"))
    stored = spark.read.parquet(root + "/flows").agg(F.count(F.lit(1)).alias("stored_rows")).withColumn("status", F.lit("completed"))
    return jobs.join(stored, "status", "left")


def query_stream_windows(spark, sf):
    root = folder_for(spark)
    flows(spark, sf).write.parquet(root + "/in")
    stream = spark.readStream.schema(spark.read.parquet(root + "/in").schema).parquet(root + "/in")
    out = live.stream_flow_windows(stream, W)
    _drain(out.writeStream.format("parquet").outputMode("append").option("path", root + "/out").option("checkpointLocation", root + "/cp"))
    return show(spark.read.parquet(root + "/out"), ["flow_count", "packet_count", "byte_count"])


def query_stream_dedup(spark, sf):
    """Every record twice in the log; each connection id comes out once."""
    root = folder_for(spark)
    f = flows(spark, sf).withColumn("uid", F.col("event_id").cast("string"))
    f.unionByName(f).write.parquet(root + "/in")
    stream = spark.readStream.schema(spark.read.parquet(root + "/in").schema).parquet(root + "/in")
    out = live.stream_dedup(stream, "40 days")
    _drain(out.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/cp"))
    return spark.read.parquet(root + "/out").groupBy(*BY).agg(F.count(F.lit(1)).alias("rows"), F.sum("byte_count").alias("bytes"))


def _feature_stream(spark, sf) -> str:
    """The flows scattered over three files, read one at a time, so that windows arrive in parts and late."""
    root = folder_for(spark)
    f = flows(spark, sf).withColumn("extra", F.create_map().cast("map<string,string>"))
    f.repartition(3, "event_id").write.parquet(root + "/in")
    stream = spark.readStream.schema(spark.read.parquet(root + "/in").schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
    _drain(live.stream_scores(stream, "q", root, root + "/cp", W, "month"))
    return root


def query_stream_features(spark, sf):
    return show(spark.read.parquet(_feature_stream(spark, sf) + "/features"), [*fv.FEATURE_NAMES, "feature_schema_version", "is_complete"])


def query_stream_scores(spark, sf):
    scores = spark.read.parquet(_feature_stream(spark, sf) + "/scores")
    newest = scores.groupBy(*BY).agg(F.max_by(F.struct("window_start", "peak_risk", "predicted_attack_type"), "window_start").alias("n"))
    return newest.select(*BY, F.unix_seconds("n.window_start").alias("window_start"), "n.peak_risk", "n.predicted_attack_type")


QUERIES = {
    "parse_flexible_time": query_flexible_time,
    "replay_timeline": query_replay_timeline,
    "read_flow_csv": query_read_flow_csv,
    "read_cicids_csv": query_read_cicids,
    "read_archive_days": query_archive,
    "read_zeek_json": query_read_zeek,
    "read_label_timeline": query_read_timeline,
    "write_labeled_flows": query_write_labeled,
    "load_manifest": query_manifest,
    "upsert_tables": query_upsert,
    "leakage_check": query_leakage,
    "risk_model": query_risk_model,
    "risk_fit": query_risk_fit,
    "learned_forecasts": query_learned,
    "stage_model": query_stage_model,
    "dynamics_model": query_dynamics,
    "forecast_rollout": query_rollout,
    "feature_contributions": query_contributions,
    "model_comparison": query_comparison,
    "model_registry": query_registry,
    "stream_zeek": query_stream_zeek,
    "stream_live_batches": query_stream_live,
    "stream_flow_windows": query_stream_windows,
    "stream_dedup": query_stream_dedup,
    "stream_features": query_stream_features,
    "stream_scores": query_stream_scores,
}


def _sql() -> dict[str, str]:
    from checks.scores import LEADS, THRESHOLD, scores_cte, zero
    from checks.windows import SQL as W_SQL, feats_sql, split_sql

    z = [f"(CAST({n} AS DOUBLE) - {m}) / {s}" for n, m, s in zip(fv.FEATURE_NAMES, _MEAN, _STD)]
    dot = lambda weights: " + ".join(f"({v}) * ({w!r})" for v, w in zip(z, weights))
    sigmoid = lambda x: f"(1.0 / (1.0 + exp(-({x}))))"
    logits = ", ".join(f"{dot(w)} AS g{k}" for k, w in enumerate(_STAGE))
    base = feats_sql() + f""", lin AS (SELECT traffic_source_id, ws, {dot(_RISK)} AS r, {logits}, {" + ".join(f"(abs({v}) > {fv.OOD_Z})::INT" for v in z)} AS far,
      {", ".join(f"abs({v}) * {abs(w)!r} AS c{i}" for i, (v, w) in enumerate(zip(z, _RISK)))},
      row_number() OVER (PARTITION BY traffic_source_id ORDER BY ws) AS i, count(*) OVER (PARTITION BY traffic_source_id) AS n FROM feats)"""
    # The chance of stage k after a step: softmax of the logits times 0.9 per step.
    step = "steps AS (SELECT unnest(range(1, 6)) AS step)"
    chances = [f"exp(pow(0.9, step) * g{k})" for k in range(len(fv.STAGES))]
    best = "greatest(" + ", ".join(chances) + ")"
    stage = "CASE " + " ".join(f"WHEN {c} = {best} THEN '{name}'" for c, name in zip(chances, fv.STAGES)) + " END"
    # A sequence's history ends with the window before its target.
    ahead = base + ", prev AS (SELECT *, lead(ws) OVER (PARTITION BY traffic_source_id ORDER BY ws) AS target FROM lin)"
    eligible = "i >= 10 AND target IS NOT NULL"

    newest = feats_sql() + scores_cte() + " SELECT traffic_source_id, ws AS window_start, risk_score / 100.0 AS peak_risk, predicted_attack_type FROM fc QUALIFY ws = max(ws) OVER (PARTITION BY traffic_source_id)"
    names = "[" + ", ".join(f"'{n}'" for n in fv.FEATURE_NAMES) + "]"
    fit = split_sql() + f""", train AS (SELECT * FROM sp WHERE split = 'train'), f AS (SELECT unnest({names}) AS f), lags AS (SELECT unnest(range(1, {fv.HISTORY_WINDOWS} + 1)) AS lag),
      inputs AS (SELECT f AS parameter, CAST(lag AS INTEGER) AS lag FROM f, lags UNION ALL SELECT 'bias', 0), own AS (SELECT f AS parameter FROM f UNION ALL SELECT 'bias'),
      k AS (SELECT count(*) AS rows, count(*) FILTER (WHERE row_index >= {fv.HISTORY_WINDOWS}) AS samples FROM train)"""
    half = LEADS.replace(f">= {THRESHOLD}", ">= 0.5")
    both = split_sql() + f""", z AS (SELECT *, lag(r) OVER (PARTITION BY traffic_source_id ORDER BY ws) AS r0 FROM (SELECT traffic_source_id, ws, risk, split, row_index AS pos, {dot(_RISK)} AS r FROM sp)),
      held AS (SELECT * FROM z WHERE split = 'test' AND pos >= {fv.HISTORY_WINDOWS}),
      two AS (SELECT 'same_window' AS model, traffic_source_id AS src, ws, risk AS y, {sigmoid('r - 0.2')} AS s FROM held UNION ALL SELECT 'next_window', traffic_source_id, ws, risk, {sigmoid('0.9 * r0 - 0.2')} FROM held),
      sco AS (SELECT model, src || '/' || model AS traffic_source_id, ws, y, s, row_number() OVER (PARTITION BY model, src ORDER BY ws) - 1 AS row_index FROM two)"""
    compared = both + half + f""", c AS (SELECT model, count(*) FILTER (y = 0 AND s < 0.5) AS tn, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 1 AND s >= 0.5) AS tp FROM sco GROUP BY 1),
      d AS (SELECT model, s, count(*) FILTER (y = 0) AS n, count(*) FILTER (y = 1) AS p FROM sco GROUP BY 1, 2),
      up AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n + p) OVER w AS alln, sum(p) OVER w AS hits FROM d WINDOW w AS (PARTITION BY model ORDER BY s DESC)),
      area AS (SELECT model, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS roc, sum(p * hits / alln) / sum(p) AS pr FROM up GROUP BY 1),
      cand AS (SELECT DISTINCT model, s AS t FROM sco UNION SELECT DISTINCT model, 0.0 FROM sco UNION SELECT DISTINCT model, 1.0 FROM sco),
      tried AS (SELECT c.model, t, avg(CASE WHEN s >= t THEN 1.0 ELSE 0.0 END) FILTER (y = 0) AS fpr, avg(CASE WHEN s >= t THEN 1.0 ELSE 0.0 END) FILTER (y = 1) AS rec FROM cand c JOIN sco USING (model) GROUP BY ALL),
      cal AS (SELECT model, round_even(CAST(arg_max(t, (rec, t)) AS DOUBLE), 4) AS threshold FROM tried WHERE fpr <= 0.05 GROUP BY 1),
      led AS (SELECT string_split(traffic_source_id, '/')[-1] AS model, count(*) AS episodes, count(lead_time_sec) AS warned_episodes, max(lead_time_sec) AS max_lead_time_sec FROM leads GROUP BY 1)
      SELECT c.*, tn + fp + fn + tp AS support, fn + tp AS positive_support, {q6('round_even(' + zero('tp', '(tp + fp)') + ', 4)')} AS precision, {q6('round_even(' + zero('tp', '(tp + fn)') + ', 4)')} AS recall,
      {q6('round_even(' + zero('2 * tp', '(2 * tp + fp + fn)') + ', 4)')} AS f1, {q6('round_even(' + zero('fp', '(fp + tn)') + ', 4)')} AS false_positive_rate, {q6('roc')} AS roc_auc, {q6('pr')} AS pr_auc,
      {q6('threshold')} AS calibrated_threshold, episodes, warned_episodes, max_lead_time_sec, CASE WHEN fn + tp IN (0, tn + fp + fn + tp) THEN 'the held-out windows hold a single class' END AS caveat
      FROM c JOIN area USING (model) JOIN cal USING (model) JOIN led USING (model)"""
    days = "days AS (SELECT DISTINCT epoch_us(date_trunc('day', ts)) // 1000000 AS d FROM events)"
    return {
        "read_flow_csv": READ_SQL,
        "load_manifest": PARSED_CTE + ", c AS (SELECT count(*) AS n, count(*) FILTER (problems = '') AS k FROM judged) SELECT n AS total_rows, k AS accepted_rows, n - k AS skipped_rows, 'completed' AS status, true AS second_is_duplicate, false AS shifted_is_duplicate, k AS stored_rows FROM c",
        "stream_live_batches": f"{EV}, d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (WHERE day(ts) % 5 = 2 AND event_id % 97 = 3) AS bad FROM events GROUP BY 1 UNION ALL SELECT NULL, 0, 0) SELECT CASE WHEN bad = 0 THEN 'completed' ELSE 'rejected_invalid_flow' END AS status, count(*) AS files, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(CASE WHEN bad = 0 THEN n ELSE 0 END) AS BIGINT) AS accepted_rows, CAST(sum(CASE WHEN bad = 0 THEN n END) AS BIGINT) AS stored_rows FROM d GROUP BY 1",
        "stream_flow_windows": W_SQL["flow_windows"].replace("// 60 * 60", f"// {W} * {W}") + f" WHERE (ws + {W}) * 1000000 <= (SELECT max(us) FROM flows) - 120000000",
        "parse_flexible_time": f"{EV} SELECT event_id, CASE event_id % 6 WHEN 1 THEN us // 60000000 * 60 WHEN 4 THEN us // 60000000 * 60 WHEN 5 THEN NULL ELSE us // 1000000 END AS seconds FROM ev",
        "replay_timeline": f"{EV} SELECT event_id, 1499040000 + event_id * 20 // 1000 AS seconds FROM ev",
        "read_cicids_csv": DATASET_SQL,
        "read_archive_days": ARCHIVE_SQL,
        "read_zeek_json": ZEEK_SQL,
        "read_label_timeline": f"WITH {days} SELECT * FROM (SELECT 'PortScan' AS label, count(*) AS rows, min(d) + 10800 AS first, max(d) + 18000 AS last FROM days UNION ALL SELECT 'SSH_Patator', count(*), min(d) + 14400, max(d) + 21600 FROM days UNION ALL SELECT 'DDoS_LOIC', count(*), min(d) + 14400, max(d) + 93600 FROM days)",
        "write_labeled_flows": f"""WITH {flows_sql()} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, src_ip, dst_ip, CAST(src_port AS VARCHAR) AS src_port, CAST(dst_port AS VARCHAR) AS dst_port, protocol,
          CAST(packet_count AS VARCHAR) AS packets, CAST(byte_count AS VARCHAR) AS bytes, CAST(duration_ms AS VARCHAR) AS duration_ms, tcp_flags AS flags,
          CASE WHEN failed_connection THEN 'SYN_NO_ACK' WHEN NOT failed_connection THEN 'CLEAN' ELSE 'NA' END AS failed_conn_info, label FROM flows""",
        "risk_model": base + f" SELECT traffic_source_id, ws AS window_start, {q6(sigmoid('r - 0.2'))} AS y_score FROM lin",
        "risk_fit": fit + " SELECT 'window' AS input, 0 AS lag, parameter, rows, CAST(0 AS DOUBLE) AS gradient FROM own, k UNION ALL SELECT 'history', lag, parameter, samples, CAST(0 AS DOUBLE) FROM inputs, k",
        "stage_model": fit + ", st AS (SELECT CAST(stage AS INTEGER) AS stage, count(*) AS windows FROM train GROUP BY 1) SELECT stage, parameter, windows, rows, CAST(0 AS DOUBLE) AS gradient FROM st, own, k",
        "dynamics_model": fit + " SELECT f AS target, parameter AS input, lag, samples AS rows, CAST(0 AS DOUBLE) AS residual FROM f, inputs, k",
        "model_comparison": compared,
        "model_registry": base + f", k AS (SELECT traffic_source_id, count(*) FILTER (WHERE {sigmoid('r - 0.2')} >= 0.5) AS n FROM lin GROUP BY 1) SELECT '{fv.LEARNED_MODEL_NAME}' AS name, '{given_model().version}' AS version, '{fv.FEATURE_SCHEMA_VERSION}' AS feature_schema_version, string_agg(traffic_source_id || ':' || n, ',' ORDER BY traffic_source_id) AS metrics, true AS inserted_once FROM k",
        "learned_forecasts": base + f" SELECT traffic_source_id, far >= {fv.OOD_MIN_FEATURES} AS is_ood, {q6(sigmoid('0.9 * r - 0.2'))} AS first_risk, {q6('CASE WHEN r < 0 THEN ' + sigmoid('pow(0.9, 5) * r - 0.2') + ' ELSE ' + sigmoid('0.9 * r - 0.2') + ' END')} AS peak_risk, CAST(CASE WHEN r < 0 THEN 5 ELSE 1 END AS INTEGER) AS peak_risk_window, {stage.replace('step', '1')} AS first_stage FROM lin WHERE i = n AND n >= 10",
        "forecast_rollout": ahead + f", {step} SELECT traffic_source_id, target AS window_start, CAST(step AS INTEGER) AS step, {q6(sigmoid('pow(0.9, step) * r - 0.2'))} AS risk_score, {stage} AS stage, round({best} / ({' + '.join(chances)}), 3) + 0.0 AS stage_confidence FROM prev, steps WHERE {eligible}",
        "feature_contributions": ahead + f", parts AS (SELECT traffic_source_id, target, unnest(list_slice(list_reverse_sort([{', '.join(f'c{i}' for i in range(len(fv.FEATURE_NAMES)))}]), 1, 5)) AS c, unnest(range(0, 5)) AS rank, {' + '.join(f'c{i}' for i in range(len(fv.FEATURE_NAMES)))} AS total FROM prev WHERE {eligible}) SELECT traffic_source_id, target AS window_start, CAST(rank AS INTEGER) AS rank, {q6('c / total')} AS contribution FROM parts",
        "upsert_tables": W_SQL["flow_windows"].replace("// 60 * 60", f"// {W} * {W}"),
        "leakage_check": "SELECT '' AS traffic_source_id, 0 AS windows WHERE false",
        "stream_zeek": f"WITH {flows_sql()} SELECT protocol, CASE WHEN tcp_flags = 'SYN' THEN 'SYN' ELSE 'SYN,ACK' END AS tcp_flags, coalesce(failed_connection, false) AS failed_connection, count(*) AS rows, CAST(sum(byte_count) AS BIGINT) AS bytes FROM flows GROUP BY 1, 2, 3",
        "stream_dedup": f"WITH {flows_sql()} SELECT traffic_source_id, count(*) AS rows, CAST(sum(byte_count) AS BIGINT) AS bytes FROM flows GROUP BY 1",
        "stream_features": W_SQL["window_features"],
        "stream_scores": newest,
    }


SQL = _sql()
