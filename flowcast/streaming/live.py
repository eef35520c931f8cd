"""Structured Streaming jobs: a live connection log to flows, windows, features and scores.

Batch and stream share the same column expressions.  Everything that looks at neighbouring windows
runs inside ``foreachBatch`` and writes by key, so a repeated micro-batch leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from flowcast import fixed_values as fv
from flowcast.operators.features import base_features, contract_columns, valid_features, with_momentum
from flowcast.operators.forecasts import rule_payload
from flowcast.operators.normalize import parse_flows
from flowcast.operators.timeline import time_chunk, with_previous
from flowcast.operators.windows import SOURCE, latest_window, window_start
from flowcast.session import Staging
from flowcast.sources.flow_files import SENSOR_SCHEMA, sensor_rows
from flowcast.sources.tables import dated_rows, upsert_dates, upsert_table

LOOKBACK = fv.BURST_LOOKBACK + 1
DAY_BUCKETS = 64  # folders of the index of stored dates


def stream_records(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New log files of a folder as raw rows, with the file each row came from."""
    reader = spark.readStream.schema(SENSOR_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    records = reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return sensor_rows(records.select("*", F.col("_metadata.file_path").alias("batch_file")))


def stream_zeek(spark: SparkSession, folder: str, source: str, files_per_trigger: int = 100) -> DataFrame:
    """Live log -> valid flows, tagged with their sensor."""
    raw = stream_records(spark, folder, files_per_trigger).withColumn("traffic_source_id", F.lit(source))
    parsed = parse_flows(raw, ["traffic_source_id", "uid", "batch_file"])
    tag = F.create_map(F.lit("sensor"), F.lit("zeek"))
    flows = parsed.filter(F.size("problems") == 0).drop("problems")
    return flows.withColumn("extra", F.map_concat("extra", tag))


def stream_dedup(flows: DataFrame, delay: str = "10 minutes", key: str = "uid") -> DataFrame:
    """Replayed records once, by the log's own connection id; equal flows with other ids are real repeats."""
    return flows.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark([key])


def stream_flow_windows(flows: DataFrame, seconds: int = 60, delay: str = "2 minutes", by: Sequence[str] = SOURCE) -> DataFrame:
    """Windows in append mode.  The first level keeps one state row per five-tuple, so the second
    level's row count is the exact distinct count."""
    window = F.window("observed_at", f"{seconds} seconds")
    tuples = (
        flows.withWatermark("observed_at", delay)
        .groupBy(window.alias("window"), *by, "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
        .agg(F.sum("packet_count").alias("packets"), F.sum("byte_count").alias("bytes"))
    )
    totals = tuples.groupBy("window", *by).agg(
        F.count(F.lit(1)).alias("flow_count"), F.sum("packets").alias("packet_count"), F.sum("bytes").alias("byte_count")
    )
    return totals.select(
        *by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "flow_count", "packet_count", "byte_count",
    )


def _overwrite_batch(rows: DataFrame, path: str, query: str, batch_id: int) -> None:
    """Write the rows of one micro-batch to its own partition, replacing an earlier attempt."""
    tagged = rows.withColumns({"query": F.lit(query), "batch_id": F.lit(batch_id).cast("bigint")})
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("query", "batch_id").parquet(path)


_LISTED = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The name of each new log file, also of one without any record.  The files are listed, not read.

    A file of no bytes at all is the exception: Spark's file source passes over it.
    """
    reader = spark.readStream.format("binaryFile").schema(_LISTED).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("batch_file"))


def live_batch_sink(query: str, flows_path: str, jobs_path: str) -> Callable[[DataFrame, int], None]:
    """Sink that treats each file as one batch: one bad flow rejects it whole, whatever its size.

    Every file leaves a job row with its counts, see ``live_jobs``.  ``raw`` holds the records and, with ``is_file``,
    one row per file.
    """

    def write(raw: DataFrame, batch_id: int) -> None:
        files = raw.filter("is_file").select("traffic_source_id", "batch_file")
        records = raw.filter("NOT is_file").drop("is_file")
        parsed = parse_flows(records, ["traffic_source_id", "uid", "batch_file"]).persist()
        try:
            counted = parsed.select("traffic_source_id", "batch_file", F.lit(1).alias("row"), (F.size("problems") > 0).cast("int").alias("bad"))
            listed = files.select("*", F.lit(0).alias("row"), F.lit(0).alias("bad"))
            jobs = counted.unionByName(listed).groupBy("traffic_source_id", "batch_file").agg(
                F.sum("row").alias("total_rows"), F.sum("bad").alias("bad_rows")
            )
            accepted = F.col("bad_rows") == 0
            status = F.when(accepted, "completed").otherwise("rejected_invalid_flow")
            jobs = jobs.withColumns({"accepted_rows": F.when(accepted, F.col("total_rows")).otherwise(0), "status": status})
            good = jobs.filter(F.col("status") == "completed").select("traffic_source_id", "batch_file")
            tag = F.create_map(F.lit("sensor"), F.lit("zeek"))
            flows = parsed.join(good, ["traffic_source_id", "batch_file"], "left_semi").drop("problems")
            flows = flows.withColumn("extra", F.to_json(F.map_concat("extra", tag)))
            _overwrite_batch(flows, flows_path, query, batch_id)
            _overwrite_batch(jobs, jobs_path, query, batch_id)
        finally:
            parsed.unpersist()

    return write


def stream_live_batches(spark: SparkSession, folder: str, source: str, query: str, flows_path: str, jobs_path: str, checkpoint: str) -> DataStreamWriter:
    records = stream_records(spark, folder).withColumn("is_file", F.lit(False))
    files = stream_files(spark, folder).withColumn("is_file", F.lit(True))
    raw = records.unionByName(files, allowMissingColumns=True).withColumn("traffic_source_id", F.lit(source))
    sink = live_batch_sink(query, flows_path, jobs_path)
    return raw.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(sink)


def live_jobs(spark: SparkSession, jobs_path: str) -> DataFrame:
    """One job row per file.  A file's name and its records are listed apart, so they may come in two micro-batches
    and leave two rows; the one with the records counts."""
    jobs = spark.read.parquet(jobs_path)
    keys = ["query", "traffic_source_id", "batch_file"]
    facts = ["total_rows", "bad_rows", "accepted_rows", "status", "batch_id"]
    best = jobs.groupBy(*keys).agg(F.max_by(F.struct(*facts), "total_rows").alias("job"))
    return best.select(*keys, "job.*")


def _period(time: str | Column, unit: str) -> Column:
    """Directory a row is stored in: its ``day`` or ``month``."""
    return F.to_date(F.date_trunc(unit, F.col(time) if isinstance(time, str) else time))


def _days_path(base_path: str) -> str:
    return f"{base_path}_days"


def _bucket(by: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(DAY_BUCKETS)).cast("int")


def near_dates(spark: SparkSession, touched: DataFrame, base_path: str, by: Sequence[str] = SOURCE) -> DataFrame:
    """The (source, date) folders that hold a touched window, the up to four windows before or the four after it.

    Found in the index of stored dates: one row per source and date with its number of windows.  Dates without
    windows have no row, so the neighbours of sparse traffic are found however far away they are.
    """
    hit = touched.select(*by, "window_date").distinct().withColumn("_hit", F.lit(True))
    buckets = [r[0] for r in hit.select(_bucket(by)).distinct().collect()]  # at most DAY_BUCKETS
    index = spark.read.parquet(_days_path(base_path)).filter(F.col("_bucket").isin(buckets))
    index = index.join(hit.select(*by).distinct(), list(by), "left_semi").join(hit, [*by, "window_date"], "left")
    line = Window.partitionBy(*by).orderBy("window_date")
    summed = index.withColumn("_until", F.sum("windows").over(line))
    day = F.struct("_hit", "windows", "_until")
    beside = summed.withColumns(
        {"_ahead": F.collect_list(day).over(line.rowsBetween(1, LOOKBACK)), "_behind": F.collect_list(day).over(line.rowsBetween(-LOOKBACK, -1))}
    )
    before = F.exists("_ahead", lambda d: d["_hit"] & (d["_until"] - d["windows"] - F.col("_until") < LOOKBACK))
    after = F.exists("_behind", lambda d: d["_hit"] & (F.col("_until") - F.col("windows") - d["_until"] < LOOKBACK))
    wanted = F.coalesce(F.col("_hit"), F.lit(False)) | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    return beside.filter(wanted).select(*by, "window_date")


def around_touched(spark: SparkSession, touched: DataFrame, near: DataFrame, base_path: str, schema: StructType, by: Sequence[str] = SOURCE) -> DataFrame:
    """The stored one-window features of the ``near`` dates; ``_touched`` marks the windows that the batch changes."""
    dates = [r[0] for r in near.select("window_date").distinct().collect()]
    stored = dated_rows(spark, base_path, schema, "window_date", dates).join(near, [*by, "window_date"], "left_semi")
    mark = touched.select(*by, "window_start", F.lit(True).alias("_touched"))
    return stored.join(mark, [*by, "window_start"], "left").withColumn("_touched", F.coalesce("_touched", F.lit(False)))


def touched_windows(stage: Staging, batch: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE, period: str = "day") -> DataFrame:
    """The windows that a batch of flows touches, with the date they are stored under."""
    starts = batch.select(*by, window_start(seconds).alias("window_start")).distinct()
    return stage.put(starts.withColumn("window_date", _period("window_start", period)))


def flows_of_windows(
    touched: DataFrame, stored: Callable[[list], DataFrame], seconds: int = 60, by: Sequence[str] = SOURCE, period: str = "day"
) -> DataFrame:
    """All stored flows of the touched windows.  ``stored`` gives the flows of some dates."""
    # A window may reach into the next date.
    last = F.timestamp_micros(F.unix_micros("window_start") + seconds * 1_000_000 - 1)
    dates = touched.select(F.explode(F.array("window_date", _period(last, period)))).distinct().collect()
    flows = stored([r[0] for r in dates]).withColumn("_start", window_start(seconds))
    return flows.join(touched.select(*by, F.col("window_start").alias("_start")), [*by, "_start"], "left_semi").drop("_start")


def refresh_features(
    stage: Staging, touched: DataFrame, flows: DataFrame, base_path: str, features_path: str, seconds: int = 60,
    by: Sequence[str] = SOURCE, period: str = "day",
) -> DataFrame:
    """Recompute the touched windows from all of their flows, and the up to four windows after each.

    Work and reading depend on the touched windows alone: one-window features and features are looked up by their
    dates and the dates of their neighbours.  Returns the refreshed rows.
    """
    spark, keys = touched.sparkSession, [*by, "window_start"]
    base = stage.put(base_features(flows, seconds, by).withColumn("window_date", _period("window_start", period)))
    upsert_dates(base, base_path, keys, "window_date", by)

    hit = touched.select(*by, "window_date").distinct()
    stored = dated_rows(spark, base_path, base.schema, "window_date", [r[0] for r in hit.select("window_date").distinct().collect()])
    counts = stored.join(hit, [*by, "window_date"], "left_semi").groupBy(*by, "window_date").agg(F.count(F.lit(1)).alias("windows"))
    upsert_table(counts.withColumn("_bucket", _bucket(by)), _days_path(base_path), [*by, "window_date"], ["_bucket"])

    near = stage.put(near_dates(spark, touched, base_path, by))
    around = around_touched(spark, touched, near, base_path, base.schema, by)
    # A window is refreshed if it or one of the four before it changed.  At the far end of the loaded dates stand four
    # untouched windows, so no window is taken for the follower of one that it does not follow.
    around = with_previous(around, by, "window_start", ["_touched"], LOOKBACK, time_chunk(F.col("window_start"), seconds), "_before")
    changed = F.col("_touched") | F.exists("_before", lambda w: w["_touched"])
    full = with_momentum(around.withColumn("_changed", changed).drop("_before"), seconds, by).filter("_changed")
    refreshed = stage.put(contract_columns(full, seconds, by, "window_date"))
    upsert_dates(refreshed, features_path, keys, "window_date", by)
    return refreshed


def feature_sink(query: str, flows_path: str, base_path: str, features_path: str, scores_path: str | None = None, seconds: int = 60, by: Sequence[str] = SOURCE, period: str = "day") -> Callable[[DataFrame, int], None]:
    """Sink that stores the flows, refreshes the features and, if wanted, scores each newest refreshed window.

    All tables are partitioned by date first, so a batch finds what it needs without a look at the history.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        with Staging(spark) as stage:
            rows = stage.put(batch.withColumns(
                {"extra": F.to_json("extra"), "flow_date": _period("observed_at", period), "query": F.lit(query), "batch_id": F.lit(batch_id).cast("bigint")}
            ))
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("flow_date", *by, "query", "batch_id").parquet(flows_path)
            touched = touched_windows(stage, rows, seconds, by, period)
            flows = flows_of_windows(touched, lambda dates: dated_rows(spark, flows_path, rows.schema, "flow_date", dates), seconds, by, period)
            refreshed = refresh_features(stage, touched, flows, base_path, features_path, seconds, by, period)
            if scores_path is not None:
                newest = latest_window(valid_features(refreshed), by)
                scores = stage.put(rule_payload(newest, by).withColumn("window_date", _period("window_start", period)))
                upsert_dates(scores, scores_path, [*by, "window_start"], "window_date", by)

    return write


def stream_features(flows: DataFrame, query: str, flows_path: str, base_path: str, features_path: str, checkpoint: str, scores_path: str | None = None, seconds: int = 60, period: str = "day") -> DataStreamWriter:
    """Incremental features; late flows rewrite their window and the ones that look back at it."""
    sink = feature_sink(query, flows_path, base_path, features_path, scores_path, seconds, period=period)
    return flows.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(sink)


def stream_scores(flows: DataFrame, query: str, root: str, checkpoint: str, seconds: int = 60, period: str = "day") -> DataStreamWriter:
    """Rule forecast of each refreshed newest window, kept in ``root``/scores."""
    return stream_features(
        flows, query, f"{root}/flows", f"{root}/base", f"{root}/features", checkpoint, f"{root}/scores", seconds, period
    )
