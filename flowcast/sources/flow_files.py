"""Readers and writers of flow files."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowcast import fixed_values as fv
from flowcast.functions import dataset, sensor
from flowcast.functions.addresses import decimal_ipv4
from flowcast.functions.labels import dataset_label, dataset_label_or_null, timeline_label
from flowcast.functions.rows import epoch_time, iso_time, stripped
from flowcast.operators.normalize import parse_flows
from flowcast.session import Staging, located, staged


class FlowFileError(ValueError):
    """A file that cannot be read as flows."""


_NO_WORD = re.compile(r"[\W_]+")


def canonical_header(name: str | None) -> str:
    """Alias of a column name, or the name itself in lower case with one ``_`` for every run of other signs."""
    plain = _NO_WORD.sub("_", (name or "").lower()).strip("_")
    return fv.HEADER_ALIASES.get(plain, plain)


def flow_headers(names: Sequence[str]) -> list[str]:
    """Canonical names of a file's columns.

    Two columns for one required field, or a missing one, is an error of the whole file; of two
    columns for another field the later one counts.
    """
    canonical = [canonical_header(n) for n in names]
    counts = Counter(canonical)
    doubled = sorted(n for n in fv.REQUIRED_COLUMNS if counts[n] > 1)
    if doubled:
        raise FlowFileError(f"more than one column stands for {', '.join(doubled)}")
    missing = sorted(set(fv.REQUIRED_COLUMNS) - set(canonical))
    if missing:
        raise FlowFileError(f"no column stands for {', '.join(missing)}")
    return [n if n and n not in canonical[i + 1:] else f"_unused_{i}" for i, n in enumerate(canonical)]


def _header_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that is not blank; NULL if there is none."""
    jvm = spark._jvm
    path, system = located(spark, file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(path)
    stream = system.open(path)
    try:
        text = stream if codec is None else codec.createInputStream(stream)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        return line
    finally:
        stream.close()


def files_by_header(spark: SparkSession, path: str | Sequence[str], at_once: int = 32) -> list[list[str]]:
    """The CSV files under ``path``, those with the same header line together; files without a line are left out.

    Spark lists the files, as for any read, and each one is opened for its first line only, ``at_once`` at a time.
    The data is not read.
    """
    jvm = spark._jvm
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in spark.read.text(path).inputFiles()]
    groups = defaultdict(list)
    with ThreadPoolExecutor(at_once) as pool:
        for file, header in zip(files, pool.map(lambda f: _header_line(spark, f), files)):
            if header is not None:
                groups[header].append(file)
    return sorted(sorted(group) for group in groups.values())


def _read_text_columns(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every column as text, in the header that all the files share; one row per line, so files split."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
    return reader.option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)


def _united(frames: list[DataFrame]) -> DataFrame:
    """The frames one after the other by column name; a column that a frame lacks is NULL there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def read_raw_flows(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Upload CSVs as text columns under canonical names.  Only the headers are looked at, each file's own."""
    frames = []
    for files in files_by_header(spark, path) or [path]:
        raw = _read_text_columns(spark, files)
        renamed = raw.toDF(*flow_headers(raw.columns))
        frames.append(renamed.drop(*[c for c in renamed.columns if c.startswith("_unused_")]))
    return _united(frames)


def read_flow_csv(spark: SparkSession, path: str | Sequence[str], source: str | None = None) -> DataFrame:
    """Parsed rows with ``problems``; filter on it for flows or for the quarantine."""
    raw = read_raw_flows(spark, path)
    if source is None:
        return parse_flows(raw)
    return parse_flows(raw.withColumn("traffic_source_id", F.lit(source)), ["traffic_source_id"])


# --- Labelled dataset files ---------------------------------------------------------------

_FLAG_COLUMNS = (
    "SYN Flag Count", "ACK Flag Count", "FIN Flag Count", "RST Flag Count", "PSH Flag Count", "Fwd PSH Flags", "Bwd PSH Flags",
    "URG Flag Count", "Fwd URG Flags", "Bwd URG Flags", "ECE Flag Count", "CWE Flag Count",
)


def rename_dataset_columns(raw: DataFrame) -> DataFrame:
    """Cleaned, unique long headers; a short header is renamed unless its long form is there too."""
    names = dataset.unique_headers(raw.columns)
    present = set(names)
    final = []
    for name in names:
        target = fv.DATASET_ALIASES.get(name)
        final.append(target if target and target not in present else name)
    return raw.toDF(*final)


def _time_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def map_dataset_flows(raw: DataFrame, time: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Wide dataset rows (text columns) -> the twelve labelled flow columns.

    ``time`` replaces the file's own timestamp, see ``replay_times``.  A time that cannot be read is
    NULL, never the current time, so the job stays repeatable.
    """
    names = set(raw.columns)

    def column(name: str) -> Column:
        return F.col(f"`{name}`") if name in names else F.lit(None).cast("string")

    def address(name: str, decimal: str, default: str) -> Column:
        if name in names:
            return F.coalesce(stripped(column(name)), F.lit(default))
        if decimal in names:
            return decimal_ipv4(column(decimal), default)
        return F.lit(default)

    milliseconds = dataset.duration_ms(column("Flow Duration"))
    protocol = dataset.protocol(column("Protocol"))
    stamp = time if time is not None else dataset.flexible_time(column("Timestamp"))
    state = dataset.classify_failed(
        protocol, column("RST Flag Count"), column("SYN Flag Count"), column("ACK Flag Count"),
        column("Init_Win_bytes_forward"), column("Init_Win_bytes_backward"), milliseconds,
    )
    return raw.select(
        *keep,
        _time_text(stamp).alias("timestamp"),
        address("Source IP", "Src IP dec", fv.DATASET_DEFAULT_SRC_IP).alias("src_ip"),
        address("Destination IP", "Dst IP dec", fv.DATASET_DEFAULT_DST_IP).alias("dst_ip"),
        dataset.clipped_port(column("Source Port")).alias("src_port"),
        dataset.clipped_port(column("Destination Port")).alias("dst_port"),
        protocol.alias("protocol"),
        dataset.packet_total(column("Total Fwd Packets"), column("Total Backward Packets")).alias("packets"),
        dataset.byte_total(column("Total Length of Fwd Packets"), column("Total Length of Bwd Packets")).alias("bytes"),
        milliseconds.alias("duration_ms"),
        dataset.synthesize_flags({n: column(n) for n in _FLAG_COLUMNS if n in names}).alias("flags"),
        state.alias("failed_conn_info"),
        dataset_label(column("Label")).alias("label"),
        (column("Label").isNotNull() & dataset_label_or_null(column("Label")).isNull()).alias("unknown_label"),
    )


def with_file_order(df: DataFrame, name: str = "row_index", by: Sequence[str] = ("_file",), stage: Staging | None = None) -> DataFrame:
    """Add the 0-based line position inside each file (or, without ``by``, over all files in the order of their names).

    Rows of one input split have consecutive numbers in ``_line``.  One row per split is summed up and staged -- its
    first number, and how many rows the splits before it hold -- and gives every row its position; the data itself is
    neither shuffled nor sorted.  Needs the columns ``_file``, ``_block`` and ``_line`` that ``read_in_order`` adds.
    The rows are staged with them (see ``staged``), as a second scan of the files may be split, and so numbered, otherwise.
    """
    # By place: a table cannot hold names that differ in case alone.
    df = staged(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), stage).toDF(*df.columns)
    splits = staged(df.groupBy("_file", "_block").agg(F.min("_line").alias("first"), F.count(F.lit(1)).alias("rows")), stage)
    before = Window.partitionBy(*by).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = staged(splits.select("_file", "_block", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_shift")), stage)
    return df.join(shifts, ["_file", "_block"]).withColumn(name, (F.col("_line") + F.col("_shift")).cast("bigint")).drop("_shift", "_block", "_line")


def read_in_order(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text columns plus the keys of the source order."""
    raw = _read_text_columns(spark, path)
    return raw.select(
        *[F.col(f"`{c}`") for c in raw.columns],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


_ORDER = ("_file", "_block", "_line")


def _renamed(ordered: DataFrame) -> DataFrame:
    data = [c for c in ordered.columns if c not in _ORDER]
    names = rename_dataset_columns(ordered.select(*[F.col(f"`{c}`") for c in data])).columns
    return ordered.toDF(*names, *_ORDER)


def _mapped_in_order(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Labelled flows without times, with the file's own time as text in ``_stamp`` and the keys of the source order.

    Only these few columns of a wide file are staged for its order.
    """
    wide = _renamed(read_in_order(spark, files))
    stamp = F.col("Timestamp") if "Timestamp" in wide.columns else F.lit(None).cast("string")
    return map_dataset_flows(wide.withColumn("_stamp", stamp), F.lit(None).cast("timestamp"), (*_ORDER, "_stamp"))


def _timed(rows: DataFrame, time: Column, keep: Sequence[Column] = ()) -> DataFrame:
    """Flows in their final columns, with their times filled in."""
    return rows.withColumn("timestamp", _time_text(time)).select(*fv.LABELED_FLOW_COLUMNS, "unknown_label", *keep)


_MINUTE_SECOND = r"^[0-9]{1,2}:[0-9]{2}(\.[0-9]+)?$"


def replay_times(df: DataFrame, step_ms: int = 20, by: Sequence[str] = ("_file",), column: str = "Timestamp", stage: Staging | None = None) -> DataFrame:
    """Add ``replay_time``: if every timestamp of a file is only ``mm:ss``, times by row position, else the
    timestamp as read.  Needs ``row_index`` and the time's text in ``column``."""
    short = F.bool_and(stripped(F.col(column)).rlike(_MINUTE_SECOND)).alias("_short")
    files = staged(df.groupBy(*by).agg(short), stage)  # one row per file
    made = replay_timeline(F.col("row_index"), fv.REPLAY_BASE, step_ms)
    time = F.when(F.col("_short"), made).otherwise(dataset.flexible_time(F.col(column)))
    return df.join(files, list(by)).withColumn("replay_time", time).drop("_short")


def replay_timeline(index: Column, base: str, step_ms: int) -> Column:
    """Base time plus ``step_ms`` per row, whole seconds."""
    return F.timestamp_seconds(F.unix_seconds(F.lit(base).cast("timestamp")) + F.floor(index * step_ms / 1000))


def read_cicids_csv(spark: SparkSession, path: str | Sequence[str], stage: Staging | None = None) -> DataFrame:
    """Wide labelled CSVs (both dataset years and the compact archive form, also mixed) -> labelled flows.

    Every file is scanned once.  What is staged for the order of its rows belongs to ``stage`` (see ``staged``).
    """
    flows = []
    for files in files_by_header(spark, path) or [path]:
        wide = _renamed(read_in_order(spark, files))
        if "Timestamp" not in wide.columns:
            flows.append(map_dataset_flows(wide.drop(*_ORDER)))
        else:
            rows = replay_times(with_file_order(_mapped_in_order(spark, files), stage=stage), column="_stamp", stage=stage)
            flows.append(_timed(rows, F.col("replay_time")))
    return _united(flows)


def read_archive_days(
    spark: SparkSession, folder: str, stride: int = 4, files: Sequence[str] = fv.ARCHIVE_DAYS, stage: Staging | None = None
) -> DataFrame:
    """Day files -> labelled flows: every ``stride``-th row in source order, day d on its own replay day.

    A day of several part files has one order over all of them.  Every file is scanned once, see ``read_cicids_csv``.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    days = []
    for day, name in enumerate(files):
        parts = [_mapped_in_order(spark, own) for own in files_by_header(spark, f"{folder}/{name}")]
        if not parts:
            raise FlowFileError(f"{name} has no header line")
        ordered = with_file_order(_united(parts), by=(), stage=stage)
        kept = ordered.filter(F.col("row_index") % stride == 0)
        position = F.floor(F.col("row_index") / stride)
        base = f"2017-07-{3 + day:02d} 00:00:00"
        days.append(_timed(kept, replay_timeline(position, base, 80), [F.lit(day).alias("day")]))
    return _united(days)


# --- Sensor logs --------------------------------------------------------------------------

_SENSOR_FIELDS = (
    "ts", "uid", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "orig_pkts", "resp_pkts", "orig_bytes",
    "resp_bytes", "duration", "history", "conn_state",
)
# Numbers are read as text too, because the log writes ``-`` for a missing one.
SENSOR_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (*_SENSOR_FIELDS, "_corrupt_record")])


def sensor_rows(records: DataFrame) -> DataFrame:
    """Log records -> raw flow rows (text); lines that are no records, or lack time or addresses, are dropped."""
    c = lambda name: F.col(f"`{name}`")
    ts, origin, responder = (sensor.present(c(n)) for n in ("ts", "id.orig_h", "id.resp_h"))
    number = lambda column: column.cast("string")
    total = lambda a, b: number(sensor.whole(c(a)) + sensor.whole(c(b)))
    usable = records.filter(
        c("_corrupt_record").isNull() & origin.isNotNull() & responder.isNotNull() & ts.try_cast("double").isNotNull()
    )
    protocol = F.coalesce(F.nullif(c("proto"), F.lit("")), F.lit("OTHER"))
    extra = [column for column in records.columns if column not in (*_SENSOR_FIELDS, "_corrupt_record")]
    return usable.select(
        *[F.col(f"`{e}`") for e in extra],
        c("uid").alias("uid"),
        F.date_format(epoch_time(ts.try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        c("id.orig_h").alias("src_ip"),
        c("id.resp_h").alias("dst_ip"),
        number(sensor.optional_whole(c("id.orig_p"))).alias("src_port"),
        number(sensor.optional_whole(c("id.resp_p"))).alias("dst_port"),
        F.upper(protocol).alias("protocol"),
        total("orig_pkts", "resp_pkts").alias("packets"),
        total("orig_bytes", "resp_bytes").alias("bytes"),
        number(sensor.milliseconds(c("duration"))).alias("duration_ms"),
        sensor.history_flags(c("history")).alias("flags"),
        sensor.connection_state(c("conn_state")).alias("failed_conn_info"),
    )


def read_zeek_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Connection log (JSON lines) -> raw flow rows."""
    records = spark.read.schema(SENSOR_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return sensor_rows(records)


# --- Label timelines and labelled flows ------------------------------------------------------


def read_label_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed intervals ``start,end,label``, checked: zoned times, end after start, known labels, not empty."""
    ordered = read_in_order(spark, path)
    names = [c.lstrip("﻿") for c in ordered.columns[:-3]]
    if sorted(names) != ["end", "label", "start"]:
        raise FlowFileError("a timeline has exactly the columns start,end,label")
    raw = with_file_order(ordered.toDF(*names, "_file", "_block", "_line"), "line_no").drop("_file")
    parsed = raw.select(
        iso_time(stripped(F.col("start"))).alias("start"),
        iso_time(stripped(F.col("end"))).alias("end"),
        timeline_label(F.col("label")).alias("label"),
        "line_no",
        F.col("label").alias("_given"),
    )
    found = parsed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("start").isNull() | F.col("end").isNull()).alias("times"),
        F.count_if(F.col("end") <= F.col("start")).alias("order"),
        F.min(F.when(F.col("label").isNull(), F.col("_given"))).alias("unknown"),
    ).first()
    if not found.rows:
        raise FlowFileError("the timeline is empty")
    if found.times:
        raise FlowFileError("timeline times must be ISO-8601 with a timezone")
    if found.unknown is not None:
        raise FlowFileError(f"Unsupported label {found.unknown!r} in the timeline")
    if found.order:
        raise FlowFileError("every timeline interval must end after it starts")
    return parsed.drop("_given")


def labeled_columns(flows: DataFrame) -> DataFrame:
    """Typed flows -> the twelve text columns of a labelled file."""
    state = F.when(F.col("failed_connection"), "SYN_NO_ACK").when(~F.col("failed_connection"), "CLEAN").otherwise("NA")
    if "failed_conn_info" in flows.columns:
        state = F.col("failed_conn_info")
    return flows.select(
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "src_ip", "dst_ip", "src_port", "dst_port",
        "protocol", F.col("packet_count").alias("packets"), F.col("byte_count").alias("bytes"), "duration_ms",
        F.coalesce("tcp_flags", F.lit("NONE")).alias("flags"), state.alias("failed_conn_info"), "label",
    )


def write_labeled_flows(labeled: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Write the twelve labelled columns as CSV (with header) or Parquet; refuses an empty result."""
    rows = labeled.select(*fv.LABELED_FLOW_COLUMNS)
    if rows.isEmpty():
        raise FlowFileError("no labelled flows to write: check times, intervals and paths")
    writer = rows.write.mode(mode)
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path)
