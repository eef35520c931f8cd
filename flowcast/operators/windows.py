"""Flows -> event-time windows, and the reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions.addresses import is_private_ip
from flowcast.operators.timeline import explode_range, time_chunk, with_previous

SOURCE = ("traffic_source_id",)
_FIVE_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def window_start(seconds: int, slide: int | None = None, time: str = "observed_at") -> Column:
    """Start of the half-open ``[start, end)`` window, aligned to the epoch."""
    size = f"{seconds} seconds"
    window = F.window(time, size, f"{slide} seconds") if slide else F.window(time, size)
    return window["start"]


def _end(seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds("window_start") + seconds)


def _totals(windowed: DataFrame, by: Sequence[str], seconds: int) -> DataFrame:
    """Distinct five-tuples (NULL is a value, hence the struct), packets and bytes per window."""
    return (
        windowed.groupBy(*by, "window_start")
        .agg(
            F.count_distinct(F.struct(*_FIVE_TUPLE)).alias("flow_count"),
            F.sum("packet_count").alias("packet_count"),
            F.sum("byte_count").alias("byte_count"),
        )
        .withColumn("window_end", _end(seconds))
    )


def flow_windows(flows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """One row per non-empty fixed window."""
    return _totals(flows.withColumn("window_start", window_start(seconds)), by, seconds)


def scope_key(scope: str) -> Column:
    """What a window is about: a whole source, one destination host or one five-tuple."""
    if scope == "source":
        return F.col("traffic_source_id")
    if scope == "host":
        return F.col("dst_ip")
    if scope == "flow":
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _FIVE_TUPLE])
    raise ValueError(f"unknown window scope {scope!r}")


def scoped_windows(flows: DataFrame, scope: str = "source", seconds: int = 60) -> DataFrame:
    keyed = flows.withColumn("scope_type", F.lit(scope)).withColumn("scope_key", scope_key(scope))
    return flow_windows(keyed, seconds, ("traffic_source_id", "scope_type", "scope_key"))


def sliding_windows(flows: DataFrame, profile: str = "macro", by: Sequence[str] = SOURCE) -> DataFrame:
    """Overlapping windows of a named profile.

    A flow lies in ``size / slide`` windows.  Flows are first reduced to one row per slide pane and
    five-tuple, so that only these partial rows -- not the flows -- are multiplied.
    """
    size, slide, horizon = fv.WINDOW_PROFILES[profile]
    panes = (
        flows.withColumn("pane", window_start(slide))
        .groupBy(*by, "pane", *_FIVE_TUPLE)
        .agg(F.sum("packet_count").alias("packet_count"), F.sum("byte_count").alias("byte_count"))
    )
    windowed = panes.withColumn("window_start", window_start(size, slide, "pane"))
    return _totals(windowed, by, size).withColumn("horizon_seconds", F.lit(horizon))


def incomplete_windows(windows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """The empty windows between the first and the last one of a source, with the reason.

    Found from the gap before each window, so only missing windows are generated, a long gap in blocks.
    """
    chunk = time_chunk(F.col("window_start"), seconds)
    lagged = with_previous(windows.select(*by, "window_start"), by, "window_start", ["window_start"], 1, chunk)
    before = F.unix_seconds(F.col("_previous")[0]["window_start"])
    gaps = lagged.filter(F.size("_previous") == 1).select(
        *by, before.alias("_before"), (F.floor((F.unix_seconds("window_start") - before) / seconds) - 1).alias("_missing")
    )
    missing = explode_range(gaps, F.lit(1), F.col("_missing"), "_n").withColumn("s", F.col("_before") + F.col("_n") * seconds)
    return missing.select(
        *by,
        F.timestamp_seconds("s").alias("window_start"),
        F.timestamp_seconds(F.col("s") + seconds).alias("window_end"),
        F.lit(False).alias("is_complete"),
        F.array(F.lit("no_flows_reject")).alias("missing_fields"),
    )


def latest_window(windows: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """The newest window per source; a map-side maximum, no sort."""
    others = [c for c in windows.columns if c not in by]
    newest = F.max_by(F.struct(*others), "window_start").alias("newest")
    return windows.groupBy(*by).agg(newest).select(*by, *[F.col("newest")[c].alias(c) for c in others])


def _in_latest_window(flows: DataFrame, seconds: int, by: Sequence[str]) -> DataFrame:
    """Flows of each source's newest window, matched on the floored start instead of a time range."""
    windowed = flows.withColumn("window_start", window_start(seconds))
    newest = flows.groupBy(*by).agg(F.max("observed_at").alias("observed_at"))
    newest = newest.select(*by, window_start(seconds).alias("window_start"))
    return windowed.join(newest, [*by, "window_start"])


def window_flow_range_join(flows: DataFrame, windows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Flows inside given windows ``[start, end)``, as an equi-join on (source, floored start)."""
    starts = windows.select(*by, "window_start", "window_end").distinct()
    return flows.withColumn("window_start", window_start(seconds)).join(starts, [*by, "window_start"])


def top_destinations(flows: DataFrame, seconds: int = 60, limit: int = 5, by: Sequence[str] = SOURCE) -> DataFrame:
    """Destinations with the most bytes in each source's newest window; ties by address, port, protocol."""
    totals = (
        _in_latest_window(flows, seconds, by)
        .groupBy(*by, "window_start", "dst_ip", "dst_port", "protocol")
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum("packet_count").alias("packets"),
            F.sum("byte_count").alias("bytes"),
        )
    )
    order = [F.desc("bytes"), F.asc("dst_ip"), F.asc_nulls_first("dst_port"), F.asc("protocol")]
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def host_entities(flows: DataFrame, seconds: int = 60, known: DataFrame | None = None, by: Sequence[str] = SOURCE) -> DataFrame:
    """The busiest destination of each source's newest window, merged with the hosts known before."""
    seen = F.timestamp_seconds(F.unix_seconds("window_start") + seconds)
    busiest = top_destinations(flows, seconds, 1, by).select(
        *by,
        F.col("dst_ip").alias("ip_address"),
        entity_type(F.col("dst_ip")).alias("entity_type"),
        seen.alias("first_seen_at"),
        seen.alias("last_seen_at"),
    )
    hosts = busiest if known is None else known.unionByName(busiest)
    return hosts.groupBy(*by, "ip_address").agg(
        F.min_by("entity_type", "first_seen_at").alias("entity_type"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def entity_type(address: Column) -> Column:
    private = is_private_ip(address)
    return F.when(private.isNull(), "unknown").when(private, "internal").otherwise("external")


def traffic_overview(windows: DataFrame, features: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """Timeline rows of every source with its window count; the newest row also holds the features as JSON."""
    joined = window_feature_join(windows, features, by)
    counts = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("window_count"), F.max("window_start").alias("_newest")
    )
    newest = F.col("window_start") == F.col("_newest")
    return joined.join(counts, list(by)).select(
        *by,
        "window_end",
        F.col("packet_count").alias("packets"),
        F.col("byte_count").alias("bytes"),
        F.col("flow_count").alias("flows"),
        "window_count",
        F.when(newest, F.to_json(F.struct(*[F.col(f"features.{n}") for n in fv.FEATURE_NAMES]))).alias("latest_features"),
    )


def window_feature_join(windows: DataFrame, features: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """Windows with their one feature row; the vector is one struct because both sides count flows."""
    vectors = features.select(*by, "window_start", F.struct(*fv.FEATURE_NAMES).alias("features"))
    return windows.join(vectors, [*by, "window_start"])


def timeline_summary(windows: DataFrame, limit: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Flows, peak packets and newest packets over the last ``limit`` windows of each source."""
    newest_first = Window.partitionBy(*by).orderBy(F.desc("window_start"))
    recent = windows.withColumn("_age", F.row_number().over(newest_first)).filter(F.col("_age") <= limit)
    return recent.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("flow_count").alias("flows"),
        F.max("packet_count").alias("peak_packets"),
        F.max_by("packet_count", "window_start").alias("latest_packets"),
    )


def page_windows(windows: DataFrame, source: str, after=None, limit: int = 200) -> DataFrame:
    """One page of a source's windows, oldest first; ``next_cursor`` is set only if more remain.

    Reads ``limit + 1`` rows in cursor order (a bounded top-k), never the whole timeline.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rest = windows.filter(F.col("traffic_source_id") == source)
    if after is not None:
        rest = rest.filter(F.col("window_start") > F.lit(after))
    peek = rest.orderBy("window_start").limit(limit + 1)
    return _page(peek, [F.asc("window_start")], limit, F.col("window_start"))


def _page(peek: DataFrame, order: list[Column], limit: int, cursor: Column) -> DataFrame:
    """Cut a ``limit + 1`` row peek to the page.  The peek is bounded by the page size."""
    position = F.row_number().over(Window.orderBy(*order))
    size = F.count(F.lit(1)).over(Window.partitionBy())
    numbered = peek.withColumn("_at", position).withColumn("_n", size).filter(F.col("_at") <= limit)
    more = (F.col("_n") > limit) & (F.col("_at") == limit)
    return numbered.withColumn("next_cursor", F.when(more, cursor)).drop("_at", "_n")


def pipeline_counts(tables: dict[str, DataFrame], alerts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Row counts per table, alerts per status (zeros included) and rule-based predictions."""
    one = next(iter(tables.values())).sparkSession
    counts = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("item"), "rows")
        counts = row if counts is None else counts.unionByName(row)
    statuses = one.createDataFrame([(s,) for s in fv.STATUSES], "status string")
    by_status = (
        statuses.join(alerts.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left")
        .select(F.concat(F.lit("alerts_"), "status").alias("item"), F.coalesce("n", F.lit(0)).alias("rows"))
    )
    fallback = predictions.agg(F.count_if(F.col("is_fallback")).alias("rows")).select(
        F.lit("fallback_predictions").alias("item"), "rows"
    )
    return counts.unionByName(by_status).unionByName(fallback)
