"""Labels of flows and windows, chronological splits and dataset quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions.labels import label_severity, label_stage, stage_name
from flowcast.functions.risk import ratio
from flowcast.operators.features import window_features
from flowcast.operators.timeline import explode_range, time_chunk, with_carry, with_previous, with_row_index
from flowcast.operators.windows import SOURCE, window_start

_DAY_MICROS = 86_400_000_000
_HOUR_MICROS = 3_600_000_000


def label_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def effective_intervals(timeline: DataFrame) -> DataFrame:
    """Disjoint intervals that answer like "the first interval by start wins".

    Ordered by (start, file order), an earlier interval that still covers a later one's start wins up
    to its own end.  So interval i is in force exactly on [max(start, largest earlier end), end).
    """
    micros = timeline.select(
        F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "line_no", "label"
    )
    chunk = F.floor(F.col("start_us") / _DAY_MICROS).cast("bigint")
    order = [F.col("start_us"), F.col("line_no")]
    carried = with_carry(micros, (), order, chunk, {"max:_before": F.max("end_us")})
    local = Window.partitionBy("_chunk").orderBy("_position").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("_before"), F.max("end_us").over(local))
    return (
        carried.withColumn("from_us", F.greatest(F.col("start_us"), covered))
        .filter(F.col("from_us") < F.col("end_us"))
        .select("from_us", "end_us", "label")
    )


def label_interval_join(flows: DataFrame, timeline: DataFrame, benign_fill: bool = False) -> DataFrame:
    """Label each flow by the interval ``[start, end)`` that holds its time; uncovered flows are dropped
    or, with ``benign_fill``, count as BENIGN.

    Intervals are disjoint and matched by hour, so a flow meets the few intervals of its hour.  Spark broadcasts a small
    timeline by itself, and splits an hour that holds too many flows.  A long interval is cut into hours block by block.
    """
    intervals = effective_intervals(timeline)
    keyed = flows.withColumn("_us", F.unix_micros("observed_at")).withColumn(
        "_hour", F.floor(F.col("_us") / _HOUR_MICROS).cast("bigint")
    )
    first = F.floor(F.col("from_us") / _HOUR_MICROS).cast("bigint")
    last = F.floor((F.col("end_us") - 1) / _HOUR_MICROS).cast("bigint")
    hourly = explode_range(intervals.withColumnRenamed("label", "_label"), first, last, "_hour")
    inside = (keyed["_hour"] == hourly["_hour"]) & (F.col("_us") >= F.col("from_us")) & (F.col("_us") < F.col("end_us"))
    joined = keyed.join(hourly, inside, "left" if benign_fill else "inner")
    label = F.coalesce("_label", F.lit("BENIGN")) if benign_fill else F.col("_label")
    keep = [keyed[c] for c in flows.columns if c != "label"]
    return joined.select(*keep, label.alias("label"))


def coverage_counts(flows: DataFrame, labeled: DataFrame) -> DataFrame:
    """Accepted and uncovered flows of ``label_interval_join``."""
    total = flows.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(0).cast("bigint").alias("accepted"))
    accepted = labeled.agg(F.count(F.lit(1)).alias("accepted")).select(F.lit(0).cast("bigint").alias("n"), "accepted")
    return total.unionByName(accepted).agg(
        F.sum("accepted").alias("accepted"), (F.sum("n") - F.sum("accepted")).alias("uncovered")
    )


def window_labels(flows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Highest stage of the flows in each window; any stage but 0 is a risk."""
    stages = flows.select(*by, window_start(seconds).alias("window_start"), label_stage(F.coalesce("label", F.lit("BENIGN"))).alias("stage"))
    worst = stages.groupBy(*by, "window_start").agg(F.max("stage").alias("stage"))
    return worst.withColumns(
        {"risk": (F.col("stage") != 0).cast("int"), "stage_name": stage_name(F.col("stage"))}
    )


def labeled_windows(flows: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Feature vector, risk and stage, one row per window."""
    return window_features(flows, seconds, by).join(window_labels(flows, seconds, by), [*by, "window_start"])


def horizon_labels(
    epochs: DataFrame, flows: DataFrame, horizon: int = 300, step: int = 60, by: Sequence[str] = SOURCE
) -> DataFrame:
    """For each epoch t (column ``epoch``, a multiple of ``step`` seconds): does an attack start in
    ``(t, t + horizon]``, how severe, of which classes.

    An attack at time x labels the epochs in ``[x - horizon, x)``.  All attacks between two grid
    points label the same epochs, so they are reduced to one row per (grid cell, class) before the
    epochs are generated; the rest is an equi-join.
    """
    step_us, horizon_us = step * 1_000_000, horizon * 1_000_000
    attacks = flows.filter(F.col("label") != "BENIGN")
    cell = F.ceil(F.unix_micros("observed_at") / step_us).cast("bigint") * step_us
    last = cell - step_us
    first = F.ceil((F.unix_micros("observed_at") - horizon_us) / step_us).cast("bigint") * step_us
    reduced = attacks.select(*by, first.alias("_first"), last.alias("_last"), "label").distinct()
    hits = reduced.select(*by, F.explode(F.sequence("_first", "_last", F.lit(step_us))).alias("_t"), "label")
    targets = hits.groupBy(*by, "_t").agg(
        F.max(label_severity(F.col("label"))).alias("_severity"), F.sort_array(F.collect_set("label")).alias("_classes")
    )
    keyed = epochs.withColumn("_t", F.unix_micros("epoch"))
    return keyed.join(targets, [*by, "_t"], "left").select(
        *[F.col(c) for c in epochs.columns],
        F.col("_severity").isNotNull().cast("int").alias("target_binary"),
        F.coalesce("_severity", F.lit(0)).alias("target_stage"),
        F.coalesce("_classes", F.array().cast("array<string>")).alias("attack_classes"),
    )


# --- Splits -----------------------------------------------------------------------------


def chrono_split(
    windows: DataFrame, seconds: int = 60, test_fraction: float = 0.5, purge: int = fv.HISTORY_WINDOWS, by: Sequence[str] = SOURCE
) -> DataFrame:
    """Add ``row_index`` and ``split``: the past trains, the future tests, ``purge`` windows between are dropped."""
    chunk = time_chunk(F.col("window_start"), seconds)
    indexed = with_row_index(windows, by, "window_start", chunk, total="_total")
    boundary = F.floor(F.col("_total") * (F.lit(1.0) - F.lit(test_fraction)))
    split = (
        F.when(F.col("row_index") >= boundary, "test")
        .when(F.col("row_index") >= F.greatest(boundary - purge, F.lit(0)), "purged")
        .otherwise("train")
    )
    return indexed.withColumn("split", split).drop("_total")


def embargo_split(windows: DataFrame, split_time, window_seconds: int = 60, horizon: int = 300) -> DataFrame:
    """Split at a point in time.  Training windows whose horizon crosses it, and the windows less than
    window + horizon after it, are purged."""
    boundary = F.unix_seconds(F.lit(split_time).cast("timestamp"))
    end = F.unix_seconds("window_end")
    split = (
        F.when(end + horizon <= boundary, "train")
        .when(end >= boundary + window_seconds + horizon, "test")
        .otherwise("purged")
    )
    return windows.withColumn("split", split)


def dataset_preflight(split: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """Window counts per part; ready only if both parts hold benign and attack windows."""

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    risk, train, test = F.col("risk") == 1, F.col("split") == "train", F.col("split") == "test"
    counted = split.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        n(risk).alias("attack_windows"),
        n(~risk).alias("benign_windows"),
        n(train).alias("train_windows"),
        n(F.col("split") == "purged").alias("purged_windows"),
        n(test).alias("held_out_windows"),
        ((n(train & risk) > 0) & (n(train & ~risk) > 0)).alias("_train_ok"),
        ((n(test & risk) > 0) & (n(test & ~risk) > 0)).alias("_test_ok"),
    )
    message = (
        F.when(~F.col("_train_ok"), "training part lacks benign or attack windows")
        .when(~F.col("_test_ok"), "held-out part lacks benign or attack windows")
        .otherwise("both parts hold benign and attack windows")
    )
    return counted.withColumns({"ready": F.col("_train_ok") & F.col("_test_ok"), "message": message}).drop(
        "_train_ok", "_test_ok"
    )


def scaling_stats(split: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """Mean and population deviation of every feature over the training part only, one row per source."""
    aggregates = []
    for name in fv.FEATURE_NAMES:
        value = F.when(F.col("split") == "train", F.col(name).cast("double"))
        aggregates += [F.avg(value).alias(f"_mean_{name}"), F.stddev_pop(value).alias(f"_std_{name}")]
    raw = split.groupBy(*by).agg(*aggregates)

    def spread(name: str) -> Column:
        return F.when(F.col(f"_std_{name}") < 1e-6, 1.0).otherwise(F.col(f"_std_{name}")).alias(name)

    return raw.select(
        *by,
        F.struct(*[F.col(f"_mean_{n}").alias(n) for n in fv.FEATURE_NAMES]).alias("mean"),
        F.struct(*[spread(n) for n in fv.FEATURE_NAMES]).alias("std"),
    )


def standardized(features: DataFrame, stats: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """Features as deviations from the training mean, in training deviations of their own source."""
    joined = features.join(stats, list(by))
    scaled = {n: (F.col(n) - F.col(f"mean.{n}")) / F.col(f"std.{n}") for n in fv.FEATURE_NAMES}
    return joined.withColumns(scaled).drop("mean", "std")


def class_weights(split: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """Positive weight max(negatives / positives, 1) and balanced weights n / (2 n_c) of the training part."""
    train = split.filter(F.col("split") == "train")
    counted = train.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("risk").cast("bigint")).alias("positives")
    )
    negatives = F.col("windows") - F.col("positives")
    weight = F.greatest(ratio(negatives, F.col("positives")), F.lit(1.0))

    def balanced(n: Column) -> Column:
        return F.when(n > 0, F.col("windows") / (n * 2.0))

    return counted.withColumns(
        {
            "negatives": negatives,
            "pos_weight": weight,
            "attack_weight": balanced(F.col("positives")),
            "benign_weight": balanced(negatives),
        }
    )


def history_sequences(
    windows: DataFrame, seconds: int = 60, length: int = fv.HISTORY_WINDOWS, by: Sequence[str] = SOURCE
) -> DataFrame:
    """Training samples: ``length`` consecutive windows (oldest first) and the window after them."""
    chunk = time_chunk(F.col("window_start"), seconds)
    df = with_previous(windows, by, "window_start", ["window_start", *fv.FEATURE_NAMES], length, chunk, "history")
    return df.filter(F.size("history") == length)


def latest_history(features: DataFrame, length: int = fv.HISTORY_WINDOWS, by: Sequence[str] = SOURCE) -> DataFrame:
    """The last ``length`` windows of each source that has that many (serving)."""
    newest_first = Window.partitionBy(*by).orderBy(F.desc("window_start"))
    recent = features.withColumn("_age", F.row_number().over(newest_first)).filter(F.col("_age") <= length)
    entry = F.struct("window_start", *fv.FEATURE_NAMES)
    rows = recent.groupBy(*by).agg(
        F.sort_array(F.collect_list(entry)).alias("history"),
        F.max("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
    )
    return rows.filter(F.size("history") == length)


def leakage_check(flows: DataFrame, cut, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Windows ending by ``cut`` whose features change when later flows are taken away: must be empty."""
    names = [*by, "window_start", *fv.FEATURE_NAMES]
    moment = F.lit(cut).cast("timestamp")
    full = window_features(flows, seconds, by).filter(F.col("window_end") <= moment).select(*names)
    past = window_features(flows.filter(F.col("observed_at") < moment), seconds, by)
    past = past.filter(F.col("window_end") <= moment).select(*names)
    return full.exceptAll(past).unionByName(past.exceptAll(full))
