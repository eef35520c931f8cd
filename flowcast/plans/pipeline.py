"""End-to-end plans over stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.operators import alerts, forecasts, labeling, models, windows
from flowcast.operators.windows import SOURCE
from flowcast.operators.normalize import normalize_flows
from flowcast.session import Staging
from flowcast.sources import flow_files
from flowcast.sources.flow_files import read_raw_flows
from flowcast.sources.tables import load_flows, table_or_none, upsert_dates
from flowcast.streaming import live


def ingest_csv(spark: SparkSession, path: str | Sequence[str], source: str, root: str, loaded_at) -> dict:
    """Load one CSV upload; an identical completed load of the source is skipped."""
    return load_flows(read_raw_flows(spark, path), source, f"{root}/flows", f"{root}/loads", loaded_at)


def label_capture(spark: SparkSession, log: str, timeline: str, out: str, benign_fill: bool = False, fmt: str = "csv") -> dict[str, int]:
    """Sensor log and reviewed intervals -> a labelled file with each record's connection state; returns the counts."""
    flows = normalize_flows(flow_files.read_zeek_json(spark, log), ["failed_conn_info"])
    labeled = labeling.label_interval_join(flows, flow_files.read_label_timeline(spark, timeline), benign_fill)
    counts = labeling.coverage_counts(flows, labeled).first().asDict()
    flow_files.write_labeled_flows(flow_files.labeled_columns(labeled), out, fmt)
    return counts


def build_windows(spark: SparkSession, root: str, seconds: int = 60) -> int:
    """Windows and features of the loads that were not built yet; returns how many loads that are.

    Only the windows that these loads touch are made anew, from all of their flows, and the features of the up to
    four windows after each.  Tables are partitioned by date first, so other dates are neither read nor rewritten.
    A load counts as built once all is written; a build that died is repeated and leaves the same tables.
    """
    known, built = table_or_none(spark, f"{root}/loads"), table_or_none(spark, f"{root}/built")
    if known is None:
        return 0
    fresh = known.filter("accepted_rows > 0").select("load_id").distinct()
    if built is not None:
        fresh = fresh.join(built.filter(F.col("seconds") == seconds), "load_id", "left_anti")
    new = [r.load_id for r in fresh.collect()]  # one name per load since the last build
    if not new:
        return 0
    flows = spark.read.parquet(f"{root}/flows")
    with Staging(spark) as stage:
        touched = live.touched_windows(stage, flows.filter(F.col("load_id").isin(new)), seconds)
        own = live.flows_of_windows(touched, lambda dates: flows.filter(F.col("flow_date").isin(dates)), seconds)
        made = stage.put(windows.flow_windows(own, seconds).withColumn("window_date", F.to_date("window_start")))
        upsert_dates(made, f"{root}/windows", [*SOURCE, "window_start"], "window_date", SOURCE)
        live.refresh_features(stage, touched, own, f"{root}/base", f"{root}/features", seconds)
    done = spark.createDataFrame([(load_id, seconds) for load_id in new], "load_id string, seconds int")
    done.coalesce(1).write.mode("append").parquet(f"{root}/built")
    return len(new)


def forecast_and_alert(
    spark: SparkSession, root: str, model: models.ForecastModel | None = None, seconds: int = 60, min_score: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Predictions and alerts of every source's newest window, from the learned model where usable."""
    features = spark.read.parquet(f"{root}/features")
    learned = models.learned_forecasts(features, model) if model is not None else None
    predicted = alerts.predictions(forecasts.forecast_policy(features, learned))
    hosts = windows.host_entities(spark.read.parquet(f"{root}/flows"), seconds)
    return predicted, alerts.alerts(predicted, hosts, min_score=min_score)


def train(flows: DataFrame, seconds: int = 60, test_fraction: float = 0.5) -> tuple[models.ForecastModel, DataFrame]:
    """Labelled windows, chronological split, class check, fits; returns the model and the split.

    The split is written out once, since every fit reads it: see ``cut_lineage``.
    """
    from flowcast.session import cut_lineage

    split = cut_lineage(labeling.chrono_split(labeling.labeled_windows(flows, seconds), seconds, test_fraction))
    totals = labeling.dataset_preflight(split, by=()).first()
    if not totals.ready:
        raise ValueError(totals.message)
    return models.fit_model(split, seconds), split
