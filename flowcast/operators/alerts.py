"""Predictions, alerts and their triage history as batch jobs over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions.labels import lookup
from flowcast.operators.windows import SOURCE, _page

TRIAGE_CHUNK = 1024


def stable_id(*parts: Column | str) -> Column:
    """Key derived from content, so that a re-run writes the same rows."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


def predictions(forecasts: DataFrame, steps: int = fv.FORECAST_STEPS, by: Sequence[str] = SOURCE) -> DataFrame:
    """One row per forecast: the forecast interval ``[end, end + steps minutes)`` and the peak."""
    return forecasts.select(
        *by,
        stable_id(*by, F.unix_seconds("window_end"), "model_name", "model_version").alias("prediction_id"),
        F.col("window_start").alias("observation_window_start"),
        F.col("window_end").alias("forecast_window_start"),
        F.timestamp_seconds(F.unix_seconds("window_end") + steps * 60).alias("forecast_window_end"),
        F.bround(F.col("peak_risk") * 100, 2).cast("decimal(5,2)").alias("risk_score"),
        F.col("peak_risk_level").alias("risk_level"),
        "predicted_attack_type",
        F.col("peak_risk_stage").alias("predicted_stage"),
        F.col("confidence_score").cast("decimal(4,3)").alias("confidence_score"),
        "is_fallback", "is_uncertain", "is_ood", "model_name", "model_version",
        F.to_json("contributors").alias("explanation_json"),
    )


def recommended_actions(stage: Column, is_ood: Column, is_uncertain: Column, is_fallback: Column) -> Column:
    """Actions for the stage, with the notes on the forecast's quality in front."""
    notes = F.array(
        F.when(is_fallback, fv.FALLBACK_ACTION),
        F.when(is_uncertain, fv.UNCERTAIN_ACTION),
        F.when(is_ood, fv.OOD_ACTION),
    )
    actions = None
    for name, texts in fv.STAGE_ACTIONS.items():
        listed = F.array(*[F.lit(text) for text in texts])
        actions = F.when(stage == name, listed) if actions is None else actions.when(stage == name, listed)
    default = F.array(*[F.lit(text) for text in fv.STAGE_ACTIONS["Benign"]])
    return F.concat(F.array_compact(notes), actions.otherwise(default))


def alerts(
    predicted: DataFrame, hosts: DataFrame | None = None, created_at: Column | None = None,
    min_score: float | None = None, steps: int = fv.FORECAST_STEPS, by: Sequence[str] = SOURCE,
) -> DataFrame:
    """One open alert per prediction (from ``min_score`` on, if given).

    Severity follows the risk level, but an uncertain forecast is never critical.  ``hosts`` gives the
    target host per source.
    """
    chosen = predicted if min_score is None else predicted.filter(F.col("risk_score") >= min_score)
    if hosts is not None:
        target = hosts.select(*by, F.col("ip_address").alias("target_host"))
        chosen = chosen.join(target, list(by), "left")
    else:
        chosen = chosen.withColumn("target_host", F.lit(None).cast("string"))
    capped = F.col("is_uncertain") & (F.col("risk_level") == "critical")
    stage = F.coalesce("predicted_stage", F.lit("network"))
    qualifier = F.when(F.col("is_uncertain"), " (low confidence)").otherwise("")
    return chosen.select(
        stable_id("prediction_id", F.lit("alert")).alias("alert_id"),
        "prediction_id",
        *by,
        "target_host",
        F.concat(F.lit("Forecasted "), stage, F.lit(" risk"), qualifier).alias("title"),
        F.format_string(
            f"The model forecasts %s risk (%.0f/100) in the next {steps} minutes.", F.col("risk_level"), F.bround(F.col("risk_score").cast("double"), 0)
        ).alias("summary"),
        F.when(capped, "high").otherwise(F.col("risk_level")).alias("severity"),
        F.lit("open").alias("status"),
        recommended_actions(
            F.col("predicted_stage"), F.col("is_ood"), F.col("is_uncertain"), F.col("is_fallback")
        ).alias("recommended_actions"),
        (created_at if created_at is not None else F.col("forecast_window_start")).alias("created_at"),
    )


# --- Triage -------------------------------------------------------------------------------


# A map "from each status, where does it lead" is one number: the digit at a status's place is the status it leads to.
_DIGIT = (len(fv.STATUSES) - 1).bit_length()
_ONES = (1 << _DIGIT) - 1
_STAY = sum(i << (_DIGIT * i) for i in range(len(fv.STATUSES)))


def _request_map(requested: Column) -> Column:
    """What a request does to each status: the requested one where the move is allowed, else the same."""
    result = F.lit(_STAY)
    for target, name in enumerate(fv.STATUSES):
        ends = [target if name in fv.TRANSITIONS.get(status, ()) else i for i, status in enumerate(fv.STATUSES)]
        result = F.when(requested == name, F.lit(sum(end << (_DIGIT * i) for i, end in enumerate(ends)))).otherwise(result)
    return result


def _applied(code: Column, status: Column) -> Column:
    return F.call_function("shiftright", code, status * _DIGIT).bitwiseAND(F.lit(_ONES))


def _then(first: Column, second: Column) -> Column:
    """The map of one walk after another."""
    digits = [F.shiftleft(_applied(second, F.shiftright(first, _DIGIT * i).bitwiseAND(F.lit(_ONES))), _DIGIT * i) for i in range(len(fv.STATUSES))]
    total = digits[0]
    for digit in digits[1:]:
        total = total.bitwiseOR(digit)
    return total


def _walked(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Add ``_walk``, the composed map from the first row of each (alert, ``_chunk``) group up to and with the row.

    By doubling: after every step a row's map spans twice as many rows.  All steps share one order of the group.
    """
    group = Window.partitionBy("alert_id", "_chunk").orderBy(order)
    walked, span = rows.withColumn("_walk", F.col("_map")), 1
    while span < size:
        walked = walked.withColumn("_earlier", F.lag("_walk", span, _STAY).over(group)).withColumn("_walk", _then(F.col("_earlier"), F.col("_walk")))
        span *= 2
    return walked.drop("_earlier")


def _first_status(maps: DataFrame, start: int, chunk: int, groups: int) -> DataFrame:
    """(alert_id, place, first) for the maps (alert_id, place, _map) of an alert's groups: the status each starts from.

    ``groups`` bounds the places.  Too many for one chunk are chunked in turn, so no task has all maps of an alert.
    """
    chunk = max(chunk, 2)
    walked = _walked(maps.withColumn("_chunk", F.floor(F.col("place") / chunk).cast("bigint")), "place", chunk)
    group = Window.partitionBy("alert_id", "_chunk").orderBy("place")
    before = F.lag("_walk", 1, _STAY).over(group)
    if groups <= chunk:
        return walked.withColumn("_before", before).select("alert_id", "place", _applied(F.col("_before"), F.lit(start)).alias("first"))
    wholes = walked.groupBy("alert_id", F.col("_chunk").alias("place")).agg(F.max_by("_walk", "place").alias("_map"))
    firsts = _first_status(wholes, start, chunk, -(-groups // chunk)).select("alert_id", F.col("place").alias("_chunk"), F.col("first").alias("_first"))
    return walked.withColumn("_before", before).join(firsts, ["alert_id", "_chunk"]).select("alert_id", "place", _applied(F.col("_before"), F.col("_first")).alias("first"))


def triage_status(requests: DataFrame, start: str = "open", chunk: int = TRIAGE_CHUNK) -> DataFrame:
    """Replay status requests (``alert_id``, unique ``seq``, ``requested_status``, ...) in order.

    Adds ``from_status``, ``accepted``, ``status`` after the request, and the statuses ``allowed``
    from ``from_status``.

    A replay is a walk through four states, and walks compose: a request is a map "from each status, where
    does it lead", and so is any number of them in a row.  Requests are composed inside chunks, chunks inside
    chunks of chunks, as many levels as the numbers ask for; then each chunk learns its first status from the
    level above.  So an alert with very many requests never sits in one group.
    """
    span = requests.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    low, high = span.low or 0, span.high or 0
    placed = requests.withColumn("_chunk", F.floor((F.col("seq") - F.lit(low)) / chunk).cast("bigint")).withColumn("_map", _request_map(F.col("requested_status")))
    walked = _walked(placed, "seq", chunk)
    wholes = walked.groupBy("alert_id", F.col("_chunk").alias("place")).agg(F.max_by("_walk", "seq").alias("_map"))
    firsts = _first_status(wholes, fv.STATUSES.index(start), chunk, (high - low) // chunk + 1)
    group = Window.partitionBy("alert_id", "_chunk").orderBy("seq")
    before = walked.withColumn("_before", F.lag("_walk", 1, _STAY).over(group))
    joined = before.join(firsts.select("alert_id", F.col("place").alias("_chunk"), F.col("first").alias("_first")), ["alert_id", "_chunk"])
    joined = joined.withColumn("_from", _applied(F.col("_before"), F.col("_first")))
    name = lambda code: F.element_at(F.array(*map(F.lit, fv.STATUSES)), code.cast("int") + 1)
    named = joined.withColumns({"from_status": name(F.col("_from")), "status": name(_applied(F.col("_map"), F.col("_from")))})
    return named.select(
        *requests.columns, "from_status", (F.col("from_status") != F.col("status")).alias("accepted"), "status",
        F.array_join(F.sort_array(lookup_allowed(F.col("from_status"))), ",").alias("allowed"),
    )


def lookup_allowed(status: Column) -> Column:
    """Statuses an alert may move to."""
    table = {s: F.array(*[F.lit(t) for t in targets]) for s, targets in fv.TRANSITIONS.items()}
    result = None
    for name, targets in table.items():
        result = F.when(status == name, targets) if result is None else result.when(status == name, targets)
    return result


def current_status(replayed: DataFrame, time: str = "created_at") -> DataFrame:
    """Status of each alert after its last request, and when it was resolved (NULL unless it is)."""
    final = F.max_by("status", "seq")
    resolved = F.max(F.when(F.col("accepted") & (F.col("status") == "resolved"), F.struct("seq", F.col(time).alias("at"))))
    return replayed.groupBy("alert_id").agg(
        final.alias("status"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"),
        resolved.alias("_resolved"),
    ).select(
        "alert_id", "status", "accepted", "rejected",
        F.when(F.col("status") == "resolved", F.col("_resolved.at")).alias("resolved_at"),
    )


def alert_events(replayed: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Accepted status changes and comments as events."""
    changes = replayed.filter("accepted").select(
        "alert_id", "seq", "created_at", F.concat(F.lit("status."), "status").alias("event_type"),
        "from_status", F.col("status").alias("to_status"), "note", "actor",
    )
    if comments is None:
        return changes
    none = F.lit(None).cast("string")
    notes = comments.select(
        "alert_id", "seq", "created_at", F.lit("comment").alias("event_type"),
        none.alias("from_status"), none.alias("to_status"), "note", "actor",
    )
    return changes.unionByName(notes)


def alert_timeline(events: DataFrame, alert_id: str | None = None) -> DataFrame:
    """Events oldest first, of one alert or of all."""
    chosen = events if alert_id is None else events.filter(F.col("alert_id") == alert_id)
    return chosen.orderBy("alert_id", "created_at", "seq")


def audit_rows(
    events: DataFrame, created: DataFrame | None = None, loads: DataFrame | None = None, builds: DataFrame | None = None
) -> DataFrame:
    """One audit entry per accepted change, comment, alert creation, load and window build."""
    action = F.when(F.col("event_type") == "comment", "alert.commented").otherwise("alert.status_changed")
    details = F.to_json(
        F.when(F.col("event_type") == "comment", F.create_map(F.lit("note"), F.col("note"))).otherwise(
            F.create_map(F.lit("from"), F.col("from_status"), F.lit("to"), F.col("to_status"), F.lit("note"), F.col("note"))
        )
    )
    rows = events.select(
        stable_id(F.lit("event"), "alert_id", "seq").alias("audit_id"),
        "actor", action.alias("action"), F.lit("alert").alias("resource_type"), F.col("alert_id").alias("resource_id"),
        details.alias("metadata"), "created_at",
    )
    if created is not None:
        rows = rows.unionByName(
            created.select(
                stable_id(F.lit("created"), "alert_id").alias("audit_id"), "actor", F.lit("alert.created").alias("action"),
                F.lit("alert").alias("resource_type"), F.col("alert_id").alias("resource_id"),
                F.to_json(F.struct("risk_score", "model", "is_fallback")).alias("metadata"), "created_at",
            )
        )
    if loads is not None:
        rows = rows.unionByName(
            loads.select(
                stable_id(F.lit("load"), "load_id").alias("audit_id"), "actor", F.lit("ingestion.upload").alias("action"),
                F.lit("ingestion_job").alias("resource_type"), F.col("load_id").alias("resource_id"),
                F.to_json(F.struct("accepted_rows", "skipped_rows")).alias("metadata"), "created_at",
            )
        )
    if builds is not None:
        rows = rows.unionByName(
            builds.select(
                stable_id(F.lit("build"), "traffic_source_id", "created_at").alias("audit_id"),
                F.lit(None).cast("string").alias("actor"), F.lit("windows.build.auto").alias("action"),
                F.lit("traffic_source").alias("resource_type"), F.col("traffic_source_id").alias("resource_id"),
                F.to_json(F.struct("raw_flows_processed", "windows_written")).alias("metadata"), "created_at",
            )
        )
    return rows


# --- Feeds and paging -----------------------------------------------------------------------


def alert_feed(
    alert_rows: DataFrame, predicted: DataFrame, hosts: DataFrame | None = None, status: str | None = None, severity: str | None = None
) -> DataFrame:
    """Alerts with their prediction and, if known, their host, newest first."""
    chosen = alert_rows
    if status is not None:
        chosen = chosen.filter(F.col("status") == status)
    if severity is not None:
        chosen = chosen.filter(F.col("severity") == severity)
    shown = [c for c in predicted.columns if c == "prediction_id" or c not in alert_rows.columns]
    joined = chosen.join(predicted.select(*shown), "prediction_id")
    if hosts is not None:
        target = hosts.select("traffic_source_id", F.col("ip_address").alias("target_host"), "entity_type")
        joined = joined.join(target, ["traffic_source_id", "target_host"], "left")
    return joined.orderBy(F.desc("created_at"), F.desc("alert_id"))


def page_alerts(alert_rows: DataFrame, before: tuple | None = None, limit: int = 50) -> DataFrame:
    """One page, newest first.  The cursor is (created_at, alert_id), so equal times lose no alert."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rest = alert_rows
    if before is not None:
        at, alert_id = F.lit(before[0]), F.lit(before[1])
        rest = rest.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("alert_id") < alert_id)))
    order = [F.desc("created_at"), F.desc("alert_id")]
    cursor = F.concat_ws("|", F.col("created_at").cast("string"), F.col("alert_id"))
    return _page(rest.orderBy(*order).limit(limit + 1), order, limit, cursor)


def audit_feed(audit: DataFrame, actors: DataFrame, limit: int = 50) -> DataFrame:
    """Newest audit entries with the actor's address, if the actor is known."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    newest = audit.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(limit)
    return newest.join(actors, "actor", "left").orderBy(F.desc("created_at"), F.desc("audit_id"))
