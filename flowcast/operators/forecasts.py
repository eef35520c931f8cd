"""Scoring a window: precursor rules, their explanation, out-of-distribution report and policy."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.functions import risk
from flowcast.functions.labels import lookup, stage_attack_type, stage_candidates
from flowcast.operators.features import feature_violations
from flowcast.operators.windows import SOURCE

_FAMILY_COLUMNS = {
    "Reconnaissance": "reconnaissance_score", "BruteForce": "brute_force_score", "DDoS": "ddos_score",
}


def _term(feature: str, weight: float, start: float, full: float) -> Column:
    return F.lit(weight) * risk.ramp(F.col(feature).cast("double"), start, full)


def rule_scores(features: DataFrame) -> DataFrame:
    """Add one score in [0, 1] per precursor family: a weighted sum of ramps."""
    scores = {}
    for family, terms in fv.RULE_TERMS.items():
        total = F.lit(0.0)
        for term in terms:
            total = total + _term(*term)
        scores[_FAMILY_COLUMNS[family]] = risk.clamp01(total)
    return features.withColumns(scores)


def _ranked_families() -> Column:
    """Families by falling score; equal scores keep the order of the rule table."""
    entries = [
        F.struct(F.col(column).alias("score"), F.lit(-i).alias("order"), F.lit(family).alias("family"))
        for i, (family, column) in enumerate(_FAMILY_COLUMNS.items())
    ]
    return F.sort_array(F.array(*entries), asc=False)


def rule_forecast(
    features: DataFrame,
    horizon: int = 300,
    alert_threshold: float = fv.ALERT_THRESHOLD,
    reason: str | Column = "MODEL_UNAVAILABLE",
) -> DataFrame:
    """Risk, level, attack type and confidence of every window from the rules alone."""
    if horizon not in fv.HORIZONS:
        raise ValueError(f"horizon must be one of {fv.HORIZONS}")
    reason = F.lit(reason) if isinstance(reason, str) else reason
    df = rule_scores(features).withColumn("_families", _ranked_families())
    top, second = F.col("_families")[0], F.col("_families")[1]["score"]
    df = df.withColumn(
        "probability", risk.clamp01(top["score"] + F.lit(0.15) * second * (F.lit(1.0) - top["score"]))
    )
    p = F.col("probability")
    confidence = F.bround(F.least(F.lit(0.85), F.lit(0.45) + F.lit(0.40) * risk.decisiveness(p)), 3)
    return (
        df.withColumns({"risk_score": F.bround(F.lit(100.0) * p, 1), "confidence_score": confidence})
        .withColumns(
            {
                "top_family": top["family"],
                "risk_level": risk.risk_level(F.col("risk_score")),
                "stage_progression": risk.risk_progression(F.col("risk_score")),
                "predicted_attack_type": F.when(p < 0.20, "BENIGN").otherwise(top["family"]),
                "forecast_horizon_sec": F.lit(horizon),
                "is_uncertain": F.col("confidence_score") < fv.LOW_CONFIDENCE,
                "alert_triggered": F.col("risk_score") >= alert_threshold,
                "is_fallback": F.lit(True),
                "fallback_reason": reason,
                "is_ood": F.lit(False),
                "model_name": F.lit(fv.RULE_MODEL_NAME),
                "model_version": F.lit(fv.RULE_MODEL_VERSION),
            }
        )
        .drop("_families")
    )


def _sentence(feature: str) -> Column:
    pattern, shown_as = fv.RULE_SENTENCES[feature]
    value = F.col(feature).cast("double")
    if shown_as == "whole":
        return F.format_string(pattern, value.cast("bigint"))
    shown = value * 100 if shown_as == "percent" else value
    digits = int(re.search(r"\.(\d)f", pattern).group(1))
    # Rounded half-even first: the formatter alone would round halves up.
    return F.format_string(pattern, F.bround(shown, digits))


def rule_explanations(forecast: DataFrame, top: int = 3) -> DataFrame:
    """Add the firing terms with their share, a summary sentence and the advice."""
    # Position of a family in the falling score order, as the tie-break between equal terms.
    columns = list(_FAMILY_COLUMNS.values())
    entries = []
    for i, (family, terms) in enumerate(fv.RULE_TERMS.items()):
        mine = F.col(columns[i])
        ahead = [F.col(c) >= mine if j < i else F.col(c) > mine for j, c in enumerate(columns) if j != i]
        rank = ahead[0].cast("int") + ahead[1].cast("int")
        for position, term in enumerate(terms):
            entries.append(
                F.struct(
                    _term(*term).alias("weight"),
                    (-rank).alias("family_order"),
                    F.lit(-position).alias("term_order"),
                    F.lit(term[0]).alias("feature"),
                    F.col(term[0]).cast("double").alias("value"),
                    F.lit(fv.BASELINE_VALUES.get(term[0], 0.0)).alias("baseline"),
                    _sentence(term[0]).alias("description"),
                )
            )
    firing = F.sort_array(F.filter(F.array(*entries), lambda t: t["weight"] > 0), asc=False)
    nothing = F.array(
        _contribution("failed_conn_ratio", F.lit(0.0), F.lit(fv.NO_EVIDENCE_SENTENCE), F.col("failed_conn_ratio"))
    )
    df = forecast.withColumn("_firing", firing)
    total = F.aggregate("_firing", F.lit(0.0), lambda acc, t: acc + t["weight"])
    ranked = F.transform(
        F.slice("_firing", 1, top),
        lambda t: F.struct(
            t["feature"].alias("feature"),
            F.bround(t["weight"] / F.col("_total"), 3).alias("contribution"),
            t["description"].alias("description"),
            t["value"].alias("feature_value"),
            t["baseline"].alias("baseline_value"),
        ),
    )
    df = df.withColumn("_total", total).withColumn(
        "top_features", F.when(F.size("_firing") == 0, nothing).otherwise(ranked)
    )
    benign = F.format_string(fv.BENIGN_SUMMARY, F.col("forecast_horizon_sec"))
    active = F.concat(
        F.initcap("risk_level"), F.lit(" risk of "), F.col("top_family"), F.lit(" activity in the next "),
        F.col("forecast_horizon_sec").cast("string"), F.lit(" seconds: "), F.col("top_features")[0]["description"],
    )
    summary = F.when(F.col("predicted_attack_type") == "BENIGN", benign).otherwise(active)
    prefix = F.when(F.col("is_uncertain"), "Uncertain forecast. ").otherwise("")
    return df.withColumns(
        {
            "summary": F.concat(prefix, summary),
            "mitigation": lookup(fv.MITIGATIONS, F.col("predicted_attack_type")),
        }
    ).drop("_firing", "_total")


def _contribution(feature: str, share: Column, text: Column, value: Column) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"),
        share.alias("contribution"),
        text.alias("description"),
        value.cast("double").alias("feature_value"),
        F.lit(fv.BASELINE_VALUES[feature]).alias("baseline_value"),
    )


def fallback_timeline(forecast: DataFrame, steps: int = fv.FORECAST_STEPS) -> DataFrame:
    """Add the rule score as a flat timeline of equal steps, with the stage of its attack type."""
    stage = F.coalesce(lookup(fv.RULE_TYPE_STAGES, F.col("predicted_attack_type")), F.lit("Benign"))
    point = lambda step: F.struct(
        step.alias("step"),
        (F.col("risk_score") / 100.0).alias("risk_score"),
        F.col("peak_risk_stage").alias("stage"),
        F.col("confidence_score").alias("stage_confidence"),
    )
    return forecast.withColumn("peak_risk_stage", stage).withColumns(
        {
            "risk_timeline": F.transform(F.sequence(F.lit(1), F.lit(steps)), point),
            "peak_risk_window": F.lit(1),
            "attack_candidates": stage_candidates(F.col("peak_risk_stage")),
        }
    )


def peak_step(forecast: DataFrame, timeline: str = "risk_timeline") -> DataFrame:
    """Add the step with the highest risk (the first on ties), its level, stage and attack type."""
    best = F.array_max(
        F.transform(
            timeline,
            lambda p: F.struct(
                p["risk_score"].alias("risk"), (-p["step"]).alias("order"), p["stage"].alias("stage"),
                p["stage_confidence"].alias("confidence"),
            ),
        )
    )
    return forecast.withColumn("_peak", best).withColumns(
        {
            "peak_risk": F.col("_peak.risk"),
            "peak_risk_window": -F.col("_peak.order"),
            "peak_risk_stage": F.col("_peak.stage"),
            "peak_stage_confidence": F.col("_peak.confidence"),
            "peak_risk_level": risk.risk_level(F.col("_peak.risk") * 100),
            "predicted_attack_type": stage_attack_type(F.col("_peak.stage")),
        }
    ).drop("_peak")


def forecast_confidence(peaked: DataFrame) -> DataFrame:
    """Half the stage certainty, half how decisive the risk is, both at the peak."""
    score = F.bround(
        F.lit(0.5) * F.col("peak_stage_confidence") + F.lit(0.5) * risk.decisiveness(F.col("peak_risk")), 3
    )
    return peaked.withColumn("confidence_score", score).withColumn(
        "is_uncertain", F.col("confidence_score") < fv.LOW_CONFIDENCE
    )


def ood_report(
    newest: DataFrame, stats: DataFrame, by: Sequence[str] = SOURCE, strict: bool = False
) -> DataFrame:
    """Features far outside the training distribution, most extreme first, and the verdict.

    ``stats`` holds the ``mean`` and ``std`` structs of ``scaling_stats`` per source.  ``strict``
    also forces the UNKNOWN attack type and a confidence of at most 0.3 on flagged forecasts.
    """
    joined = newest.join(stats.select(*by, "mean", "std"), list(by))
    names = {name: i for i, name in enumerate(fv.FEATURE_NAMES)}
    entries = []
    for name, i in names.items():
        z = (F.col(name) - F.col(f"mean.{name}")) / F.col(f"std.{name}")
        entries.append(
            F.struct(F.abs(F.bround(z, 2)).alias("size"), F.lit(-i).alias("order"), F.lit(name).alias("feature"),
                     F.bround(z, 2).alias("z_score"), (F.abs(z) > fv.OOD_Z).alias("far"))
        )
    far = F.sort_array(F.filter(F.array(*entries), lambda e: e["far"]), asc=False)
    shown = F.transform(far, lambda e: F.struct(e["feature"].alias("feature"), e["z_score"].alias("z_score")))
    result = joined.withColumn("ood_features", shown).withColumn(
        "is_ood", F.size("ood_features") >= fv.OOD_MIN_FEATURES
    ).drop("mean", "std")
    if strict:
        result = result.withColumns(
            {
                "predicted_attack_type": F.when(F.col("is_ood"), "UNKNOWN").otherwise(F.col("predicted_attack_type")),
                "confidence_score": F.when(F.col("is_ood"), F.least("confidence_score", F.lit(0.3))).otherwise(
                    F.col("confidence_score")
                ),
            }
        )
    return result


PAYLOAD = (
    "risk_timeline", "peak_risk", "peak_risk_level", "peak_risk_window", "peak_risk_stage", "predicted_attack_type",
    "confidence_score", "is_uncertain", "is_ood", "contributors", "model_name", "model_version",
)


def rule_payload(features: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """The rules' answer for each window in the common forecast shape."""
    explained = fallback_timeline(rule_explanations(rule_forecast(features)))
    contributors = F.transform(
        "top_features", lambda t: F.struct(t["feature"].alias("feature"), t["contribution"].alias("contribution"),
                                           t["description"].alias("description"))
    )
    return explained.select(
        *by, "window_start", "window_end",
        "risk_timeline", (F.col("risk_score") / 100.0).alias("peak_risk"), F.col("risk_level").alias("peak_risk_level"),
        "peak_risk_window", "peak_risk_stage", "predicted_attack_type", "confidence_score", "is_uncertain", "is_ood",
        contributors.alias("contributors"), "model_name", "model_version",
    )


def forecast_policy(features: DataFrame, learned: DataFrame | None = None, by: Sequence[str] = SOURCE) -> DataFrame:
    """One forecast per source: the learned one where it is usable, else the rules with a reason.

    A source needs ten windows for the learned model; a source whose newest vector breaks the
    contract gets no forecast (it is in ``rejected_forecasts``).
    """
    newest = _newest_with_count(features, by)
    valid = feature_violations(newest).filter(F.size("violations") == 0).drop("violations")
    rules = rule_payload(valid, [*by, "window_count"])
    enough = F.col("window_count") >= fv.HISTORY_WINDOWS
    if learned is None:
        usable, reason = F.lit(False), F.lit("MODEL_UNAVAILABLE")
        joined = rules
        payload = [F.col(name) for name in PAYLOAD]
    else:
        answer = learned.select(*by, F.struct(*PAYLOAD).alias("_learned"))
        joined = rules.join(answer, list(by), "left")
        risk_value = F.col("_learned.peak_risk")
        usable = enough & risk_value.isNotNull() & ~F.isnan(risk_value)
        reason = F.when(enough, "INTERNAL_ERROR").otherwise("MODEL_UNAVAILABLE")
        payload = [
            F.when(F.col("_usable"), F.col(f"_learned.{name}")).otherwise(F.col(name)).alias(name) for name in PAYLOAD
        ]
    joined = joined.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    return joined.select(
        *by, "window_start", "window_end", "window_count", *payload,
        (~F.col("_usable")).alias("is_fallback"),
        F.when(~F.col("_usable"), reason).alias("fallback_reason"),
    )


def _newest_with_count(features: DataFrame, by: Sequence[str]) -> DataFrame:
    """Newest vector of each source and its number of windows, from one map-side aggregation."""
    others = [c for c in features.columns if c not in by]
    found = features.groupBy(*by).agg(
        F.max_by(F.struct(*others), "window_start").alias("_newest"), F.count(F.lit(1)).alias("window_count")
    )
    return found.select(*by, *[F.col("_newest")[c].alias(c) for c in others], "window_count")


def rejected_forecasts(sources: DataFrame, features: DataFrame, by: Sequence[str] = SOURCE) -> DataFrame:
    """Sources that get no forecast: without any window, or with a newest vector that breaks the contract."""
    newest = _newest_with_count(features, by)
    broken = feature_violations(newest).select(*by, "violations")
    joined = sources.select(*by).distinct().join(broken, list(by), "left")
    return joined.filter(F.col("violations").isNull() | (F.size("violations") > 0)).select(
        *by,
        F.when(F.col("violations").isNull(), "NOT_ENOUGH_WINDOWS").otherwise("INVALID_FEATURES").alias("error_code"),
        F.coalesce("violations", F.array().cast("array<string>")).alias("violations"),
    )
