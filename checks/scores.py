"""Queries of scoring, evaluation, alerts and triage, each over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks.testbed import EVENTS, events, flows, q6, r6
from checks.windows import BY, KEYS, W, columns_sql, feats, feats_sql, fw_sql, labeled, labeled_sql, query_episodes, scored, show, split, wins, _stats_sql
from flowcast import fixed_values as fv
from flowcast.operators import alerts, evaluation, forecasts, labeling, windows

STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in fv.STAGES) + "]"

# --- Rules ----------------------------------------------------------------------------------


def term_sql(feature, weight, start, full) -> str:
    # The width is computed in doubles here; as SQL literals it would be a decimal.
    return f"CAST({weight} AS DOUBLE) * greatest(0.0, least(1.0, (CAST({feature} AS DOUBLE) - CAST({start} AS DOUBLE)) / CAST({full - start!r} AS DOUBLE)))"


def _family_sql(family: str) -> str:
    return "greatest(0.0, least(1.0, " + " + ".join(term_sql(*t) for t in fv.RULE_TERMS[family]) + "))"


def scores_cte(source: str = "feats") -> str:
    return f""", sc AS (SELECT *, {_family_sql('Reconnaissance')} AS r, {_family_sql('BruteForce')} AS b, {_family_sql('DDoS')} AS d FROM {source}),
  top AS (SELECT *, greatest(r, b, d) AS t1, (list_sort([r, b, d]))[2] AS t2,
    CASE WHEN r >= b AND r >= d THEN 'Reconnaissance' WHEN b >= d THEN 'BruteForce' ELSE 'DDoS' END AS top_family FROM sc),
  pr AS (SELECT *, greatest(0.0, least(1.0, t1 + 0.15 * t2 * (1.0 - t1))) AS p FROM top),
  fc0 AS (SELECT *, round_even(100.0 * p, 1) AS risk_score, round_even(least(0.85, 0.45 + 0.40 * abs(2.0 * p - 1.0)), 3) AS confidence_score,
    CASE WHEN p < 0.20 THEN 'BENIGN' ELSE top_family END AS predicted_attack_type FROM pr),
  fc AS (SELECT *, {level_sql('risk_score')} AS risk_level, confidence_score < 0.55 AS is_uncertain, risk_score >= 50 AS alert_triggered FROM fc0)"""


def level_sql(score: str) -> str:
    return f"CASE WHEN {score} < 20 THEN 'low' WHEN {score} < 50 THEN 'medium' WHEN {score} < 75 THEN 'high' ELSE 'critical' END"


def query_rule_scores(spark, folder):
    return show(forecasts.rule_scores(feats(spark, folder)), ["reconnaissance_score", "brute_force_score", "ddos_score"])


FORECAST_COLUMNS = ["risk_score", "risk_level", "predicted_attack_type", "confidence_score", "is_uncertain", "alert_triggered"]


def query_rule_forecast(spark, folder):
    return show(forecasts.rule_forecast(feats(spark, folder)), FORECAST_COLUMNS)


def query_explanations(spark, folder):
    explained = forecasts.rule_explanations(forecasts.rule_forecast(feats(spark, folder)))
    shown = F.transform(
        "top_features", lambda t: F.concat_ws("|", t["feature"], F.format_string("%.3f", t["contribution"]), t["description"], F.format_string("%.3f", F.bround(t["baseline_value"], 3)))
    )
    return show(explained.withColumn("terms", F.array_join(shown, " ; ")), ["terms", "summary", "mitigation"])


def _sentence_sql(feature: str) -> str:
    pattern, shown = fv.RULE_SENTENCES[feature]
    if shown == "whole":
        return f"printf('{pattern}', CAST({feature} AS BIGINT))"
    digits = next(c for c in pattern[pattern.index(".") + 1:] if c.isdigit())
    value = f"{feature} * 100" if shown == "percent" else feature
    return f"printf('{pattern}', round_even(CAST({value} AS DOUBLE), {digits}))"


def explain_sql() -> str:
    ranks = {
        "Reconnaissance": "CAST(b > r AS INTEGER) + CAST(d > r AS INTEGER)",
        "BruteForce": "CAST(r >= b AS INTEGER) + CAST(d > b AS INTEGER)",
        "DDoS": "CAST(r >= d AS INTEGER) + CAST(b >= d AS INTEGER)",
    }
    parts = []
    for family, terms in fv.RULE_TERMS.items():
        for i, term in enumerate(terms):
            base = fv.BASELINE_VALUES.get(term[0], 0.0)
            parts.append(f"SELECT traffic_source_id, ws, {term_sql(*term)} AS weight, {ranks[family]} AS fr, {i} AS ti, '{term[0]}' AS feature, {_sentence_sql(term[0])} AS text, '{base:.3f}' AS base FROM fc")
    mitigations = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.MITIGATIONS.items())
    return feats_sql() + scores_cte() + ", terms AS (" + " UNION ALL ".join(parts) + f"""), firing AS (SELECT *,
      row_number() OVER o AS n, sum(weight) OVER (PARTITION BY traffic_source_id, ws) AS total FROM terms WHERE weight > 0
      WINDOW o AS (PARTITION BY traffic_source_id, ws ORDER BY weight DESC, fr, ti)),
    listed AS (SELECT traffic_source_id, ws, string_agg(feature || '|' || printf('%.3f', round_even(weight / total, 3)) || '|' || text || '|' || base, ' ; ' ORDER BY n) AS terms,
      max(CASE WHEN n = 1 THEN text END) AS lead FROM firing WHERE n <= 3 GROUP BY ALL)
    SELECT {KEYS}, coalesce(terms, 'failed_conn_ratio|0.000|{fv.NO_EVIDENCE_SENTENCE}|0.030') AS terms,
      CASE WHEN is_uncertain THEN 'Uncertain forecast. ' ELSE '' END || CASE WHEN predicted_attack_type = 'BENIGN' THEN '{fv.BENIGN_SUMMARY % 300}'
        ELSE upper(risk_level[1]) || risk_level[2:] || ' risk of ' || top_family || ' activity in the next 300 seconds: ' || lead END AS summary,
      CASE predicted_attack_type {mitigations} END AS mitigation FROM fc LEFT JOIN listed USING (traffic_source_id, ws)"""


def query_fallback_timeline(spark, folder):
    flat = forecasts.fallback_timeline(forecasts.rule_forecast(feats(spark, folder)))
    points = flat.select(*BY, "window_start", F.explode("risk_timeline").alias("p"))
    return points.select(*BY, F.unix_seconds("window_start").alias("window_start"), F.col("p.step").alias("step"), r6(F.col("p.risk_score")).alias("risk"), "p.stage", r6(F.col("p.stage_confidence")).alias("confidence"))


RULE_STAGE_SQL = "CASE predicted_attack_type WHEN 'Reconnaissance' THEN 'Reconnaissance' WHEN 'BruteForce' THEN 'Initial Access' WHEN 'DDoS' THEN 'Impact' ELSE 'Benign' END"


def query_ood(spark, folder):
    """Statistics of the first half of each source against all its windows, lightly widened values included."""
    s = split(spark, folder)
    widened = s.withColumns({n: F.col(n) * F.when(F.col("row_index") % 7 == 0, 9.0).otherwise(1.0) for n in ("byte_count", "packet_count", "syn_burst_score", "unique_dst_ips")})
    report = forecasts.ood_report(widened, labeling.scaling_stats(s))
    text = F.transform("ood_features", lambda e: F.concat_ws(":", e["feature"], F.format_string("%.2f", e["z_score"])))
    return show(report.withColumn("far", F.array_join(text, ",")), ["far", "is_ood"])


def _ood_sql() -> str:
    wide = {"byte_count", "packet_count", "syn_burst_score", "unique_dst_ips"}
    parts = []
    for i, n in enumerate(fv.FEATURE_NAMES):
        value = f"({n} * CASE WHEN row_index % 7 = 0 THEN 9.0 ELSE 1.0 END)" if n in wide else n
        parts.append(f"SELECT traffic_source_id, ws, '{n}' AS feature, {i} AS i, (CAST({value} AS DOUBLE) - m_{n}) / s_{n} AS z FROM sp JOIN st USING (traffic_source_id)")
    return _stats_sql() + ", z AS (" + " UNION ALL ".join(parts) + f""")
      SELECT {KEYS}, coalesce(string_agg(feature || ':' || printf('%.2f', round_even(z, 2)), ',' ORDER BY abs(round_even(z, 2)) DESC, i) FILTER (abs(z) > 6), '') AS far,
      count(*) FILTER (abs(z) > 6) >= 3 AS is_ood FROM z GROUP BY traffic_source_id, ws"""


def made_timelines(spark, folder) -> DataFrame:
    """A five-step risk timeline per event, from the event's own numbers."""
    stages = F.array(*[F.lit(s) for s in fv.STAGES])
    k, e = F.col("k"), F.col("event_id")
    point = lambda i: F.struct(
        i.alias("step"), ((k * 37 * i + e) % 101 / 100.0).alias("risk_score"), F.get(stages, ((k + i * e) % 6).cast("int")).alias("stage"),
        ((k * i + e * 3) % 100 / 100.0).alias("stage_confidence"),
    )
    return events(spark, folder).select("event_id", F.transform(F.sequence(F.lit(1), F.lit(5)), point).alias("risk_timeline"))


MADE_SQL = f"""WITH {EVENTS}, pts AS (SELECT event_id, i, ((k * 37 * i + event_id) % 101) / 100.0 AS risk, ({STAGE_LIST})[(k + i * event_id) % 6 + 1] AS stage,
  ((k * i + event_id * 3) % 100) / 100.0 AS conf FROM ev, range(1, 6) r(i)), pk AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY risk DESC, i) = 1)"""


def query_peak(spark, folder):
    peaked = forecasts.peak_step(made_timelines(spark, folder))
    return peaked.select("event_id", r6(F.col("peak_risk")).alias("peak_risk"), "peak_risk_window", "peak_risk_stage", "peak_risk_level", "predicted_attack_type")


def query_confidence(spark, folder):
    sure = forecasts.forecast_confidence(forecasts.peak_step(made_timelines(spark, folder)))
    return sure.select("event_id", r6(F.col("confidence_score")).alias("confidence_score"), "is_uncertain")


def learned(spark, folder) -> DataFrame:
    """A learned answer per source in the common shape, made from its newest window; one source has none and
    one has no usable risk."""
    newest = windows.latest_window(wins(spark, folder))
    r = F.when(F.col("traffic_source_id") == "s3", F.lit(float("nan"))).otherwise((F.col("byte_count") % 100) / 100.0)
    point = lambda i: F.struct(i.alias("step"), r.alias("risk_score"), F.lit("Impact").alias("stage"), F.lit(0.9).alias("stage_confidence"))
    empty = F.array().cast("array<struct<feature:string,contribution:double,description:string>>")
    return newest.filter(F.col("traffic_source_id") != "s2").select(
        *BY, F.transform(F.sequence(F.lit(1), F.lit(5)), point).alias("risk_timeline"), r.alias("peak_risk"), F.lit("high").alias("peak_risk_level"),
        F.lit(1).alias("peak_risk_window"), F.lit("Impact").alias("peak_risk_stage"), F.lit("DoS").alias("predicted_attack_type"), F.lit(0.7).alias("confidence_score"),
        F.lit(False).alias("is_uncertain"), F.lit(False).alias("is_ood"), empty.alias("contributors"), F.lit("world-model").alias("model_name"), F.lit("v").alias("model_version"),
    )


def query_policy(spark, folder):
    chosen = forecasts.forecast_policy(feats(spark, folder), learned(spark, folder))
    return show(chosen, ["window_count", "peak_risk", "peak_risk_stage", "predicted_attack_type", "is_fallback", "fallback_reason", "model_name"])


NEWEST_FC = ", nw AS (SELECT *, count(*) OVER (PARTITION BY traffic_source_id) AS window_count FROM fc QUALIFY ws = max(ws) OVER (PARTITION BY traffic_source_id))"


def _policy_sql() -> str:
    use = "traffic_source_id IN ('s0', 's1') AND window_count >= 10"
    return feats_sql() + scores_cte() + NEWEST_FC + f""" SELECT {KEYS}, window_count,
      {q6(f"CASE WHEN {use} THEN (byte_count % 100) / 100.0 ELSE risk_score / 100.0 END")} AS peak_risk, CASE WHEN {use} THEN 'Impact' ELSE {RULE_STAGE_SQL} END AS peak_risk_stage,
      CASE WHEN {use} THEN 'DoS' ELSE predicted_attack_type END AS predicted_attack_type, NOT ({use}) AS is_fallback,
      CASE WHEN {use} THEN NULL WHEN window_count >= 10 THEN 'INTERNAL_ERROR' ELSE 'MODEL_UNAVAILABLE' END AS fallback_reason,
      CASE WHEN {use} THEN 'world-model' ELSE 'rule-fallback' END AS model_name FROM nw"""


# --- Evaluation -------------------------------------------------------------------------------

SCORED = ", sco AS (SELECT traffic_source_id, ws, risk AS y, risk_score / 100.0 AS s, row_index FROM fc)"


def scored_sql() -> str:
    return labeled_sql() + scores_cte("lab") + SCORED


THRESHOLD = 0.2


def query_confusion(spark, folder):
    m = evaluation.confusion_metrics(scored(spark, folder), THRESHOLD, BY)
    return m.select(*BY, "tn", "fp", "fn", "tp", "support", "positive_support", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate")])


COUNTS_SQL = f""", c AS (SELECT traffic_source_id, count(*) FILTER (y = 0 AND s < {THRESHOLD}) AS tn, count(*) FILTER (y = 0 AND s >= {THRESHOLD}) AS fp,
  count(*) FILTER (y = 1 AND s < {THRESHOLD}) AS fn, count(*) FILTER (y = 1 AND s >= {THRESHOLD}) AS tp FROM sco GROUP BY ALL)"""
ZERO = "CASE WHEN {d} = 0 THEN 0.0 ELSE ({n}) / ({d}) END"


def zero(n, d):
    return ZERO.format(n=n, d=d)


def query_lead_times(spark, folder):
    leads = evaluation.lead_times(scored(spark, folder), THRESHOLD, W)
    return leads.select(*BY, "onset_index", "last_index", F.unix_seconds("onset").alias("onset"), "missed", "lead_time_sec")


LEADS = f""", att AS (SELECT *, row_index - row_number() OVER (PARTITION BY traffic_source_id ORDER BY ws) AS island FROM sco WHERE y = 1),
  epi AS (SELECT traffic_source_id, min(row_index) AS onset_index, max(row_index) AS last_index, min(ws) AS onset FROM att GROUP BY traffic_source_id, island),
  quiet AS (SELECT e.traffic_source_id, onset_index, max(q.row_index) AS q FROM epi e LEFT JOIN sco q ON q.traffic_source_id = e.traffic_source_id AND q.row_index < e.onset_index AND NOT (q.y = 0 AND q.s >= {THRESHOLD}) GROUP BY ALL),
  late AS (SELECT traffic_source_id, max(row_index) AS la FROM sco WHERE s >= {THRESHOLD} GROUP BY ALL),
  leads AS (SELECT traffic_source_id, onset_index, last_index, onset, coalesce(la < onset_index, true) AS missed,
    CASE WHEN coalesce(la < onset_index, true) THEN NULL ELSE (onset_index - 1 - coalesce(q, -1)) * {W} END AS lead_time_sec FROM epi JOIN quiet USING (traffic_source_id, onset_index) LEFT JOIN late USING (traffic_source_id))"""


def query_lead_summary(spark, folder):
    s = evaluation.lead_time_summary(scored(spark, folder), THRESHOLD, W)
    doubles = ("mean_lead_time_sec", "median_lead_time_sec", "false_warnings_per_hour")
    return s.select(*BY, "episodes", "warned_episodes", "missed_episodes", "max_lead_time_sec", *[r6(F.col(c)).alias(c) for c in doubles])


H = 4 * W
HORIZON_EPI = f""", hits AS (SELECT e.traffic_source_id, e.onset, min(a.ws + {W}) AS t FROM epi e LEFT JOIN sco a ON a.traffic_source_id = e.traffic_source_id AND a.s >= {THRESHOLD}
  AND a.ws + {W} BETWEEN e.onset - {H} AND e.onset GROUP BY ALL)"""


def query_usefulness(spark, folder):
    u = evaluation.alert_usefulness(scored(spark, folder), THRESHOLD, W, H)
    return u.select(*BY, "alarms", "useful_alarms", r6(F.col("alert_usefulness_rate")).alias("alert_usefulness_rate"), r6(F.col("false_warnings_per_hour")).alias("false_warnings_per_hour"))


P = "greatest(1e-15, least(1 - 1e-15, s))"
FOCAL = f"CASE WHEN y = 1 THEN -0.75 * pow(1 - {P}, 2) * ln({P}) ELSE -0.25 * pow({P}, 2) * ln(1 - {P}) END"


# --- Alerts -------------------------------------------------------------------------------------


def daily_forecasts(spark, folder) -> DataFrame:
    """The rules' answer for every window, as many predictions."""
    payload = forecasts.rule_payload(feats(spark, folder))
    return payload.withColumns({"is_fallback": F.lit(True), "fallback_reason": F.lit("MODEL_UNAVAILABLE")})


def query_predictions(spark, folder):
    p = alerts.predictions(daily_forecasts(spark, folder))
    return p.select(
        "prediction_id", *BY, F.unix_seconds("forecast_window_start").alias("from_s"), F.unix_seconds("forecast_window_end").alias("to_s"),
        F.col("risk_score").cast("double").alias("risk_score"), "risk_level", "predicted_attack_type", "predicted_stage", F.col("confidence_score").cast("double").alias("confidence_score"),
        "is_fallback", "is_uncertain", "is_ood", "model_name",
    )


PRED = f""", pred AS (SELECT *, sha256(traffic_source_id || '|' || (ws + {W}) || '|rule-fallback|rule-fallback-v1.0.0') AS prediction_id, {RULE_STAGE_SQL} AS stage FROM fc)"""
ALERT = """, al AS (SELECT *, sha256(prediction_id || '|alert') AS alert_id, 'Forecasted ' || stage || ' risk' || CASE WHEN is_uncertain THEN ' (low confidence)' ELSE '' END AS title,
  CASE WHEN is_uncertain AND risk_level = 'critical' THEN 'high' ELSE risk_level END AS severity FROM pred)"""


def made_alerts(spark, folder):
    predicted = alerts.predictions(daily_forecasts(spark, folder))
    hosts = windows.host_entities(flows(spark, folder), 86400)
    return alerts.alerts(predicted, hosts), predicted, hosts


def query_alerts(spark, folder):
    rows, _, _ = made_alerts(spark, folder)
    return rows.select("alert_id", "prediction_id", *BY, "target_host", "title", "summary", "severity", "status", F.size("recommended_actions").alias("actions"), F.unix_seconds("created_at").alias("created_at"))


HOST_SQL = f""", dw AS (SELECT *, us // 1000000 // 86400 * 86400 AS day FROM flows), dn AS (SELECT traffic_source_id, max(day) AS day FROM dw GROUP BY ALL),
  hosts AS (SELECT traffic_source_id, dst_ip AS target_host FROM (SELECT traffic_source_id, dst_ip, dst_port, protocol, sum(byte_count) AS bytes FROM dw JOIN dn USING (traffic_source_id, day) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY traffic_source_id ORDER BY bytes DESC, dst_ip, dst_port, protocol) = 1)"""


def query_actions(spark, folder):
    k = F.col("k")
    stage = F.get(F.array(*[F.lit(s) for s in fv.STAGES], F.lit(None)), (F.col("event_id") % 7).cast("int"))
    listed = alerts.recommended_actions(stage, k % 2 == 0, k % 3 == 0, k % 5 == 0)
    return events(spark, folder).select("event_id", F.array_join(listed, " / ").alias("actions"))


def _actions_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {i} THEN {quoted(' / '.join(fv.STAGE_ACTIONS[s]))}" for i, s in enumerate(fv.STAGES))
    return f"""WITH {EVENTS} SELECT event_id, concat_ws(' / ', CASE WHEN k % 5 = 0 THEN {quoted(fv.FALLBACK_ACTION)} END, CASE WHEN k % 3 = 0 THEN {quoted(fv.UNCERTAIN_ACTION)} END,
      CASE WHEN k % 2 = 0 THEN {quoted(fv.OOD_ACTION)} END, CASE event_id % 7 {cases} ELSE {quoted(fv.STAGE_ACTIONS['Benign'][0])} END) AS actions FROM ev"""


def requests(spark, folder) -> DataFrame:
    """Triage requests: one alert per user, the event type is the requested status."""
    table = {"click": "acknowledged", "view": "investigating", "purchase": "resolved", "signup": "open", "error": "resolved"}
    wanted = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return events(spark, folder).select(
        F.concat(F.lit("a"), (F.col("user_id") % 40).cast("string")).alias("alert_id"), F.col("event_id").alias("seq"),
        F.try_element_at(wanted, F.col("event_type")).alias("requested_status"), F.concat(F.lit("note "), F.col("k").cast("string")).alias("note"),
        F.concat(F.lit("u"), (F.col("k") % 7).cast("string")).alias("actor"), F.col("ts").alias("created_at"),
    )


TRIAGE = f"""WITH RECURSIVE {EVENTS}, rq AS (SELECT 'a' || (user_id % 40) AS alert_id, event_id AS seq, us // 1000000 AS made, 'note ' || k AS note, 'u' || (k % 7) AS actor,
  CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'investigating' WHEN 'signup' THEN 'open' ELSE 'resolved' END AS want,
  row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n FROM ev),
  tr AS (SELECT alert_id AS a, 0::BIGINT AS n, 'open' AS st FROM rq GROUP BY alert_id UNION ALL
    SELECT a, rq.n, CASE WHEN st || '>' || want IN ('open>acknowledged', 'open>investigating', 'open>resolved', 'acknowledged>investigating', 'acknowledged>resolved', 'acknowledged>open',
      'investigating>resolved', 'investigating>acknowledged', 'resolved>investigating') THEN want ELSE st END FROM tr JOIN rq ON rq.alert_id = tr.a AND rq.n = tr.n + 1),
  rp AS (SELECT rq.*, b.st AS from_status, f.st AS status, b.st <> f.st AS accepted FROM rq JOIN tr f ON f.a = rq.alert_id AND f.n = rq.n JOIN tr b ON b.a = rq.alert_id AND b.n = rq.n - 1)"""


def replayed(spark, folder):
    return alerts.triage_status(requests(spark, folder), chunk=1024)


def query_triage(spark, folder):
    return replayed(spark, folder).select("alert_id", "seq", "requested_status", "from_status", "accepted", "status")


def query_alert_status(spark, folder):
    final = alerts.current_status(replayed(spark, folder))
    return final.select("alert_id", "status", "accepted", "rejected", F.unix_seconds("resolved_at").alias("resolved_at"))


def comments(spark, folder):
    """Every request also leaves a comment."""
    r = requests(spark, folder)
    return r.select("alert_id", (F.col("seq") + F.lit(10_000_000)).alias("seq"), "note", "actor", "created_at")


def query_alert_timeline(spark, folder):
    e = alerts.alert_timeline(alerts.alert_events(replayed(spark, folder), comments(spark, folder)))
    return e.select("alert_id", "seq", F.unix_seconds("created_at").alias("created_at"), "event_type", "from_status", "to_status", "note", "actor")


def audit(spark, folder):
    p = alerts.predictions(daily_forecasts(spark, folder))
    created = alerts.alerts(p).join(p.select("prediction_id", "risk_score", "model_name", "is_fallback"), "prediction_id").select(
        "alert_id", F.lit("u1").alias("actor"), F.col("risk_score").cast("double").alias("risk_score"), F.col("model_name").alias("model"), "is_fallback", "created_at"
    )
    return alerts.audit_rows(alerts.alert_events(replayed(spark, folder), comments(spark, folder)), created)


def query_audit_rows(spark, folder):
    return audit(spark, folder).select("audit_id", "actor", "action", "resource_type", "resource_id", F.unix_seconds("created_at").alias("created_at"))


def audit_sql() -> str:
    """Audit entries of changes, comments and creations; the two parts meet in one statement."""
    both = feats_sql() + scores_cte() + PRED + ALERT
    head, tail = TRIAGE.split(", rq AS", 1)
    return both.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + ", rq AS" + tail + f""", au AS (
      SELECT sha256('event|' || alert_id || '|' || seq) AS audit_id, actor, 'alert.status_changed' AS action, 'alert' AS resource_type, alert_id AS resource_id, made AS created_at FROM rp WHERE accepted
      UNION ALL SELECT sha256('event|' || alert_id || '|' || (seq + 10000000)), actor, 'alert.commented', 'alert', alert_id, made FROM rq
      UNION ALL SELECT sha256('created|' || alert_id), 'u1', 'alert.created', 'alert', alert_id, ws + {W} FROM al)"""


def actors(spark, folder):
    """Known actors: all but one."""
    return requests(spark, folder).select("actor").distinct().filter(F.col("actor") != "u3").select("actor", F.concat("actor", F.lit("@example.org")).alias("email"))


def query_audit_feed(spark, folder):
    feed = alerts.audit_feed(audit(spark, folder), actors(spark, folder), 50)
    return feed.select("audit_id", "action", "resource_id", "email", F.unix_seconds("created_at").alias("created_at"))


def query_alert_feed(spark, folder):
    rows, predicted, hosts = made_alerts(spark, folder)
    feed = alerts.alert_feed(rows, predicted, hosts, severity="medium")
    return feed.select("alert_id", "title", "severity", F.col("risk_score").cast("double").alias("risk_score"), "predicted_stage", "target_host", "entity_type")


def query_page_alerts(spark, folder):
    rows, _, _ = made_alerts(spark, folder)
    page = alerts.page_alerts(rows, (_at("2024-01-20 00:00:00"), "8"), 30)
    return page.select("alert_id", F.unix_seconds("created_at").alias("created_at"), F.col("next_cursor").isNotNull().alias("more"))


def _at(text):
    from checks.windows import _moment

    return _moment(text)


def query_pipeline_counts(spark, folder):
    rows, predicted, _ = made_alerts(spark, folder)
    tables = {"raw_flows": flows(spark, folder), "traffic_windows": wins(spark, folder), "predictions": predicted, "alerts": rows}
    return windows.pipeline_counts(tables, rows, predicted)


QUERIES = {
    "rule_scores": query_rule_scores,
    "rule_forecast": query_rule_forecast,
    "rule_explanations": query_explanations,
    "fallback_timeline": query_fallback_timeline,
    "ood_report": query_ood,
    "peak_step": query_peak,
    "forecast_confidence": query_confidence,
    "forecast_policy": query_policy,
    "confusion_metrics": query_confusion,
    "roc_auc": lambda s, d: evaluation.roc_auc(scored(s, d), BY).select(*BY, r6(F.col("roc_auc")).alias("roc_auc")),
    "pr_auc": lambda s, d: evaluation.pr_auc(scored(s, d), BY).select(*BY, r6(F.col("pr_auc")).alias("pr_auc")),
    "calibrate_threshold": lambda s, d: evaluation.calibrate_threshold(scored(s, d), 0.05, BY),
    "lead_times": query_lead_times,
    "lead_time_summary": query_lead_summary,
    "predictions": query_predictions,
    "alerts": query_alerts,
    "recommended_actions": query_actions,
    "triage_status": query_triage,
    "alert_status": query_alert_status,
    "alert_timeline": query_alert_timeline,
    "audit_rows": query_audit_rows,
    "audit_feed": query_audit_feed,
    "alert_feed": query_alert_feed,
    "page_alerts": query_page_alerts,
    "pipeline_counts": query_pipeline_counts,
    "f2_score": lambda s, d: evaluation.f2_score(scored(s, d), THRESHOLD, BY).select(*BY, r6(F.col("f2")).alias("f2")),
    "horizon_lead_time": lambda s, d: evaluation.horizon_lead_time(scored(s, d), THRESHOLD, W, H).select(*BY, F.unix_seconds("onset").alias("onset"), "lead_time_sec"),
    "alert_usefulness": query_usefulness,
    "focal_loss": lambda s, d: evaluation.focal_loss(scored(s, d), by=BY).select(*BY, r6(F.col("focal_loss")).alias("focal_loss")),
    "cost_lead_loss": lambda s, d: evaluation.cost_lead_loss(scored(s, d), THRESHOLD, W, H).select(*BY, r6(F.col("cost_lead_loss")).alias("cost_lead_loss")),
}

SQL = {
    "rule_scores": feats_sql() + scores_cte() + f" SELECT {KEYS}, {q6('r')} AS reconnaissance_score, {q6('b')} AS brute_force_score, {q6('d')} AS ddos_score FROM fc",
    "rule_forecast": feats_sql() + scores_cte() + f" SELECT {KEYS}, {q6('risk_score')} AS risk_score, risk_level, predicted_attack_type, {q6('confidence_score')} AS confidence_score, is_uncertain, alert_triggered FROM fc",
    "rule_explanations": explain_sql(),
    "fallback_timeline": feats_sql() + scores_cte() + f" SELECT {KEYS}, CAST(step AS INTEGER) AS step, {q6('risk_score / 100.0')} AS risk, {RULE_STAGE_SQL} AS stage, {q6('confidence_score')} AS confidence FROM fc, range(1, 6) t(step)",
    "ood_report": _ood_sql(),
    "peak_step": MADE_SQL + f" SELECT event_id, {q6('risk')} AS peak_risk, CAST(i AS INTEGER) AS peak_risk_window, stage AS peak_risk_stage, {level_sql('risk * 100')} AS peak_risk_level, "
    "CASE stage WHEN 'Benign' THEN 'BENIGN' WHEN 'Reconnaissance' THEN 'Reconnaissance' WHEN 'Initial Access' THEN 'BruteForce' WHEN 'Lateral Movement' THEN 'Infiltration' WHEN 'Command & Control' THEN 'Botnet_C2' ELSE 'DoS' END AS predicted_attack_type FROM pk",
    "forecast_confidence": MADE_SQL + f", c AS (SELECT event_id, round_even(CAST(0.5 * conf + 0.5 * abs(2.0 * risk - 1.0) AS DOUBLE), 3) AS c FROM pk) SELECT event_id, {q6('c')} AS confidence_score, c < 0.55 AS is_uncertain FROM c",
    "forecast_policy": _policy_sql(),
    "confusion_metrics": scored_sql() + COUNTS_SQL + f""" SELECT *, tn + fp + fn + tp AS support, fn + tp AS positive_support, {q6('round_even(' + zero('tp', '(tp + fp)') + ', 4)')} AS precision,
      {q6('round_even(' + zero('tp', '(tp + fn)') + ', 4)')} AS recall, {q6('round_even(' + zero('2 * tp', '(2 * tp + fp + fn)') + ', 4)')} AS f1, {q6('round_even(' + zero('fp', '(fp + tn)') + ', 4)')} AS false_positive_rate FROM c""",
    "roc_auc": scored_sql() + f""", n AS (SELECT traffic_source_id, s, count(*) FILTER (y = 0) AS n, count(*) FILTER (y = 1) AS p FROM sco GROUP BY ALL)
      SELECT traffic_source_id, {q6('sum(p * (below + n / 2.0)) / (sum(p) * sum(n))')} AS roc_auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY traffic_source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n) GROUP BY ALL""",
    "pr_auc": scored_sql() + f""", n AS (SELECT traffic_source_id, s, count(*) AS n, count(*) FILTER (y = 1) AS p FROM sco GROUP BY ALL)
      SELECT traffic_source_id, {q6('sum(p * tp / alln) / sum(p)')} AS pr_auc FROM (SELECT *, sum(n) OVER w AS alln, sum(p) OVER w AS tp FROM n WINDOW w AS (PARTITION BY traffic_source_id ORDER BY s DESC)) GROUP BY ALL""",
    "calibrate_threshold": scored_sql() + """, cand AS (SELECT DISTINCT traffic_source_id, s AS t FROM sco UNION SELECT DISTINCT traffic_source_id, 0.0 FROM sco UNION SELECT DISTINCT traffic_source_id, 1.0 FROM sco),
      ev2 AS (SELECT c.traffic_source_id, t, avg(CASE WHEN s >= t THEN 1.0 ELSE 0.0 END) FILTER (y = 0) AS fpr, avg(CASE WHEN s >= t THEN 1.0 ELSE 0.0 END) FILTER (y = 1) AS rec
        FROM cand c JOIN sco USING (traffic_source_id) GROUP BY ALL)
      SELECT traffic_source_id, round_even(CAST(arg_max(t, (rec, t)) AS DOUBLE), 4) AS threshold, round_even(arg_max(rec, (rec, t)), 4) AS recall, round_even(arg_max(fpr, (rec, t)), 4) AS false_positive_rate,
      CAST(0.05 AS DOUBLE) AS max_false_positive_rate FROM ev2 WHERE fpr <= 0.05 GROUP BY ALL""",
    "lead_times": scored_sql() + LEADS + " SELECT * FROM leads",
    "lead_time_summary": scored_sql() + LEADS + f""", nz AS (SELECT traffic_source_id, count(*) FILTER (y = 0) AS benign, count(*) FILTER (y = 0 AND s >= {THRESHOLD}) AS fa FROM sco GROUP BY ALL),
      ls AS (SELECT traffic_source_id, count(*) AS episodes, count(lead_time_sec) AS warned_episodes, count(*) FILTER (missed) AS missed_episodes, max(lead_time_sec) AS max_lead_time_sec,
        {q6('round_even(avg(lead_time_sec), 1)')} AS mean_lead_time_sec, {q6('round_even(CAST(median(lead_time_sec) AS DOUBLE), 1)')} AS median_lead_time_sec FROM leads GROUP BY ALL)
      SELECT traffic_source_id, coalesce(episodes, 0) AS episodes, coalesce(warned_episodes, 0) AS warned_episodes, coalesce(missed_episodes, 0) AS missed_episodes, max_lead_time_sec, mean_lead_time_sec,
      median_lead_time_sec, {q6(f'round_even(fa / (benign * {W} / 3600.0), 2)')} AS false_warnings_per_hour FROM nz LEFT JOIN ls USING (traffic_source_id)""",
    "predictions": feats_sql() + scores_cte() + PRED + f""" SELECT prediction_id, traffic_source_id, ws + {W} AS from_s, ws + {W} + 300 AS to_s, CAST(risk_score AS DOUBLE) AS risk_score, risk_level, predicted_attack_type,
      stage AS predicted_stage, CAST(confidence_score AS DOUBLE) AS confidence_score, true AS is_fallback, is_uncertain, false AS is_ood, 'rule-fallback' AS model_name FROM pred""",
    "alerts": feats_sql() + scores_cte() + PRED + ALERT + HOST_SQL + f""" SELECT alert_id, prediction_id, traffic_source_id, target_host, title,
      printf('The model forecasts %s risk (%.0f/100) in the next 5 minutes.', risk_level, round_even(CAST(risk_score AS DOUBLE), 0)) AS summary, severity, 'open' AS status,
      CAST(1 + CAST(is_uncertain AS INTEGER) + CASE WHEN stage = 'Benign' THEN 1 ELSE 3 END AS INTEGER) AS actions, ws + {W} AS created_at FROM al LEFT JOIN hosts USING (traffic_source_id)""",
    "recommended_actions": _actions_sql(),
    "triage_status": TRIAGE + " SELECT alert_id, seq, want AS requested_status, from_status, accepted, status FROM rp",
    "alert_status": TRIAGE + """ SELECT alert_id, arg_max(status, seq) AS status, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected,
      CASE WHEN arg_max(status, seq) = 'resolved' THEN arg_max(made, seq) FILTER (accepted AND status = 'resolved') END AS resolved_at FROM rp GROUP BY alert_id""",
    "alert_timeline": TRIAGE + """ SELECT alert_id, seq, made AS created_at, 'status.' || status AS event_type, from_status, status AS to_status, note, actor FROM rp WHERE accepted
      UNION ALL SELECT alert_id, seq + 10000000, made, 'comment', NULL, NULL, note, actor FROM rq""",
    "audit_rows": audit_sql() + " SELECT * FROM au",
    "audit_feed": audit_sql() + " SELECT audit_id, action, resource_id, CASE WHEN actor <> 'u3' THEN actor || '@example.org' END AS email, created_at FROM (SELECT * FROM au ORDER BY created_at DESC, audit_id DESC LIMIT 50)",
    "alert_feed": feats_sql() + scores_cte() + PRED + ALERT + HOST_SQL + """ SELECT alert_id, title, severity, CAST(risk_score AS DOUBLE) AS risk_score, stage AS predicted_stage, target_host,
      CASE WHEN target_host LIKE '10.%' THEN 'internal' ELSE 'external' END AS entity_type FROM al LEFT JOIN hosts USING (traffic_source_id) WHERE severity = 'medium'""",
    "page_alerts": feats_sql() + scores_cte() + PRED + ALERT + f""", rest AS (SELECT alert_id, ws + {W} AS created_at, row_number() OVER (ORDER BY ws DESC, alert_id DESC) AS pos, count(*) OVER () AS n FROM al
      WHERE ws + {W} < 1705708800 OR (ws + {W} = 1705708800 AND alert_id < '8')) SELECT alert_id, created_at, pos = 30 AND n > 30 AS more FROM rest WHERE pos <= 30""",
    "pipeline_counts": fw_sql() + """, c AS (SELECT count(*) AS n FROM fw) SELECT 'raw_flows' AS item, count(*) AS rows FROM flows UNION ALL SELECT unnest(['traffic_windows', 'predictions', 'alerts', 'alerts_open', 'fallback_predictions']), n FROM c
      UNION ALL SELECT unnest(['alerts_acknowledged', 'alerts_investigating', 'alerts_resolved']), 0""",
    "f2_score": scored_sql() + COUNTS_SQL + f", pr2 AS (SELECT traffic_source_id, {zero('tp', '(tp + fp)')} AS pp, {zero('tp', '(tp + fn)')} AS rr FROM c) SELECT traffic_source_id, {q6(zero('5.0 * pp * rr', '(4.0 * pp + rr)'))} AS f2 FROM pr2",
    "horizon_lead_time": scored_sql() + LEADS + HORIZON_EPI + " SELECT traffic_source_id, onset, onset - t AS lead_time_sec FROM hits",
    "alert_usefulness": scored_sql() + LEADS + f""", am AS (SELECT a.traffic_source_id, a.ws, a.s >= {THRESHOLD} AS alarm, EXISTS (SELECT 1 FROM epi e WHERE e.traffic_source_id = a.traffic_source_id
      AND e.onset - (a.ws + {W}) BETWEEN 0 AND {H}) AS useful FROM sco a), k AS (SELECT traffic_source_id, count(*) AS n, count(*) FILTER (alarm) AS alarms, count(*) FILTER (alarm AND useful) AS useful_alarms FROM am GROUP BY ALL)
      SELECT traffic_source_id, alarms, useful_alarms, {q6('CASE WHEN alarms > 0 THEN useful_alarms / alarms END')} AS alert_usefulness_rate, {q6(f'(alarms - useful_alarms) / (n * {W} / 3600.0)')} AS false_warnings_per_hour FROM k""",
    "focal_loss": scored_sql() + f" SELECT traffic_source_id, {q6(f'avg({FOCAL})')} AS focal_loss FROM sco GROUP BY ALL",
    "cost_lead_loss": scored_sql() + LEADS + f""", nx AS (SELECT a.*, coalesce((SELECT min(onset) FROM epi e WHERE e.traffic_source_id = a.traffic_source_id AND e.onset >= a.ws) - ws, 0) AS ahead FROM sco a)
      SELECT traffic_source_id, {q6(f"avg(({FOCAL}) * CASE WHEN y = 1 AND s < {THRESHOLD} THEN 1 + 5.0 * exp(-ahead / 30.0) WHEN y = 0 AND s >= {THRESHOLD} THEN 1 + greatest(0.0, (ahead - {H}) / {H}) ELSE 1.0 END)")} AS cost_lead_loss FROM nx GROUP BY ALL""",
}
