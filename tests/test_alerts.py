import random

import pytest
from helpers import moment
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.operators import alerts, forecasts, windows

SCHEMA = "alert_id string, seq long, requested_status string, note string, actor string, created_at timestamp"


def requests(spark, *wanted, alert="a"):
    return spark.createDataFrame([(alert, i, w, f"to {w}", "u1", moment(i)) for i, w in enumerate(wanted, 1)], SCHEMA)


def replay(spark, *wanted, chunk=1024):
    return alerts.triage_status(requests(spark, *wanted), chunk=chunk)


def test_full_workflow_and_reopening(spark):
    done = replay(spark, "acknowledged", "investigating", "resolved", "open", "investigating", "investigating")
    rows = done.orderBy("seq").collect()
    assert [r.accepted for r in rows] == [True, True, True, False, True, False]
    assert rows[3].from_status == "resolved" and rows[3].allowed == "investigating"
    final = alerts.current_status(done).first()
    assert (final.status, final.accepted, final.rejected, final.resolved_at) == ("investigating", 4, 2, None)
    resolved = alerts.current_status(replay(spark, "resolved")).first()
    assert resolved.resolved_at == moment(1)
    events = alerts.alert_timeline(alerts.alert_events(done, requests(spark, "x").withColumn("seq", F.lit(99)))).collect()
    assert [e.event_type for e in events] == ["status.acknowledged", "comment", "status.investigating", "status.resolved", "status.investigating"]
    audit = alerts.audit_rows(alerts.alert_events(done))
    assert {r.action for r in audit.collect()} == {"alert.status_changed"} and audit.count() == 4


@pytest.mark.parametrize("chunk", [1, 3, 16, 1000])
def test_replay_in_chunks_equals_a_loop(spark, chunk):
    random.seed(chunk)
    wanted = {a: [random.choice(fv.STATUSES) for _ in range(n)] for a, n in (("a", 90), ("b", 1), ("c", 37))}
    df = None
    for alert, statuses in wanted.items():
        part = requests(spark, *statuses, alert=alert)
        df = part if df is None else df.unionByName(part)
    got = {(r.alert_id, r.seq): (r.from_status, r.accepted, r.status) for r in alerts.triage_status(df, chunk=chunk).collect()}
    for alert, statuses in wanted.items():
        state = "open"
        for i, want in enumerate(statuses, 1):
            after = want if want in fv.TRANSITIONS[state] else state
            assert got[(alert, i)] == (state, after != state, after)
            state = after


def predicted(spark, *rows):
    df = spark.createDataFrame(
        [(f"s{i}", moment(60 * i), level, float(score), uncertain, stage) for i, (level, score, uncertain, stage) in enumerate(rows)],
        "traffic_source_id string, window_end timestamp, peak_risk_level string, peak_risk double, is_uncertain boolean, peak_risk_stage string",
    )
    made = df.withColumns(
        {"window_start": F.col("window_end"), "predicted_attack_type": F.lit("DDoS"), "confidence_score": F.lit(0.5), "is_fallback": F.lit(True), "is_ood": F.lit(False),
         "model_name": F.lit("m"), "model_version": F.lit("v"), "contributors": F.array().cast("array<struct<feature:string>>")}
    )
    return alerts.predictions(made)


def test_alert_text_severity_and_ids(spark):
    p = predicted(spark, ("critical", 0.805, True, "Impact"), ("critical", 0.8, False, None), ("low", 0.1, False, "Benign"))
    rows = alerts.alerts(p).orderBy("traffic_source_id").collect()
    assert [r.severity for r in rows] == ["high", "critical", "low"]
    assert rows[0].title == "Forecasted Impact risk (low confidence)" and rows[1].title == "Forecasted network risk"
    assert rows[0].summary == "The model forecasts critical risk (80/100) in the next 5 minutes."
    assert rows[0].recommended_actions[:2] == [fv.FALLBACK_ACTION, fv.UNCERTAIN_ACTION] and len(rows[0].recommended_actions) == 5
    assert [r.alert_id for r in alerts.alerts(p).orderBy("traffic_source_id").collect()] == [r.alert_id for r in rows]
    assert alerts.alerts(p, min_score=50).count() == 2
    first = p.orderBy("traffic_source_id").first()
    assert str(first.risk_score) == "80.50" and (first.forecast_window_end - first.forecast_window_start).seconds == 300


def test_pages_lose_no_alert_with_equal_times(spark):
    p = predicted(spark, *[("low", 0.1, False, "Benign")] * 7)
    rows = alerts.alerts(p, created_at=F.lit(moment(5)))
    seen, cursor = [], None
    while True:
        page = alerts.page_alerts(rows, cursor, 3).collect()
        seen += [r.alert_id for r in page]
        if not any(r.next_cursor for r in page):
            break
        cursor = (page[-1].created_at, page[-1].alert_id)
    assert len(seen) == 7 == len(set(seen)) and seen == sorted(seen, reverse=True)
    with pytest.raises(ValueError):
        alerts.page_alerts(rows, limit=500)
    feed = alerts.alert_feed(rows, p, severity="low").collect()
    assert len(feed) == 7 and feed[0].predicted_stage == "Benign"


def test_window_pages(spark):
    df = spark.range(5).select(F.lit("s").alias("traffic_source_id"), F.timestamp_seconds(F.col("id") * 60).alias("window_start"))
    seen, after = 0, None
    for expected in (2, 2, 1):
        page = windows.page_windows(df, "s", after, 2).orderBy("window_start").collect()
        assert len(page) == expected
        seen, after = seen + len(page), page[-1].next_cursor
    assert seen == 5 and after is None


def test_peak_takes_the_first_of_equal_steps(spark):
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(r).alias("risk_score"), F.lit(s).alias("stage"), F.lit(0.8).alias("stage_confidence"))
                      for i, r, s in ((1, 0.2, "Benign"), (2, 0.9, "Impact"), (3, 0.9, "Reconnaissance"))])
    row = forecasts.forecast_confidence(forecasts.peak_step(spark.range(1).select(steps.alias("risk_timeline")))).first()
    assert (row.peak_risk_window, row.peak_risk_stage, row.peak_risk_level, row.predicted_attack_type) == (2, "Impact", "critical", "DoS")
    assert row.confidence_score == 0.8 and not row.is_uncertain


@pytest.mark.parametrize("chunk", [2, 4, 16])
def test_many_levels_of_chunks_replay_like_a_loop(spark, chunk):
    """One alert with thousands of requests among small ones; numbers with gaps, also below zero."""
    rng = random.Random(chunk)
    names = [*fv.STATUSES, "nonsense"]
    rows = [("hot", seq, rng.choice(names)) for seq in sorted(rng.sample(range(-500, 9000), 3000))]
    rows += [(f"a{n}", seq, rng.choice(names)) for n in range(40) for seq in rng.sample(range(50), 3)]
    df = spark.createDataFrame(rows, "alert_id string, seq long, requested_status string").repartition(3)
    status, want = {}, {}
    for alert, seq, asked in sorted(rows):
        now = status.get(alert, "open")
        after = asked if asked in fv.TRANSITIONS[now] else now
        want[(alert, seq)] = (now, now != after, after)
        status[alert] = after
    replayed = alerts.triage_status(df, chunk=chunk)
    assert {(r.alert_id, r.seq): (r.from_status, r.accepted, r.status) for r in replayed.collect()} == want
    # No array is built, so no row and no group grows with an alert.
    plan = replayed._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_append" not in plan


def test_no_requests(spark):
    df = spark.createDataFrame([], "alert_id string, seq long, requested_status string")
    assert alerts.triage_status(df).count() == 0
