"""Chunked ordered operators against plain windows and against loops."""

import random

import pytest
from helpers import windows
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowcast.operators import evaluation, labeling, timeline
from flowcast.operators import windows as win


def random_timeline(spark, seed, sources=3, n=120):
    random.seed(seed)
    rows = []
    for s in range(sources):
        for i in sorted(random.sample(range(n * 2), n if s else 5)):
            rows.append((f"s{s}", i, random.randint(0, 9)))
    return windows(spark, rows, "x long")


@pytest.mark.parametrize("size", [1, 2, 5, 40, 10_000])
@pytest.mark.parametrize("depth", [1, 3, 10])
def test_previous_rows_cross_chunks(spark, size, depth):
    df = random_timeline(spark, size)
    chunk = F.floor(F.col("n") / size).cast("long")
    w = Window.partitionBy("traffic_source_id").orderBy("window_start")
    got = timeline.with_previous(df, ["traffic_source_id"], "window_start", ["n", "x"], depth, chunk)
    after = timeline.with_previous(got, ["traffic_source_id"], "window_start", ["n"], depth, chunk, "_next", following=True)
    want = after.withColumn("p", F.collect_list(F.struct("n", "x")).over(w.rowsBetween(-depth, -1))).withColumn("q", F.collect_list(F.struct("n")).over(w.rowsBetween(1, depth)))
    rows = want.select("_previous", "p", "_next", "q").collect()
    assert len(rows) == 245 and all(r._previous == r.p and r._next == r.q for r in rows)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_row_index_and_next_value(spark, size):
    df = random_timeline(spark, size)
    chunk = F.floor(F.col("n") / size).cast("long")
    w = Window.partitionBy("traffic_source_id").orderBy("window_start")
    indexed = timeline.with_row_index(df, ["traffic_source_id"], "window_start", chunk, total="total")
    rows = indexed.withColumn("want", F.row_number().over(w) - 1).withColumn("all", F.count("*").over(Window.partitionBy("traffic_source_id"))).collect()
    assert all(r.row_index == r.want and r.total == r["all"] for r in rows)


def ran(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(plan):
    """Exchanges made, reads of one that was there already, and scans."""
    lines = plan.splitlines()
    reused = [line for line in lines if "ReusedExchange" in line]
    return len([line for line in lines if " Exchange " in line]) - len(reused), len(reused), plan.count("FileScan")


def test_rows_move_once(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.range(20_000).selectExpr("concat('s', id % 3) traffic_source_id", "timestamp_seconds(60 * id) window_start", "id n", "id % 7 x", "rand(1) payload").write.parquet(path)
    df = spark.read.parquet(path)
    chunk = F.floor(F.col("n") / 500).cast("long")
    carried = timeline.with_carry(df, ["traffic_source_id"], [F.col("window_start")], chunk, {"sum:before": F.sum("x")}, whole={"sum:all": F.sum("x")})
    previous = timeline.with_previous(df, ["traffic_source_id"], "window_start", ["x"], 3, chunk)
    for out in (carried, previous):
        plan = ran(out)
        # One exchange of the rows; another of chunk totals or of the halo; the second branch reads the first exchange again.
        assert exchanges(plan) == (2, 1, 1), plan
    rows = carried.orderBy("traffic_source_id", "window_start").collect()
    seen = {}
    for r in rows:
        total, at = seen.get(r.traffic_source_id, (0, None))
        if r._chunk != at:
            assert (r.before or 0) == total
        seen[r.traffic_source_id] = (total + r.x, r._chunk)
    assert all(r["all"] == seen[r.traffic_source_id][0] for r in rows)


def test_score_groups_stay_even_when_scores_crowd(spark):
    """Nine of ten scores within a ten-thousandth of each other, two models of very different size."""
    n = 40_000
    score = F.when(F.col("id") % 10 < 9, 0.7 + F.rand(3) / 10_000).otherwise(F.rand(4))
    scored = spark.range(n).select(F.when(F.col("id") % 40 == 0, "small").alias("model"), score.alias("y_score"), (F.rand(5) < 0.3).cast("int").alias("y_true"))
    cells = evaluation.score_cells(evaluation.distinct_scores(scored), rows=1_000).groupBy("model", "_cell").agg(F.count("*").alias("n"), F.max("score").alias("high"), F.min("score").alias("low")).orderBy("model", "_cell").collect()
    large = [c for c in cells if c.model is None]
    mean = sum(c.n for c in large) / len(large)
    assert 30 <= len(large) <= 50 and max(c.n for c in large) <= 2 * mean
    assert all(b.high < a.low for a, b in zip(large, large[1:]))
    curve = evaluation.score_curve(scored).orderBy("model", F.desc("score")).collect()
    seen = {}
    for r in curve:
        tp, fp = seen.get(r.model, (0, 0))
        seen[r.model] = (tp + r.pos, fp + r.neg)
        assert (r.tp, r.fp) == seen[r.model]
    assert all((r.positives, r.negatives) == seen[r.model] for r in curve)


def test_null_timelines_carry_too(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(10)] + [("a", i, 2) for i in range(10)], "traffic_source_id string, n long, x long")
    chunk = F.floor(F.col("n") / 3).cast("long")
    rows = timeline.with_carry(df, ["traffic_source_id"], [F.col("n")], chunk, {"sum:before": F.sum("x")}).collect()
    assert len(rows) == 20 and all((r.before or 0) == (2 if r.traffic_source_id else 1) * (r.n // 3) * 3 for r in rows)


def loop_episodes(truth):
    runs, start = [], None
    for i, value in enumerate([*truth, 0]):
        if value and start is None:
            start = i
        elif not value and start is not None:
            runs.append((start, i - 1))
            start = None
    return runs


def loop_leads(truth, score, threshold, seconds=60):
    leads = []
    for onset, last in loop_episodes(truth):
        if not any(s >= threshold for s in score[onset:]):
            leads.append((onset, last, None))
            continue
        run = 0
        while onset - run - 1 >= 0 and not truth[onset - run - 1] and score[onset - run - 1] >= threshold:
            run += 1
        leads.append((onset, last, run * seconds))
    return leads


def scored(spark, truth, score, model="m"):
    return windows(spark, [("s", i, t, float(s), model) for i, (t, s) in enumerate(zip(truth, score))], "y_true int, y_score double, model string")


# Own series: quiet, a run-up, a late alarm, a lapse before the onset, two episodes, none at all.
SERIES = ["00001110", "0011", "000010000", "01", "0000"]
RAISED = ["00111000", "0001", "110100011", "11", "0110"]


@pytest.mark.parametrize(("truth", "raised"), list(zip(SERIES, RAISED, strict=True)) + [("0001100011", "0110000110")])
@pytest.mark.parametrize("threshold", [0.45, 0.8])
def test_lead_time_summaries_agree_with_the_loop(spark, truth, raised, threshold):
    truth, score = [int(c) for c in truth], [0.7 if c == "1" else 0.2 for c in raised]
    leads = loop_leads(truth, score, threshold)
    found = [lead for *_, lead in leads if lead is not None]
    s = evaluation.lead_time_summary(scored(spark, truth, score), threshold).first()
    assert (s.episodes, s.warned_episodes, s.missed_episodes) == (len(leads), len(found), len(leads) - len(found))
    assert (s.mean_lead_time_sec, s.max_lead_time_sec) == ((sum(found) / len(found), max(found)) if found else (None, None))


def test_false_warnings_use_benign_time(spark):
    s = evaluation.lead_time_summary(scored(spark, [0] * 6 + [1], [0.9] * 3 + [0.1] * 3 + [0.9]), 0.5).first()
    assert s.false_warnings_per_hour == 30.0


@pytest.mark.parametrize("seed", [1, 2])
def test_leads_against_a_loop_over_many_chunks(spark, seed, monkeypatch):
    monkeypatch.setattr(evaluation, "time_chunk", lambda time, seconds: timeline.time_chunk(time, seconds, 7))
    random.seed(seed)
    truth = [int(random.random() < 0.4) for _ in range(200)]
    score = [random.random() for _ in range(180)] + [0.0] * 20
    got = evaluation.lead_times(scored(spark, truth, score), 0.5).collect()
    assert sorted((r.onset_index, r.last_index, r.lead_time_sec) for r in got) == loop_leads(truth, score, 0.5)
    onsets = [a for a, _ in loop_episodes(truth)]
    ahead = evaluation.with_next_onset(scored(spark, truth, score)).collect()
    for r in ahead:
        want = next((o for o in onsets if o >= r.n), None)
        assert (None if r.next_onset is None else r.next_onset.timestamp()) == (None if want is None else want * 60)


def test_ema_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "time_chunk", lambda time, seconds: timeline.time_chunk(time, seconds, 100))
    random.seed(3)
    values = [1e150] + [random.random() * 100 for _ in range(1200)]  # the first value still counts a thousand rows on
    df = windows(spark, [("s", i, v) for i, v in enumerate(values)], "x double")
    got = evaluation.ema_oscillator(df, "x").orderBy("window_start").collect()
    fast = slow = values[0]
    for value, row in zip(values, got):
        if row is not got[0]:
            fast, slow = 0.5 * value + 0.5 * fast, 2 / 11 * value + 9 / 11 * slow
        assert row.ema_fast == pytest.approx(fast, rel=1e-12) and row.ema_slow == pytest.approx(slow, rel=1e-12)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_curve_metrics_against_loops(spark, seed):
    random.seed(seed)
    truth = [int(random.random() < 0.3) for _ in range(300)]
    score = [random.choice([random.random(), 0.25, 0.5]) for _ in truth]
    df = scored(spark, truth, score)
    pos, neg = [s for t, s in zip(truth, score) if t], [s for t, s in zip(truth, score) if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(auc)
    area, before = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        area += tp / (tp + fp) * (tp / len(pos) - before)
        before = tp / len(pos)
    assert evaluation.pr_auc(df).first().pr_auc == pytest.approx(area)
    best = max((sum(p >= t for p in pos) / len(pos), t) for t in {0.0, 1.0, *score} if sum(n >= t for n in neg) / len(neg) <= 0.1)
    row = evaluation.calibrate_threshold(df, 0.1).first()
    assert (row.threshold, row.recall) == (pytest.approx(best[1], abs=5e-5), pytest.approx(best[0], abs=5e-5))


def test_threshold_pins(spark):
    row = evaluation.calibrate_threshold(scored(spark, [1, 0, 1, 0, 1], [0.55, 0.35, 0.95, 0.15, 0.85]), 0.0).first()
    assert (row.threshold, row.recall, row.false_positive_rate) == (0.55, 1.0, 0.0)
    with pytest.raises(ValueError, match="benign and attack"):
        evaluation.require_two_classes(scored(spark, [1, 1], [0.2, 0.9]))
    assert evaluation.roc_auc(scored(spark, [1, 1], [0.2, 0.9])).first().roc_auc is None


def test_split_preflight_and_history(spark):
    df = windows(spark, [("s", i, int(i % 7 == 0)) for i in range(40)], "risk int")
    split = labeling.chrono_split(df, 60, 0.5)
    assert [r.split for r in split.orderBy("n").collect()] == ["train"] * 10 + ["purged"] * 10 + ["test"] * 20
    ready = labeling.dataset_preflight(split).first()
    assert (ready.windows, ready.train_windows, ready.purged_windows, ready.held_out_windows, ready.ready) == (40, 10, 10, 20, True)
    one_class = labeling.dataset_preflight(split.withColumn("risk", (F.col("split") == "test").cast("int"))).first()
    assert not one_class.ready and one_class.message.startswith("training")


def test_gaps_are_listed(spark):
    df = windows(spark, [("a", 1, 0), ("a", 2, 0), ("a", 5, 0), ("b", 9, 0)], "x int")
    got = win.incomplete_windows(df, 60).collect()
    assert sorted(r.window_start.timestamp() / 60 for r in got) == [3, 4] and got[0].missing_fields == ["no_flows_reject"]


def test_long_gaps_and_intervals_are_cut_in_blocks(spark):
    ranges = spark.createDataFrame([("a", 998, 3005), ("b", -1500, -1498), ("c", 5, 4), ("d", 7, 7), ("e", 999_999, 1_000_001), ("n", None, 3)], "k string, a long, b long")
    got = timeline.explode_range(ranges, F.col("a"), F.col("b"), "n").groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    assert {r.k: r.n for r in got} == {"a": list(range(998, 3006)), "b": [-1500, -1499, -1498], "d": [7], "e": [999_999, 1_000_000, 1_000_001]}
    years = 10 * 365 * 1440
    gap = win.incomplete_windows(windows(spark, [("a", 1, 0), ("a", years, 0)], "x int"), 60).agg(F.count(F.lit(1)), F.min("window_start"), F.max("window_end")).first()
    assert gap[0] == years - 2 and (gap[1].timestamp(), gap[2].timestamp()) == (120, years * 60)
    moments = F.timestamp_seconds(F.col("id") * 86400 * 365)
    flows = spark.range(12).select("id", moments.alias("observed_at"))
    span = spark.range(1).select(F.timestamp_seconds(F.lit(86400)).alias("start"), F.timestamp_seconds(F.lit(86400 * 3650)).alias("end"), F.lit("Bot").alias("label"), F.lit(1).alias("line_no"))
    assert sorted(r.id for r in labeling.label_interval_join(flows, span).collect()) == list(range(1, 10))
