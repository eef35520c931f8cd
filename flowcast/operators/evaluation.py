"""Evaluation of scored windows: ``y_true`` (0/1) and ``y_score`` per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcast.functions import risk
from flowcast.operators.timeline import time_chunk, with_carry, with_previous
from flowcast.operators.windows import SOURCE

MODEL = ("model",)
# Distinct scores of a model that are ordered by one task, and the most such groups a model is cut into.
_CELL_SCORES, _MOST_CELLS = 100_000, 2048


def confusion_metrics(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = MODEL) -> DataFrame:
    """Counts and rates at a threshold, rounded to four digits; a rate without a base is 0."""
    attack, alarm = F.col("y_true") == 1, F.col("y_score") >= threshold
    counted = scored.groupBy(*by).agg(
        F.count_if(~attack & ~alarm).alias("tn"),
        F.count_if(~attack & alarm).alias("fp"),
        F.count_if(attack & ~alarm).alias("fn"),
        F.count_if(attack & alarm).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counted.withColumns(
        {
            "precision": F.bround(risk.ratio(tp, tp + fp), 4),
            "recall": F.bround(risk.ratio(tp, tp + fn), 4),
            "f1": F.bround(risk.ratio(tp * 2, tp * 2 + fp + fn), 4),
            "false_positive_rate": F.bround(risk.ratio(fp, fp + tn), 4),
            "support": tn + fp + fn + tp,
            "positive_support": fn + tp,
        }
    )


def f2_score(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = MODEL) -> DataFrame:
    attack, alarm = F.col("y_true") == 1, F.col("y_score") >= threshold
    counted = scored.groupBy(*by).agg(
        F.count_if(attack & alarm).alias("_tp"), F.count_if(alarm).alias("_alarms"), F.count_if(attack).alias("_attacks")
    )
    precision = risk.ratio(F.col("_tp"), F.col("_alarms"))
    recall = risk.ratio(F.col("_tp"), F.col("_attacks"))
    return counted.select(*by, risk.f2(precision, recall).alias("f2"))


def distinct_scores(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Windows collapsed to distinct scores: attacks (``pos``) and benign windows (``neg``) at each."""
    return scored.groupBy(*by, F.col("y_score").alias("score")).agg(
        F.sum(F.col("y_true").cast("bigint")).alias("pos"), F.sum(1 - F.col("y_true").cast("bigint")).alias("neg")
    )


def score_cells(distinct: DataFrame, by: Sequence[str] = MODEL, rows: int = _CELL_SCORES) -> DataFrame:
    """Add ``_cell``: the ordered group of a score, highest scores first, about ``rows`` distinct scores each.

    The splitters are quantiles of the model's own distinct scores, so groups are even wherever scores crowd.  They
    are one sorted array per model, searched by bisection.
    """
    steps = [2**k for k in reversed(range(_MOST_CELLS.bit_length() - 1))]
    quantiles = F.array(*[F.lit(i / _MOST_CELLS) for i in range(1, _MOST_CELLS)])
    sizes = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("score", quantiles, F.lit(4 * _MOST_CELLS)).alias("_quantiles"))
    # Every so many of the finest quantiles, as many as the model's size asks for.
    wanted = F.least(F.ceil(F.col("_n") / F.lit(rows)), F.lit(_MOST_CELLS))
    places = F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))), lambda k: F.floor(k * _MOST_CELLS / wanted).cast("int"))
    chosen = F.array_distinct(F.transform(places, lambda k: F.get("_quantiles", k - 1)))
    splitters = sizes.select(*by, F.when(wanted > 1, chosen).otherwise(F.array().cast("array<double>")).alias("_splitters"))
    keyed = splitters.withColumnsRenamed({key: f"_of_{key}" for key in by})
    joined = distinct.join(keyed, [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in by], "left").drop(*[f"_of_{key}" for key in by])

    def bisect(found: Column, step: Column) -> Column:
        """``found`` splitters lie below the score; are ``step`` more of them?"""
        return F.when(F.get("_splitters", found + step - 1) < F.col("score"), found + step).otherwise(found)

    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), bisect)
    return joined.withColumn("_cell", -below).drop("_splitters")


def score_curve(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Per distinct score: attacks and benign windows at it (``pos``, ``neg``), at or above it
    (``tp``, ``fp``), and in total (``positives``, ``negatives``).

    The running sums go through groups of neighbouring scores and, in them, from score to score, so no
    task orders all scores.
    """
    carried = with_carry(
        score_cells(distinct_scores(scored, by), by), by, [F.desc("score")], F.col("_cell"),
        {"sum:_pos_above": F.sum("pos"), "sum:_neg_above": F.sum("neg")},
        whole={"sum:positives": F.sum("pos"), "sum:negatives": F.sum("neg")},
    )
    local = Window.partitionBy(*by, "_chunk").orderBy("_position").rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumns(
        {
            "tp": F.coalesce("_pos_above", F.lit(0)) + F.sum("pos").over(local),
            "fp": F.coalesce("_neg_above", F.lit(0)) + F.sum("neg").over(local),
        }
    ).drop("_cell", "_chunk", "_position", "_pos_above", "_neg_above")


def roc_auc(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Chance that an attack window scores above a benign one, ties counting half; NULL with one class."""
    below = F.col("negatives") - F.col("fp")
    pairs = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    area = score_curve(scored, by).groupBy(*by).agg(
        pairs.alias("_pairs"), F.max("positives").alias("_p"), F.max("negatives").alias("_n")
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return area.select(*by, F.when(both, F.col("_pairs") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"))


def pr_auc(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Average precision over the distinct thresholds; NULL with one class."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = score_curve(scored, by).groupBy(*by).agg(
        F.sum(F.col("pos") * precision).alias("_sum"), F.max("positives").alias("_p"), F.max("negatives").alias("_n")
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return area.select(*by, F.when(both, F.col("_sum") / F.col("_p")).alias("pr_auc"))


def calibrate_threshold(scored: DataFrame, max_false_positive_rate: float = 0.05, by: Sequence[str] = MODEL) -> DataFrame:
    """Threshold with the highest recall inside the false-positive budget, the highest one on ties.

    Candidates are the scores, 0 and 1.  A threshold between two scores acts like the next score above
    it, so 0 and 1 need only their own totals.  One-class data has no answer (all NULL) -- see
    ``require_two_classes``.
    """
    if not 0.0 <= max_false_positive_rate <= 1.0:
        raise ValueError("the share of false alarms allowed lies between 0 and 1")
    recall = F.col("tp") / F.col("positives")
    rate = F.col("fp") / F.col("negatives")
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)

    def best(recall_: Column, threshold: Column, rate_: Column) -> Column:
        choice = F.struct(recall_.alias("recall"), threshold.alias("threshold"), rate_.alias("rate"))
        return F.when(rate_ <= max_false_positive_rate, choice)

    def at(threshold: float, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("score") >= threshold, F.col(column))), F.lit(0))

    curve = score_curve(scored, by).filter(both)
    found = curve.groupBy(*by).agg(
        F.max(best(recall, F.col("score").cast("double"), rate)).alias("_best"),
        *[at(t, c).alias(f"_{c}_{int(t)}") for t in (0.0, 1.0) for c in ("pos", "neg")],
        F.max("positives").alias("_p"),
        F.max("negatives").alias("_n"),
    )
    fixed = [best(F.col(f"_pos_{t}") / F.col("_p"), F.lit(float(t)), F.col(f"_neg_{t}") / F.col("_n")) for t in (0, 1)]
    none = F.struct(F.lit(0.0).alias("recall"), F.lit(1.0).alias("threshold"), F.lit(0.0).alias("rate"))
    chosen = F.coalesce(F.greatest(F.col("_best"), *fixed), none)
    return found.withColumn("_chosen", chosen).select(
        *by,
        F.bround("_chosen.threshold", 4).alias("threshold"),
        F.bround("_chosen.recall", 4).alias("recall"),
        F.bround("_chosen.rate", 4).alias("false_positive_rate"),
        F.lit(max_false_positive_rate).alias("max_false_positive_rate"),
    )


def require_two_classes(scored: DataFrame) -> None:
    """Refuse data without both benign and attack windows."""
    row = scored.agg(F.min("y_true").alias("low"), F.max("y_true").alias("high")).first()
    if (row.low, row.high) != (0, 1):
        raise ValueError("the held-out part needs both benign and attack windows")


# --- Episodes and lead time ---------------------------------------------------------------


def _runs(df: DataFrame, flags: dict[str, Column], seconds: int, by: Sequence[str], whole: dict[str, Column] | None = None) -> DataFrame:
    """Maximal runs of consecutive windows per exclusive flag.

    Inside a run the window position and the count of flagged windows grow together, so their
    difference names the run.  Both counts come from one pass over the timeline.
    """
    chunk = time_chunk(F.col("window_start"), seconds)
    marked = df.withColumns({f"_is_{name}": F.coalesce(flag, F.lit(False)) for name, flag in flags.items()})
    totals = {"sum:_rows_before": F.count(F.lit(1))}
    totals.update({f"sum:_{n}_before": F.count_if(F.col(f"_is_{n}")) for n in flags})
    carried = with_carry(marked, by, [F.col("window_start")], chunk, totals, whole=whole)
    local = Window.partitionBy(*by, "_chunk").orderBy("_position").rowsBetween(Window.unboundedPreceding, 0)
    index = F.coalesce("_rows_before", F.lit(0)) + F.col("_position") - 1
    kind, island = None, None
    for name in flags:
        flag = F.col(f"_is_{name}")
        rank = F.coalesce(F.col(f"_{name}_before"), F.lit(0)) + F.count_if(flag).over(local)
        kind = F.when(flag, name) if kind is None else kind.when(flag, name)
        island = F.when(flag, index - rank) if island is None else island.when(flag, index - rank)
    placed = carried.withColumns({"row_index": index.cast("bigint"), "kind": kind, "_island": island})
    extra = [F.max(key.split(":")[1]).alias(key.split(":")[1]) for key in (whole or {})]
    return placed.filter(F.col("kind").isNotNull()).groupBy(*by, "kind", "_island").agg(
        F.min("row_index").alias("first_index"),
        F.max("row_index").alias("last_index"),
        F.min("window_start").alias("first_start"),
        F.max("window_start").alias("last_start"),
        *extra,
    ).drop("_island")


def attack_episodes(labeled: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Maximal runs of attack windows as inclusive positions and times."""
    return _runs(labeled, {"attack": F.col("y_true") == 1}, seconds, by).drop("kind")


def lead_times(scored: DataFrame, threshold: float = 0.5, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Per episode: seconds of unbroken alarmed benign windows right before onset.

    An episode is missed (NULL lead) when no window from its onset to the end of the timeline alarms.
    """
    attack, alarm = F.col("y_true") == 1, F.col("y_score") >= threshold
    last_alarm = {"max:_last_alarm": F.max(F.when(alarm, F.col("window_start")))}
    runs = _runs(scored, {"attack": attack, "warning": ~attack & alarm}, seconds, by, whole=last_alarm)
    # The run just before an attack run is its warning if it ends at the window before the onset.
    chunk = F.floor(F.col("first_index") / 1440).cast("bigint")
    paired = with_previous(runs, by, "first_index", ["kind", "first_index", "last_index"], 1, chunk)
    before = F.get("_previous", F.lit(0))
    adjacent = (before["kind"] == "warning") & (before["last_index"] == F.col("first_index") - 1)
    length = F.when(adjacent, before["last_index"] - before["first_index"] + 1).otherwise(F.lit(0))
    missed = F.coalesce(F.col("_last_alarm") < F.col("first_start"), F.lit(True))
    return paired.filter(F.col("kind") == "attack").select(
        *by,
        F.col("first_index").alias("onset_index"),
        F.col("last_index"),
        F.col("first_start").alias("onset"),
        missed.alias("missed"),
        F.when(~missed, length * seconds).cast("bigint").alias("lead_time_sec"),
    )


def lead_time_summary(scored: DataFrame, threshold: float = 0.5, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Episodes, warned, missed, lead statistics and false warnings per benign hour."""
    benign, alarm = F.col("y_true") == 0, F.col("y_score") >= threshold
    noise = scored.groupBy(*by).agg(
        F.count_if(benign).alias("_benign"), F.count_if(benign & alarm).alias("_false")
    )
    leads = lead_times(scored, threshold, seconds, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count("lead_time_sec").alias("warned_episodes"),
        F.count_if("missed").alias("missed_episodes"),
        F.bround(F.avg("lead_time_sec"), 1).alias("mean_lead_time_sec"),
        F.bround(F.median("lead_time_sec"), 1).alias("median_lead_time_sec"),
        F.max("lead_time_sec").alias("max_lead_time_sec"),
    )
    hours = F.col("_benign") * seconds / 3600.0
    joined = noise.join(leads, list(by), "left") if by else _one_row(noise, leads)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("episodes", "warned_episodes", "missed_episodes")}
    return joined.withColumns(zero).withColumn(
        "false_warnings_per_hour", F.when(F.col("_benign") > 0, F.bround(F.col("_false") / hours, 2))
    ).drop("_benign", "_false")


def _one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row frames side by side."""
    key = "_row"
    return left.withColumn(key, F.lit(1)).join(right.withColumn(key, F.lit(1)), key, "left").drop(key)


# --- Research metrics ---------------------------------------------------------------------


def _warning_epochs(episodes: DataFrame, seconds: int, horizon: int) -> Column:
    """Epochs on the window grid at most ``horizon`` before an onset, the onset included."""
    onset = F.unix_seconds("first_start")
    steps = horizon // seconds * seconds
    return F.sequence(onset - steps, onset, F.lit(seconds).cast("bigint"))


def horizon_lead_time(
    scored: DataFrame, threshold: float = 0.5, seconds: int = 60, horizon: int = 300, by: Sequence[str] = SOURCE
) -> DataFrame:
    """Per episode: lead of the earliest alarm in ``[onset - horizon, onset]``, NULL when there is none.

    An alarm's epoch is the end of the window it was raised on.  Each episode generates its few
    warning epochs, which meet the alarms by equality.
    """
    episodes = attack_episodes(scored, seconds, by)
    alarms = scored.filter(F.col("y_score") >= threshold).select(*by, (F.unix_seconds("window_start") + seconds).alias("_t"))
    epochs = episodes.withColumn("_t", F.explode(_warning_epochs(episodes, seconds, horizon)))
    hits = epochs.join(alarms.withColumn("_hit", F.lit(1)), [*by, "_t"], "left")
    earliest = F.min(F.when(F.col("_hit") == 1, F.col("_t")))
    return hits.groupBy(*by, F.col("first_start").alias("onset")).agg(
        (F.unix_seconds(F.first("first_start")) - earliest).alias("lead_time_sec")
    )


def horizon_lead_summary(leads: DataFrame, targets: Sequence[int] = (30, 60, 120), by: Sequence[str] = SOURCE) -> DataFrame:
    """Mean lead of the detected episodes and the share of episodes with at least each target lead."""
    return leads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count("lead_time_sec").alias("detected"),
        F.avg("lead_time_sec").alias("mean_lead_time_sec"),
        *[
            F.avg(F.when(F.coalesce("lead_time_sec", F.lit(0)) >= t, 1.0).otherwise(0.0)).alias(f"coverage_{t}s")
            for t in targets
        ],
    )


def alert_usefulness(
    scored: DataFrame, threshold: float = 0.5, seconds: int = 60, horizon: int = 300, by: Sequence[str] = SOURCE
) -> DataFrame:
    """Share of alarms with an onset at most ``horizon`` later, and useless alarms per hour."""
    episodes = attack_episodes(scored, seconds, by)
    useful = episodes.select(*by, F.explode(_warning_epochs(episodes, seconds, horizon)).alias("_t")).distinct()
    rows = scored.select(
        *by, (F.unix_seconds("window_start") + seconds).alias("_t"), (F.col("y_score") >= threshold).alias("_alarm")
    )
    marked = rows.join(useful.withColumn("_useful", F.lit(1)), [*by, "_t"], "left")
    counted = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_windows"),
        F.count_if("_alarm").alias("alarms"),
        F.count_if(F.col("_alarm") & (F.col("_useful") == 1)).alias("useful_alarms"),
    )
    hours = F.col("_windows") * seconds / 3600.0
    return counted.withColumns(
        {
            "alert_usefulness_rate": F.when(F.col("alarms") > 0, F.col("useful_alarms") / F.col("alarms")),
            "false_warnings_per_hour": (F.col("alarms") - F.col("useful_alarms")) / hours,
        }
    ).drop("_windows")


def focal_loss(scored: DataFrame, gamma: float = 2.0, alpha: float = 0.75, by: Sequence[str] = MODEL) -> DataFrame:
    loss = risk.focal_loss(F.col("y_true"), F.col("y_score"), gamma, alpha)
    return scored.groupBy(*by).agg(F.avg(loss).alias("focal_loss"))


def with_next_onset(scored: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Add ``next_onset``: the first attack onset at or after each window's start."""
    chunk = time_chunk(F.col("window_start"), seconds)
    lagged = with_previous(scored, by, "window_start", ["y_true"], 1, chunk)
    was_attack = F.coalesce(F.get("_previous", F.lit(0))["y_true"] == 1, F.lit(False))
    onset = F.when((F.col("y_true") == 1) & ~was_attack, F.col("window_start"))
    marked = lagged.withColumn("_onset", onset).drop("_previous")
    carried = with_carry(
        marked, by, [F.col("window_start")], chunk, {"min:_later": F.min("_onset")}, following=True
    )
    local = Window.partitionBy(*by, "_chunk").orderBy("_position").rowsBetween(0, Window.unboundedFollowing)
    return carried.withColumn("next_onset", F.coalesce(F.min("_onset").over(local), F.col("_later"))).drop(
        "_onset", "_later", "_chunk", "_position"
    )


def cost_lead_loss(
    scored: DataFrame, threshold: float = 0.5, seconds: int = 60, horizon: int = 300,
    late: float = 5.0, decay: float = 30.0, early: float = 1.0, by: Sequence[str] = SOURCE,
) -> DataFrame:
    """Mean focal loss weighted by timing: unalarmed attacks cost more the nearer the onset, early false
    alarms more the further away it is."""
    df = with_next_onset(scored, seconds, by)
    ahead = F.coalesce(F.unix_seconds("next_onset") - F.unix_seconds("window_start"), F.lit(0)).cast("double")
    alarm = F.col("y_score") >= threshold
    penalty = (
        F.when((F.col("y_true") == 1) & ~alarm, 1.0 + late * F.exp(-F.greatest(F.lit(0.0), ahead) / decay))
        .when((F.col("y_true") == 0) & alarm, 1.0 + early * F.greatest(F.lit(0.0), (ahead - horizon) / horizon))
        .otherwise(F.lit(1.0))
    )
    loss = risk.focal_loss(F.col("y_true"), F.col("y_score")) * penalty
    return df.groupBy(*by).agg(F.avg(loss).alias("cost_lead_loss"))


_EMA_ROWS = 256


def ema_oscillator(features: DataFrame, name: str, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Fast minus slow exponential mean (weights 1/2 and 2/11), both starting at the first value.

    Inside a block of 256 rows the means are running weighted sums.  A block as a whole maps the mean before it to
    ``keep^256 * before + its own sum``; these maps are composed over the blocks before.  Powers of ``keep`` are left out
    of a composition only where a double holds them as zero, so nothing that counts is cut off.
    """
    from flowcast.operators.timeline import with_row_index

    indexed = with_row_index(features.select(*by, "window_start", name), by, "window_start", time_chunk(F.col("window_start"), seconds))
    indexed = indexed.withColumn("_block", F.floor(F.col("row_index") / _EMA_ROWS).cast("bigint"))
    position = (F.col("row_index") % _EMA_ROWS).cast("double")
    running = Window.partitionBy(*by, "_block").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    weights = {"fast": 0.5, "slow": 2.0 / 11.0}

    def own(weight: float) -> Column:
        keep = F.lit(1.0 - weight)
        share = F.when(F.col("row_index") == 0, F.lit(1.0)).otherwise(F.lit(weight))
        return F.sum(share * F.col(name) * F.pow(keep, -position)).over(running) * F.pow(keep, position)

    local = indexed.withColumns({f"_{kind}": own(weight) for kind, weight in weights.items()})
    blocks = local.groupBy(*by, "_block").agg(*[F.max_by(f"_{kind}", "row_index").alias(f"_{kind}") for kind in weights])
    order = Window.partitionBy(*by).orderBy("_block")

    def before(kind: str, weight: float) -> Column:
        total, power, back = F.lit(0.0), 1.0, 1
        while power > 0.0:
            total = total + F.coalesce(F.lag(f"_{kind}", back).over(order), F.lit(0.0)) * F.lit(power)
            power, back = (1.0 - weight) ** (_EMA_ROWS * back), back + 1
        return total

    carried = blocks.select(*by, "_block", *[before(kind, weight).alias(f"_{kind}_before") for kind, weight in weights.items()])
    joined = local.join(carried, [*by, "_block"])
    scored = joined.withColumns(
        {f"ema_{kind}": F.col(f"_{kind}") + F.col(f"_{kind}_before") * F.pow(F.lit(1.0 - weight), position + 1) for kind, weight in weights.items()})
    return scored.select(
        *by, "window_start", "ema_fast", "ema_slow", (F.col("ema_fast") - F.col("ema_slow")).alias("oscillator")
    )


def stage_transitions(timeline: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Windows whose stage differs from the previous window's."""
    lagged = with_previous(timeline, by, "window_start", ["stage"], 1, time_chunk(F.col("window_start"), seconds))
    before = F.get("_previous", F.lit(0))["stage"]
    changed = lagged.withColumn("from_stage", before).filter(before.isNotNull() & (before != F.col("stage")))
    return changed.select(*by, "window_start", "from_stage", F.col("stage").alias("to_stage"))


def step_transitions(timeline: Column) -> Column:
    """Steps of a forecast timeline whose stage differs from the step before."""
    return F.filter(timeline, lambda p, i: (i > 0) & (F.get(timeline, i - 1)["stage"] != p["stage"]))
