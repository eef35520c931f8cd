"""Learned forecasts: risk, stage and dynamics models fitted by Spark, and their roll-out.

Every model is linear in standardised features.  Fits run as distributed jobs; what reaches the
driver is bounded by the number of features (37 x 10), never by the number of rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowcast import fixed_values as fv
from flowcast.operators.evaluation import calibrate_threshold, confusion_metrics, lead_time_summary, pr_auc, roc_auc
from flowcast.operators.features import broken_vector
from flowcast.operators.labeling import history_sequences, latest_history, scaling_stats
from flowcast.operators.windows import SOURCE

N = len(fv.FEATURE_NAMES)
STAGE_PENALTY = 1e-4


@dataclass(frozen=True)
class Scaling:
    mean: tuple[float, ...]
    std: tuple[float, ...]


def fit_scaling(split: DataFrame) -> Scaling:
    """Mean and population deviation over the training part of all given windows: one aggregate row."""
    row = scaling_stats(split, by=()).first()
    return Scaling(tuple(row["mean"]), tuple(row["std"]))


def scaled_vector(scaling: Scaling, prefix: Column | None = None) -> Column:
    """Standardised features of a window as an array, in contract order."""
    read = (lambda n: prefix[n]) if prefix is not None else F.col
    entries = [
        (read(n).cast("double") - F.lit(m)) / F.lit(s) for n, m, s in zip(fv.FEATURE_NAMES, scaling.mean, scaling.std)
    ]
    return F.array(*entries)


def scaled_history(scaling: Scaling, history: str = "history") -> Column:
    """Standardised history flattened oldest first."""
    return F.flatten(F.transform(history, lambda h: scaled_vector(scaling, h)))


@dataclass(frozen=True)
class LinearScore:
    """Coefficients of a logistic model: one row per class, or one row for a binary model."""

    weights: np.ndarray
    bias: np.ndarray


def fit_risk(split: DataFrame, scaling: Scaling, history: bool = False) -> LinearScore:
    """Balanced logistic regression of ``risk`` on the training rows."""
    train = _training_vectors(split, scaling, history)
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("risk").alias("p")).first()
    if not counts.n or counts.p in (0, counts.n, None):
        raise ValueError("the training part needs both benign and attack windows")
    weight = F.when(F.col("risk") == 1, counts.n / (2.0 * counts.p)).otherwise(counts.n / (2.0 * (counts.n - counts.p)))
    data = train.select(F.col("risk").cast("double").alias("label"), "features", weight.alias("weight"))
    fitted = LogisticRegression(
        weightCol="weight", regParam=1.0 / counts.n, standardization=False, maxIter=200, tol=1e-9
    ).fit(data)
    return LinearScore(fitted.coefficientMatrix.toArray(), np.atleast_1d(fitted.interceptVector.toArray()))


def fit_stage(split: DataFrame, scaling: Scaling) -> LinearScore:
    """Multinomial logistic regression of the six stages; a stage never seen gets no chance."""
    train = _training_vectors(split, scaling, False)
    data = train.select(F.col("stage").cast("double").alias("label"), "features")
    seen = [int(r.label) for r in data.select("label").distinct().collect()]  # at most six stages
    fitted = LogisticRegression(family="multinomial", regParam=STAGE_PENALTY, standardization=False, maxIter=500, tol=1e-10).fit(data)
    classes = len(fv.STAGES)
    weights, bias = np.zeros((classes, N)), np.full(classes, -1e9)
    matrix, intercept = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    for stage in seen:
        weights[stage], bias[stage] = matrix[stage], intercept[stage]
    return LinearScore(weights, bias)


# --- Certificates: what a fit must satisfy, one row per parameter, computed from the data once more --------------------


def _dot(x: Column, weights: Sequence[float]) -> Column:
    products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def _gradients(rows: DataFrame, errors: Sequence[Column], penalties: np.ndarray) -> DataFrame:
    """(place, rows, gradient) of a penalised log-loss: the weighted mean of error times input, plus the penalty's part.

    ``rows`` hold ``x`` (inputs and a last 1 for the bias) and ``weight``; places go through the parameters of one
    class after the other.  Sums are combined on the cluster to one vector.
    """
    def pulled(error: Column) -> Column:
        return F.transform("x", lambda v: v * error * F.col("weight"))

    part = F.flatten(F.array(*map(pulled, errors)))
    sums = rows.select(array_to_vector(part).alias("g"), "weight").agg(
        Summarizer.sum(F.col("g")).alias("g"), F.sum("weight").alias("weights"), F.count(F.lit(1)).alias("rows")
    )
    placed = sums.select("weights", "rows", F.posexplode(vector_to_array("g")).alias("place", "g"))
    own = F.get(F.array(*[F.lit(float(v)) for v in penalties.ravel()]), F.col("place"))
    return placed.select("place", "rows", (F.col("g") / F.col("weights") + own).alias("gradient"))


def _with_bias(weights: np.ndarray, penalty: float) -> np.ndarray:
    """The penalty's gradient; the bias has none."""
    return np.hstack([weights * penalty, np.zeros((len(weights), 1))])


def risk_gradients(rows: DataFrame, scaling: Scaling, score: LinearScore, history: bool = False) -> DataFrame:
    """Gradient of the balanced risk fit on the training rows, per parameter: zero at the optimum."""
    train = _training_vectors(rows, scaling, history)
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("risk").alias("p")).first()
    weight = F.when(F.col("risk") == 1, counts.n / (2.0 * counts.p)).otherwise(counts.n / (2.0 * (counts.n - counts.p)))
    x = vector_to_array("features")
    chance = 1.0 / (1.0 + F.exp(-(_dot(x, score.weights[0]) + float(score.bias[0]))))
    data = train.select(F.concat(x, F.array(F.lit(1.0))).alias("x"), weight.alias("weight"), (chance - F.col("risk")).alias("error"))
    return _gradients(data, [F.col("error")], _with_bias(score.weights, 1.0 / counts.n))


def stage_gradients(split: DataFrame, scaling: Scaling, score: LinearScore) -> DataFrame:
    """Gradient of the stage fit on the training rows, per stage and parameter: zero at the optimum of every seen stage."""
    train = _training_vectors(split, scaling, False)
    x = vector_to_array("features")
    seen = [k for k, bias in enumerate(score.bias) if bias > -1e8]
    logits = F.array(*[_dot(x, score.weights[k]) + float(score.bias[k]) for k in seen])
    data = train.select(x.alias("x"), "stage", logits.alias("z")).withColumn("top", F.array_max("z"))
    data = data.withColumn("z", F.transform("z", lambda v: F.exp(v - F.col("top")))).withColumn("total", F.aggregate("z", F.lit(0.0), lambda t, v: t + v))
    errors = F.array(*[F.get("z", F.lit(i)) / F.col("total") - (F.col("stage") == k).cast("double") for i, k in enumerate(seen)])
    data = data.select(F.concat("x", F.array(F.lit(1.0))).alias("x"), errors.alias("error"), F.lit(1.0).alias("weight"))
    found = _gradients(data, [F.get("error", F.lit(i)) for i in range(len(seen))], _with_bias(score.weights[seen], STAGE_PENALTY))
    stage = F.get(F.array(*[F.lit(k) for k in seen]), F.floor(F.col("place") / (N + 1)).cast("int"))
    return found.select(stage.alias("stage"), (F.col("place") % (N + 1)).alias("place"), "rows", "gradient")


def dynamics_residuals(samples: DataFrame, scaling: Scaling, dynamics: np.ndarray, ridge: float = 1.0) -> DataFrame:
    """What is left of the normal equations of the ridge fit, per input and target, as a share of the lengths of both: zero at
    the solution.  Returns place (of the input; the last is the bias), target, rows and residual."""
    width = N * fv.HISTORY_WINDOWS + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, inputs, targets, rows = np.zeros((width, N)), np.zeros(width), np.zeros(N), 0
        for batch in batches:
            x = np.stack(batch["x"].to_numpy())
            x = np.hstack([x, np.ones((len(x), 1))])
            y = np.stack(batch["y"].to_numpy())
            left += x.T @ (y - x @ dynamics)
            inputs, targets, rows = inputs + (x**2).sum(axis=0), targets + (y**2).sum(axis=0), rows + len(x)
        yield pd.DataFrame({"place": np.arange(width), "left": list(left), "inputs": inputs, "targets": [targets] * width, "rows": rows})

    data = samples.filter(F.col("split") == "train").select(scaled_history(scaling).alias("x"), scaled_vector(scaling).alias("y"))
    parts = data.mapInPandas(partial, "place int, left array<double>, inputs double, targets array<double>, rows long")
    summed = parts.groupBy("place").agg(
        Summarizer.sum(array_to_vector("left")).alias("left"), F.sum("inputs").alias("inputs"),
        Summarizer.sum(array_to_vector("targets")).alias("targets"), F.sum("rows").alias("rows"),
    )
    penalty = np.vstack([dynamics[:-1] * ridge, np.zeros((1, N))])
    pulls = data.sparkSession.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(penalty)], "place int, pull array<double>")
    each = summed.join(pulls, "place").select("place", "inputs", "rows", F.posexplode(F.arrays_zip(vector_to_array("left").alias("left"), vector_to_array("targets").alias("y2"), "pull")).alias("target", "v"))
    scale = F.sqrt(F.col("inputs") * F.col("v.y2")) + 1e-12
    return each.select("place", "target", "rows", ((F.col("v.left") - F.col("v.pull")) / scale).alias("residual"))


def _training_vectors(split: DataFrame, scaling: Scaling, history: bool) -> DataFrame:
    vector = scaled_history(scaling) if history else scaled_vector(scaling)
    train = split.filter(F.col("split") == "train")
    return train.select("risk", "stage", array_to_vector(vector).alias("features"))


def fit_dynamics(samples: DataFrame, scaling: Scaling, ridge: float = 1.0) -> np.ndarray:
    """Ridge coefficients (371 x 37, bias last) of the next window on the ten before it.

    All 37 targets share one pass: every task adds up its part of the normal equations, the parts are
    summed row by row on the cluster, and the driver solves one 371 x 371 system.
    """
    width = N * fv.HISTORY_WINDOWS + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + N))
        for batch in batches:
            x = np.stack(batch["x"].to_numpy())
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ np.hstack([x, np.stack(batch["y"].to_numpy())])
        yield pd.DataFrame({"i": np.arange(width), "v": list(total)})

    rows = samples.filter(F.col("split") == "train").select(
        scaled_history(scaling).alias("x"), scaled_vector(scaling).alias("y")
    )
    parts = rows.mapInPandas(partial, "i int, v array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    system = np.zeros((width, width + N))
    for row in summed.select("i", vector_to_array("v").alias("v")).collect():  # 371 rows, whatever the input
        system[row.i] = row.v
    penalty = np.eye(width) * ridge
    penalty[-1, -1] = 0.0
    return np.linalg.solve(system[:, :width] + penalty, system[:, width:])


@dataclass(frozen=True)
class ForecastModel:
    scaling: Scaling
    dynamics: np.ndarray
    risk: LinearScore
    stage: LinearScore

    @property
    def version(self) -> str:
        """Hash of all parameters, so that a forecast names the exact model behind it."""
        parts = (*map(np.asarray, (self.scaling.mean, self.scaling.std)), self.dynamics, self.risk.weights, self.risk.bias,
                 self.stage.weights, self.stage.bias)
        text = json.dumps([np.round(p, 10).tolist() for p in parts])
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()[:16]


def fit_model(split: DataFrame, seconds: int = 60, by: Sequence[str] = SOURCE) -> ForecastModel:
    """Fit all parts on the training windows of ``chrono_split`` output (features, risk, stage, split)."""
    scaling = fit_scaling(split)
    samples = history_sequences(split, seconds, by=by)
    # A sample trains only if its whole history and its target lie in the training part; since the
    # target is the newest of them, its own part decides.
    return ForecastModel(scaling, fit_dynamics(samples, scaling), fit_risk(split, scaling), fit_stage(split, scaling))


def risk_scores(features: DataFrame, scaling: Scaling, model: LinearScore, history: bool = False, name: str = "y_score") -> DataFrame:
    """Probability of a fitted binary model as a column expression; nothing leaves the JVM."""
    vector = scaled_history(scaling) if history else scaled_vector(scaling)
    weights = F.array(*[F.lit(float(w)) for w in model.weights[0]])
    product = F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return features.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-(product + F.lit(float(model.bias[0]))))))


def _softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


ROLLOUT = (
    "risk_timeline array<struct<step:int,risk_score:double,stage:string,stage_confidence:double>>, "
    "contributors array<struct<feature:string,contribution:double,description:string>>"
)


def forecast_rollout(histories: DataFrame, model: ForecastModel, steps: int = fv.FORECAST_STEPS, top: int = 5, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Five-step autoregression per history row: risk and stage of each step, and the features that
    drive the risk at the peak.

    Each Arrow batch is rolled forward as one matrix.  The chain is linear, so the risk gradient at
    step k is one fixed 370-vector per step; the sigmoid only rescales it, and shares do not change.
    """
    width = N * fv.HISTORY_WINDOWS
    coefficients, offset = model.dynamics[:-1], model.dynamics[-1]
    # One step as a map of the flattened history: drop the oldest window, append the predicted one.
    shift = np.zeros((width, width))
    shift[N:, : width - N] = np.eye(width - N)
    shift[:, width - N:] = coefficients
    gradients, power = [], np.eye(width)
    for _ in range(steps):
        gradients.append(np.abs(power @ coefficients @ model.risk.weights[0]))
        power = power @ shift
    gradients = np.stack(gradients)
    risk_w, risk_b, stage_w, stage_b = model.risk.weights[0], model.risk.bias[0], model.stage.weights, model.stage.bias
    names, stages = np.array(fv.FEATURE_NAMES), np.array(fv.STAGES)

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            observed = np.stack(batch["x"].to_numpy())
            current, risks, probabilities = observed, [], []
            for _ in range(steps):
                state = current @ coefficients + offset
                risks.append(1.0 / (1.0 + np.exp(-(state @ risk_w + risk_b))))
                probabilities.append(_softmax(state @ stage_w.T + stage_b))
                current = np.hstack([current[:, N:], state])
            risk, chance = np.stack(risks, 1), np.stack(probabilities, 1)
            best, sure = chance.argmax(2), chance.max(2)
            peak = risk.argmax(1)
            effect = (gradients[peak] * np.abs(observed)).reshape(len(batch), fv.HISTORY_WINDOWS, N).sum(1)
            share = effect / np.where(effect.sum(1, keepdims=True) == 0, 1.0, effect.sum(1, keepdims=True))
            order = np.argsort(-share, axis=1, kind="stable")[:, :top]
            out = batch.drop(columns="x")
            out["risk_timeline"] = [
                [{"step": i + 1, "risk_score": r[i], "stage": stages[b[i]], "stage_confidence": round(s[i], 3)} for i in range(steps)]
                for r, b, s in zip(risk.tolist(), best, sure.tolist())
            ]
            out["contributors"] = [
                [{"feature": names[j], "contribution": float(row[j]), "description": None} for j in chosen]
                for row, chosen in zip(share, order)
            ]
            yield out

    rows = histories.select(*keys, "window_start", scaled_history(model.scaling).alias("x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("x").schema.fields)
    return rows.mapInPandas(roll, f"{schema}, {ROLLOUT}")


def outside_training(vector: Column, scaling: Scaling) -> Column:
    """Whether a window lies far from the windows the model was trained on, in enough features."""
    scores = scaled_vector(scaling, vector)
    return F.size(F.filter(scores, lambda z: F.abs(z) > fv.OOD_Z)) >= fv.OOD_MIN_FEATURES


def learned_forecasts(features: DataFrame, model: ForecastModel, by: Sequence[str] = SOURCE) -> DataFrame:
    """Forecast of every source with enough history, in the common shape of ``forecast_policy``.

    A source with a vector that breaks the contract anywhere in its history gets none.  The newest window is judged
    against the mean and deviation that the model itself was trained with.
    """
    from flowcast.operators.forecasts import PAYLOAD, forecast_confidence, peak_step

    histories = latest_history(features, by=by).filter(~F.exists("history", broken_vector))
    judged_newest = histories.withColumn("is_ood", outside_training(F.element_at("history", -1), model.scaling))
    rolled = forecast_rollout(judged_newest, model, keys=[*by, "is_ood"])
    judged = forecast_confidence(peak_step(rolled))
    named = judged.withColumns({"model_name": F.lit(fv.LEARNED_MODEL_NAME), "model_version": F.lit(model.version)})
    return named.select(*by, *PAYLOAD)


def model_comparison(split: DataFrame, model: ForecastModel, threshold: float = 0.5, budget: float = 0.05, seconds: int = 60, by: Sequence[str] = SOURCE) -> DataFrame:
    """Both scorers on the same held-out windows: metrics, calibrated threshold and lead time per model.

    ``same_window`` scores the window it sees; ``next_window`` forecasts it from the ten before.
    """
    samples = history_sequences(split, seconds, by=by).filter(F.col("split") == "test")
    columns = [*by, "window_start", F.col("risk").alias("y_true"), "y_score"]
    same = risk_scores(samples, model.scaling, model.risk).select(*columns).withColumn("model", F.lit("same_window"))
    rolled = forecast_rollout(samples, model, steps=1, keys=[*by, "risk"])
    following = rolled.withColumn("y_score", F.col("risk_timeline")[0]["risk_score"]).select(*columns)
    scored = same.unionByName(following.withColumn("model", F.lit("next_window")))
    # A source and model together are one timeline.
    leads = lead_time_summary(scored, threshold, seconds, [*by, "model"]).groupBy("model").agg(
        F.sum("episodes").alias("episodes"), F.sum("warned_episodes").alias("warned_episodes"),
        F.max("max_lead_time_sec").alias("max_lead_time_sec"),
    )
    calibrated = calibrate_threshold(scored, budget).select("model", F.col("threshold").alias("calibrated_threshold"))
    result = confusion_metrics(scored, threshold)
    for part in (roc_auc(scored), pr_auc(scored), calibrated, leads):
        result = result.join(part, "model", "left")
    one_class = (F.col("positive_support") == 0) | (F.col("positive_support") == F.col("support"))
    return result.withColumn("caveat", F.when(one_class, "the held-out windows hold a single class"))
