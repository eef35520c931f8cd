"""Text quality by logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader steps.

Words and their shapes (case and marks, with runs shortened) both form n-grams: 1 and 2 words, 1 to 3 shapes. A text's
score is the sparse dot product of its n-gram frequencies with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import slices, table
from flowcast.llm.labelled import fold, labelled_sample

BITS = 18
SAMPLE_ROWS = 4000
THRESHOLD = 0.3
_MARKS = re.compile(r"[\W\d_]+")
_LOWER, _UPPER, _RUNS = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"(.)\1+", re.S)
_known: dict[str, int] = {}
_REMEMBERED = 600_000


def shape(piece: str) -> str:
    """``Word,`` becomes ``Aa,``, ``WORD!!`` becomes ``AA!!`` and ``1234`` becomes ``00``."""
    rough = _LOWER.sub("a", _UPPER.sub(lambda m: "A" if len(m[0]) == 1 else "AA", re.sub(r"\d+", "00", piece)))
    return _RUNS.sub(r"\1\1", rough)


def _codes(pieces: list[str]) -> np.ndarray:
    """Per piece 32 bits of its word's hash and 32 bits of its shape's."""
    if len(_known) > _REMEMBERED:
        _known.clear()
    for piece in set(pieces):
        if piece not in _known:
            raw = piece.encode("utf-8", "surrogatepass")
            word = _MARKS.sub("", piece).lower().encode("utf-8", "surrogatepass") or raw
            form = shape(piece).encode("utf-8", "surrogatepass")
            _known[piece] = xxhash.xxh32_intdigest(word) << 32 | xxhash.xxh32_intdigest(form)
    return np.fromiter(map(_known.__getitem__, pieces), np.uint64, len(pieces))


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (values >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(text: str | None) -> list[np.ndarray]:
    """Hashed n-grams in five groups: words 1, 2 and shapes 1, 2, 3. A text without words has none."""
    codes = _codes(text.split()) if text else np.zeros(0, np.uint64)
    words, forms = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    return [
        _mix(words, 1),
        _mix(words[:-1] * np.uint64(0x100000001B3) + words[1:], 2),
        _mix(forms, 3),
        _mix(forms[:-1] * np.uint64(0x100000001B3) + forms[1:], 4),
        _mix((forms[:-2] * np.uint64(0x100000001B3) + forms[1:-1]) * np.uint64(0x100000001B3) + forms[2:], 5),
    ]


GROUP_WEIGHT = (1.0, 1.0, 4.0, 4.0, 4.0)


@dataclass
class Model:
    """FTRL-proximal state; ``weights`` follow from ``z`` and ``n``. Slot 2**BITS is the bias."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.05
    z: np.ndarray = field(default_factory=lambda: np.zeros(2**BITS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(2**BITS + 1))

    def at(self, slots: np.ndarray) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        w = self.at(slots)
        gradient = (_sigmoid(float(w @ values)) - label) * weight * values
        n = self.n[slots]
        step = (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha
        self.z[slots] += gradient - step * w
        self.n[slots] = n + gradient**2

    def weights(self) -> np.ndarray:
        return self.at(np.arange(2**BITS + 1)).astype(np.float32)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    groups = ngrams(text)
    slots = np.concatenate(groups)
    values = np.concatenate([np.full(len(g), w / len(g)) if len(g) else np.zeros(0) for g, w in zip(groups, GROUP_WEIGHT, strict=True)])
    unique, where = np.unique(slots, return_inverse=True)
    return np.append(unique, 2**BITS), np.append(np.bincount(where, values, len(unique)), 1.0)


def fit(rows: list[tuple[int, str, int]], passes: int = 4) -> np.ndarray:
    """Weights from labelled texts, both classes weighing the same. Without two classes only the bias is fitted."""
    model, good = Model(), sum(label for _, _, label in rows)
    weight = {1: len(rows) / (2 * max(1, good)), 0: len(rows) / (2 * max(1, len(rows) - good))}
    if good in (0, len(rows)):
        rows, weight = [(i, "", label) for i, _, label in rows], {0: 1.0, 1: 1.0}
    vectors = [(*_vector(text), label) for _, text, label in rows]
    order = np.random.default_rng(5)
    for _ in range(passes):
        for i in order.permutation(len(vectors)):
            slots, values, label = vectors[i]
            model.learn(slots, values, label, weight[label])
    return model.weights()


def dot(text: str | None, weights: np.ndarray) -> float:
    total = float(weights[-1])
    for group, weight in zip(ngrams(text), GROUP_WEIGHT, strict=True):
        if len(group):
            total += weight * float(weights[group].sum(dtype=np.float64)) / len(group)
    return total


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold (crc32 mod 5 = 0)."""
    return fit(labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, sample_rows))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score in 0..1 of every whole text; the higher, the likelier label 1.

    Null, empty and blank texts get the score of a text without n-grams. Rows that repeat are scored each; other columns
    are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for part in slices(batch):
                scores = [_sigmoid(dot(text.as_py(), weights)) for text in part["text"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    weights = train(spark, docs, table(spark, folder, "labels"))
    return score(docs, weights).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
