"""Toxic texts by a support vector machine over the gap-weighted subsequence kernel with Nystroem landmarks.

A text is a bag of sentences and a sentence a bag of units: words reduced to their letters, and runs of single letters
joined. The kernel counts common subsequences of three letters, weighing gaps down, so ``id-iot``, ``idxiot`` and
``i d i o t`` stay close to ``idiot``. Landmarks are the units that tell toxic documents from others, and clean units that
look like them. A sentence is mapped to its largest kernel values with the landmarks; a linear machine on the whitened
map is the kernel machine. Labels mark documents, so training picks the sentences of each toxic document closest to the
telling landmarks and the one that the current machine finds worst, and repeats. A document scores as its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import parts_of, release_memory, table
from flowcast.llm.labelled import fold, labelled_sample

SAMPLE_ROWS = 4000
THRESHOLD = 0.3
LENGTH, DECAY = 3, 0.6
FLOOR = 0.4  # kernel values below count as none
WINDOW, STEP = 9, 3  # longer units are read in overlapping windows
STEMS = range(4, 9)  # lengths of the substrings that may become landmarks
LANDMARKS, LOOKALIKES, COVER = 40, 16, 3
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LEET = str.maketrans("0134579", "oieastg")
_ENDS = (".", "!", "?")


def unit_of(piece: str) -> str:
    """The letters of a piece in lower case; digits inside words stand for the letters they resemble."""
    piece = piece.lower()
    if not piece.isdigit() and any(c in piece for c in "0134579"):
        letters = _NOT_LETTERS.sub("", piece)
        if len(letters) >= 2:
            piece = piece.translate(_LEET)
    return _NOT_LETTERS.sub("", piece)


def _coded(units: list[str], pad: int) -> np.ndarray:
    out = np.full((len(units), max(map(len, units), default=1)), pad, dtype=np.int32)
    for row, unit in zip(out, units, strict=True):
        row[:len(unit)] = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: weight of the common subsequences of ``LENGTH`` letters in padded code arrays (pads never match)."""
    rows, width = a.shape[0], b.shape[1]
    prefix = [np.ones((rows, width + 1))] + [np.zeros((rows, width + 1)) for _ in range(LENGTH - 1)]
    total = np.zeros(rows)
    for j in range(a.shape[1]):
        same = (a[:, j:j + 1] == b) * DECAY**2
        total += (same * prefix[LENGTH - 1][:, :-1]).sum(axis=1)
        for i in range(LENGTH - 1, 0, -1):  # from the longest down: each uses the shorter ones before this letter
            gained, run = same * prefix[i - 1][:, :-1], np.zeros(rows)
            prefix[i] *= DECAY
            for k in range(width):
                run = run * DECAY + gained[:, k]
                prefix[i][:, k + 1] += run
    return total


def _letters(units: list[str]) -> np.ndarray:
    """One bit per letter of a unit (hashed to 63)."""
    return np.array([sum(1 << b for b in {ord(c) % 61 for c in unit}) for unit in units], dtype=np.uint64)


class Landmarks:
    def __init__(self, units: list[str]):
        self.units = units
        self.codes = _coded(units, -2)
        self.norm = np.sqrt(subsequence_kernel(_coded(units, -1), self.codes))
        self.bits = _letters(units)
        counts = np.bitwise_count(self.bits)
        self.needed = counts - (counts >= 5)  # letters a unit must share at least: all, or all but one of five and more

    def values(self, units: list[str]) -> np.ndarray:
        """Normalised kernel of each unit with each landmark; none below ``FLOOR`` or without the landmark's letters."""
        out = np.zeros((len(units), len(self.units)), dtype=np.float32)
        parts = [(i, unit[at:at + WINDOW]) for i, unit in enumerate(units) for at in range(0, max(1, len(unit) - WINDOW + STEP), STEP)]
        for at in range(0, len(parts), 20_000):
            some = parts[at:at + 20_000]
            bits = _letters([p for _, p in some])
            unit, mark = np.nonzero(np.bitwise_count(bits[:, None] & self.bits[None, :]) >= self.needed[None, :])
            if not len(unit):
                continue
            texts, where = np.unique(unit, return_inverse=True)
            own = _coded([some[i][1] for i in texts], -1)
            norms = np.sqrt(subsequence_kernel(own, np.where(own < 0, -2, own)))
            for k in range(0, len(unit), 20_000):
                w, m = where[k:k + 20_000], mark[k:k + 20_000]
                scale = norms[w] * self.norm[m]
                value = np.divide(subsequence_kernel(own[w], self.codes[m]), scale, out=np.zeros(len(w)), where=scale > 0)
                value[value < FLOOR] = 0
                np.maximum.at(out, (np.array([some[i][0] for i in texts])[w], m), value.astype(np.float32))
        return out


class Reader:
    """Turns texts into sentences of landmark values; remembers what each piece is worth."""

    def __init__(self, landmarks: Landmarks, remembered: int = 200_000):
        self.landmarks, self.remembered = landmarks, remembered
        self._forget()

    def _forget(self) -> None:
        """Pieces and the value rows they point to go together; row 0 has no values."""
        none = bytes(4 * len(self.landmarks.units))
        self._known: dict[str, int] = {}
        self._rows: dict[bytes, int] = {none: 0}
        self._table = np.frombuffer(none, dtype=np.float32)[None, :]

    def _values(self) -> np.ndarray:
        """The distinct rows of values, stacked anew only when there are more of them."""
        if len(self._table) < len(self._rows):
            self._table = np.frombuffer(b"".join(self._rows), dtype=np.float32).reshape(len(self._rows), -1)
        return self._table

    def _learn(self, pieces: list[str]) -> None:
        units = [unit_of(piece) for piece in pieces]
        distinct = list(dict.fromkeys(unit for unit in units if len(unit) >= LENGTH))
        values = dict(zip(distinct, self.landmarks.values(distinct), strict=True)) if distinct else {}
        for piece, unit in zip(pieces, units, strict=True):
            row = self._rows.setdefault(values[unit].tobytes(), len(self._rows)) if unit in values else 0
            # Bit 0: ends a sentence; bit 1: a single letter.
            self._known[piece] = row << 2 | (len(unit) == 1) << 1 | piece.endswith(_ENDS)

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its sentences with any value, one row of landmark values each."""
        split = [text.split() for text in texts]
        if len(self._known) > self.remembered:
            self._forget()
        known = self._known
        self._learn([piece for piece in set().union(*split) if piece not in known])
        codes = [np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)) for pieces in split]
        joined = [self._spelled(pieces, code) for pieces, code in zip(split, codes, strict=True)]
        self._learn(list({unit for runs in joined for _, unit in runs} - known.keys()))
        table = self._values()
        out = []
        for code, runs in zip(codes, joined, strict=True):
            at = np.flatnonzero(code >> 2)
            rows = code[at] >> 2
            if runs:
                at = np.concatenate([at, [i for i, _ in runs]])
                rows = np.concatenate([rows, [known[unit] >> 2 for _, unit in runs]])
            if not len(at):
                out.append(np.zeros((0, table.shape[1]), np.float32))
                continue
            ends = np.flatnonzero(code & 1)
            number = np.searchsorted(ends, at)
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.diff(number[order], prepend=-1))
            out.append(np.maximum.reduceat(table[rows[order]], first, axis=0))
        return out

    @staticmethod
    def _spelled(pieces: list[str], code: np.ndarray) -> list[tuple[int, str]]:
        """Runs of at least four single letters, joined to a unit."""
        single = np.flatnonzero(code & 2)
        if len(single) < 4:
            return []
        starts = np.flatnonzero(np.diff(single, prepend=-9) != 1)
        ends = np.append(starts[1:], len(single))
        return [(int(single[a]), "".join(unit_of(pieces[i]) for i in single[a:b])) for a, b in zip(starts, ends, strict=True) if b - a >= 4]


@dataclass
class Model:
    """Kernel weights per landmark and the slope and shift that turn a margin into a score."""

    landmarks: Landmarks | None
    beta: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, sentences: np.ndarray) -> float:
        return float((sentences @ self.beta).max(initial=0.0)) + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _stems(text: str, lengths=STEMS) -> set[str]:
    units = set(map(unit_of, set(text.split())))
    return {unit[at:at + n] for unit in units for n in lengths for at in range(len(unit) - n + 1)}


def choose_landmarks(texts: list[str], labels: np.ndarray) -> tuple[list[str], list[str]]:
    """Substrings of units that cover the toxic documents and few clean ones, then clean substrings nearest to them."""
    toxic_texts = [text for text, label in zip(texts, labels, strict=True) if label]
    clean_texts = [text for text, label in zip(texts, labels, strict=True) if not label]
    # A stem is only as frequent as the stems it is made of, so longer ones are counted only where both of those remain.
    held: dict[str, int] = {}
    for n in STEMS:
        counts: Counter[str] = Counter()
        for text in toxic_texts:
            counts.update({s for s in _stems(text, (n,)) if n == STEMS[0] or (s[1:] in held and s[:-1] in held)})
        held.update({stem: k for stem, k in counts.items() if k >= max(4, len(toxic_texts) // 100)})
    toxic = [_stems(text) & held.keys() for text in toxic_texts]
    clean: Counter[str] = Counter()
    for text in clean_texts:
        clean.update(_stems(text) & held.keys())
    # Telling stems: at least thirty times as frequent among toxic documents.
    telling = {s for s, n in held.items() if 30 * clean[s] * len(toxic) <= n * len(clean_texts)}
    missing, holders = [COVER] * len(toxic), {}
    for i, stems in enumerate(toxic):
        for stem in stems & telling:
            holders.setdefault(stem, []).append(i)
    chosen: list[str] = []
    while holders and len(chosen) < LANDMARKS:
        # Longer stems are the purer ones, and rare finds in clean documents count against a stem.
        gain = {s: sum(missing[i] for i in own) * (1 + len(s) / 10) - clean[s] for s, own in holders.items()}
        best = max(gain, key=lambda stem: (gain[stem], stem))
        if gain[best] < 5 * COVER:
            break
        chosen.append(best)
        for i in holders.pop(best):
            missing[i] = max(0, missing[i] - 1)
        holders = {stem: own for stem, own in holders.items() if stem not in best and best not in stem}
    if not chosen:
        return [], []
    others = [s for s, _ in sorted(((s, n) for s, n in clean.items() if s not in telling), key=lambda x: (-x[1], x[0]))[:20_000]]
    near = Landmarks(chosen).values(others).max(axis=1) if others else np.zeros(0)
    return chosen, [others[i] for i in np.argsort(-near, kind="stable")[:LOOKALIKES] if near[i] > 0]


def _tampered(unit: str) -> list[str]:
    """Forms of a longer telling unit with one letter put in or left out, as further toxic examples."""
    inner = range(1, len(unit)) if len(unit) >= 5 else ()
    return [unit[:i] + c + unit[i:] for i in inner for c in ("x", unit[i])] + [unit[:i] + unit[i + 1:] for i in inner if len(unit) >= 6]


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = 12) -> tuple[np.ndarray, float]:
    """Linear machine with hinge loss by dual coordinate steps; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x**2).sum(axis=1)
    order = np.random.default_rng(3)
    for _ in range(passes):
        for i in order.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0, weight[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[int, str, int]], rounds: int = 2) -> Model:
    """A model from (doc_id, text, label) rows. Without both classes, or without telling units, all texts score alike."""
    labels = np.array([label for *_, label in rows], dtype=int)
    rate = float(labels.mean()) if len(rows) else 0.0
    flat = Model(None, np.zeros(0), 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    if not 0 < rate < 1:
        return flat
    texts = [text for _, text, _ in rows]
    telling, lookalikes = choose_landmarks(texts, labels)
    if not telling:
        return flat
    units = telling + lookalikes
    landmarks = Landmarks(units)
    sentences = Reader(landmarks).sentences(texts)
    gram = landmarks.values(units).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    white = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    clean = np.vstack([s for s, label in zip(sentences, labels, strict=True) if not label] + [np.zeros((1, len(units)))])
    clean = clean[np.random.default_rng(1).permutation(len(clean))[:20_000]] if len(clean) > 20_000 else clean
    toxic = [s for s, label in zip(sentences, labels, strict=True) if label and len(s)]
    variants = sorted({v for unit in telling for v in _tampered(unit)} - set(lookalikes))
    tampered = landmarks.values(variants) if variants else np.zeros((0, len(units)))
    beta, bias = np.ones(len(units)), 0.0
    for _ in range(rounds):
        # The sentence closest to each telling landmark, and the worst one for the machine so far.
        picked = [np.unique(np.append(s[:, :len(telling)].argmax(axis=0)[s[:, :len(telling)].max(axis=0) >= 0.6], np.argmax(s @ beta))) for s in toxic]
        worst = np.vstack([s[p] for s, p in zip(toxic, picked, strict=True)]) if toxic else np.zeros((0, len(units)))
        worst = np.vstack([worst, tampered])
        w, bias = _machine(np.vstack([worst, clean]) @ white, np.r_[np.ones(len(worst)), -np.ones(len(clean))])
        beta = white @ w
    model = Model(landmarks, beta, bias, 1.0, 0.0)
    margins = np.array([model.margin(s) for s in sentences])
    slope, shift = 1.0, 0.0
    share = np.where(labels == 1, 0.5 / rate, 0.5 / (1 - rate))
    for _ in range(300):  # logistic calibration of margins, both classes weighing the same
        p = 1 / (1 + np.exp(-(slope * margins + shift)))
        g, h = share * (p - labels), share * p * (1 - p) + 1e-6
        hess = np.array([[(h * margins**2).sum() + 1e-2, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hess, [(g * margins).sum(), g.sum()])
        slope, shift = slope - 0.3 * step[0], shift - 0.3 * step[1]
    return Model(landmarks, beta, bias, float(slope), float(shift))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold (crc32 mod 4 = 2)."""
    return fit(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, sample_rows))


def score_texts(texts: list[str | None], model: Model, reader: Reader | None) -> list[float]:
    if reader is None:
        return [model.score(0.0)] * len(texts)
    return [model.score(model.margin(s)) for s in reader.sentences([text or "" for text in texts])]


def score_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of each whole text as a column. Only the text goes to Python and only the number comes back."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        reader = Reader(model.landmarks) if model.landmarks else None
        for batch in batches:
            scores = [score for part in parts_of(batch) for score in score_texts(part.to_pylist(), model, reader)]
            yield pa.array(scores, pa.float64())
        del reader
        release_memory()

    return F.arrow_udf(run, "double")(text.cast("string"))


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with one more column: the score in 0..1 of each whole text, the higher the likelier label 1.

    Null, empty and blank texts score like a text without any known unit. Rows that repeat are scored each; every other
    column stays as it is and never leaves the JVM, but for one that is already called ``column``, which is replaced. An
    empty table stays empty.
    """
    return docs.drop(column).withColumn(column, score_of(F.col("text"), model, docs.sparkSession))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(spark, docs, table(spark, folder, "labels"))
    return with_scores(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
