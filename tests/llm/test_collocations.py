"""Collocations against a plain count of everything."""

import random
import re
from collections import Counter

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowcast.llm import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, limit):
    """rows: (lang, text)."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", cases.fold(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {g: n for g, n in f.items() if n >= 30 and len(g) > 1}
        most = {}
        for g, n in often.items():
            for m in range(2, len(g)):
                for s in range(len(g) - m + 1):
                    most[g[s:s + m]] = max(most.get(g[s:s + m], 0), n)
        ranked = []
        for g, a in often.items():
            if 100 * most.get(g, -1) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:limit], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out, key=repr)


def corpus(seed, n=400):
    """Few words, some phrases that stand together, marks between and inside, odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)] + ["Été", "été", "ÀB", "'s"]
    fixed = [["new", "york", "city", "hall"], ["w1", "w2", "w3"], ["so", "called"], ["Hong", "Kong"], ["kong", "w4", "w5", "w6"]]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += " ".join(rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(words)]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " - "])
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("fr", "only once"), ("en", "w1 w2 w3 " * 3000), ("de", "," * 50), ("zz", "hot hot " * 200)] * 2


def frame(spark, rows, parts=3):
    data = [(i, text, lang, "?", 0, *["?"] * len(cases.CLASHING)) for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(data, cases.SCHEMA).repartition(parts)


@pytest.mark.parametrize("limit", [2000, 3, 12])
def test_best_phrases(spark, limit):
    rows = corpus(5)
    assert cases.rows_of(collocations.collocations(frame(spark, rows), limit), *COLUMNS) == plain(rows, limit)


def test_texts_in_parts(spark, monkeypatch):
    rows = [(lang, text) for lang, text in corpus(6, 60)]
    want = plain(rows, 2000)
    parts = [list(collocations._parts((text or "").encode())) for _, text in rows]
    assert all(b"".join(p for p, _ in x) == (text or "").encode() for x, (_, text) in zip(parts, rows))

    def small(function):  # tasks import the module anew, so the size is set where they run
        def run(batches):
            collocations.CHUNK = collocations.PHRASES = 40
            return function(batches)
        return run

    for name in ("code_texts", "count_phrases"):
        made = getattr(collocations, name)
        monkeypatch.setattr(collocations, name, lambda *a, made=made: small(made(*a)))
    monkeypatch.setattr(collocations, "count_words", small(collocations.count_words))
    assert cases.rows_of(collocations.collocations(frame(spark, rows)), *COLUMNS) == want


def test_hash_is_the_one_of_spark(spark):
    numbers = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    got = [r[0] for r in spark.createDataFrame([(n, -n if n > -(2**63) else 7) for n in numbers], "a long, b long").select(F.xxhash64(F.lit("en"), "a", "b")).collect()]
    seed = np.full(len(numbers), xxhash.xxh64_intdigest("en", 42), np.uint64)
    a, b = (np.array(x, np.int64).view(np.uint64) for x in (numbers, [-n if n > -(2**63) else 7 for n in numbers]))
    assert collocations.hashed_onto(collocations.hashed_onto(seed, a), b).view(np.int64).tolist() == got


def test_large_counts_stay_exact(spark):
    big = 2**62
    row = spark.range(1).select(collocations._score(F.lit(big), F.lit(big), F.lit(big)).alias("s"), collocations._holds(F.lit(big), F.lit(big + 2**60)).alias("h")).first()
    assert (row.s, row.h) == (1_000_000, True)


def test_nothing(spark):
    assert collocations.collocations(cases.frame(spark, [])).count() == 0
    assert collocations.collocations(cases.frame(spark, [(1, None), (2, "a few words")])).count() == 0
