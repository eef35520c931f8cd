"""Licence notices in texts, also with typing errors, by exact seeds and bounded-error matching.

A notice that may have e errors is split into e + 1 seeds; wherever it stands, at least one seed stands unharmed. One
automaton finds the seeds of all notices in a pass over the text. Around each find the regex library's fuzzy matching
decides, counts the edits and reports the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import slices, table

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Short notices as they commonly stand, lower case, with the label of a find.
NOTICES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted, free of charge, to any person", "mit-notice"),
    ("licensed under the apache license, version 2.0", "apache-notice"),
    ("licensed under the gnu general public license", "gpl-notice"),
    ("gnu lesser general public license", "lgpl-notice"),
    ("redistribution and use in source and binary forms", "bsd-notice"),
    ("mozilla public license", "mpl-notice"),
    ("licensed under cc by-nc 4.0", "cc-by-nc-notice"),
    ("creative commons attribution", "cc-notice"),
    ("spdx-license-identifier:", "spdx-notice"),
    ("all rights reserved", "reserved-notice"),
)
ERRORS_PER = 10  # one error is allowed per so many characters of a notice
_SEPARATED = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@lru_cache(maxsize=8)
def _tools(notices: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex

    automaton, patterns, seeds = ahocorasick.Automaton(), [], {}
    for number, (notice, _) in enumerate(notices):
        errors = len(notice) // ERRORS_PER
        cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            seeds.setdefault(notice[a:b], []).append((number, b))
        patterns.append((regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={errors}}}"), len(notice), errors))
    for seed, places in seeds.items():
        automaton.add_word(seed, places)
    automaton.make_automaton()
    base = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + _SEPARATED.join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])"), label) for p, label in BASE]
    return automaton, patterns, base


def notices_in(text: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of each notice found in lower-case text, in order of place."""
    automaton, patterns, _ = _tools(notices)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    tried: dict[int, int] = {}
    for end, places in automaton.iter(text):
        for number, offset in places:
            pattern, size, errors = patterns[number]
            start = max(0, end + 1 - offset - errors)
            if tried.get(number, -1) >= start:  # a neighbouring seed of the same place
                continue
            window = text[start:start + size + 2 * errors]
            m = pattern.search(window)
            if m:
                found.setdefault((number, start + m.start()), (start + m.end(), sum(m.fuzzy_counts)))
                tried[number] = start + m.start()
    return sorted((notices[number][1], start, end, edits) for (number, start), (end, edits) in found.items())


def scan(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES) -> dict:
    """Words, places of the base phrases, labels, score and spans of one text (null is empty)."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    inside = _IN_WORD[np.frombuffer(raw, np.uint8)]
    begins = inside & np.concatenate([[True], ~inside[:-1]]) if len(inside) else inside
    places, labels, spans = [], set(), []
    if b"license" in raw:
        for pattern, label in _tools(notices)[2]:
            own = [m.start() for m in pattern.finditer(raw)]
            if own:
                labels.add(label)
                places += own
    low = raw.decode("utf-8", "surrogatepass")
    spans = notices_in(low, notices)
    sizes = {label: 0.0 for _, label in notices}
    for label, start, end, edits in spans:
        sizes[label] = max(sizes[label], 1 - edits / max(1, end - start))
    words = [int(np.count_nonzero(begins[:p])) for p in places]
    return {
        "n_words": int(np.count_nonzero(begins)), "n_base": len(places), "first_word": min(words, default=None), "last_word": max(words, default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s[0] for s in spans})),
        "score": 1.0 if places else max(sizes.values(), default=0.0),
        "spans": [{"label": s[0], "start": s[1], "end": s[2], "edits": s[3]} for s in spans],
    }


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))),
])


def license_scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A score is 1 for a base phrase, else the share of unharmed characters of the best notice, else 0. Spans are character
    positions in the text. Null and empty texts have no words and no finds. Repeated rows are scanned each; other columns
    are not read; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [{"doc_id": doc_id, **scan(text, notices)} for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
             "spans array<struct<label: string, start: long, end: long, edits: long>>")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents")).drop("spans")
