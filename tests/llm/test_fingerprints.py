"""Closed syncmers against a plain loop."""

import hashlib
import random
import re

import cases
import xxhash

from flowcast.llm import syncmers

MASK = 2**64 - 1


def signed(x):
    x &= MASK
    return x - 2**64 if x >> 63 else x


def hashed(value, seed=42):
    data = value.encode() if isinstance(value, str) else (value & MASK).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def plain_anchors(text):
    tokens = re.findall("[⺀-퟿]|[^ \t-\r⺀-퟿]{1,16}", text)
    h = [hashed(t) for t in tokens]
    g = [signed(((x << 1) & MASK) ^ y) for x, y in zip(h, h[1:])]
    found = {}
    for i in range(len(g) - 2):
        if g[i + 1] >= min(g[i], g[i + 2]):
            found.setdefault(hashed(g[i + 2], hashed(g[i])) >> 33, i)
    if not found and tokens:
        found = {hashed(" ".join(tokens)) >> 33: 0}
    return sorted(found.items())[:64]


def plain_likeness(a, b):
    union = sorted({x for x, _ in a + b})[:64]
    if not union:
        return 1.0
    one, other = dict(a), dict(b)
    shifts = sorted(other[x] - one[x] for x in union if x in one and x in other)
    width = max(p for _, p in a + b)
    same = sum(abs(s - shifts[len(shifts) // 2]) <= 16 + width / 4 for s in shifts)
    return 2.0 * same / (same + len(union))


def plain(rows):
    def order(row):
        h = signed(hashed(row[1] or ""))
        return row[0] is None, -(row[0] or 0), h
    ordered = sorted(rows, key=order)
    out = []
    for n, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, e, x = (plain_anchors(t) for t in (text, edited, after))
        spelled = lambda anchors: ",".join(f"{h:08x}@{p}" for h, p in anchors)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(a), spelled(e), plain_likeness(a, e), plain_likeness(a, x)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints_of_odd_texts(spark):
    rows = cases.texts() + [(60, "漢字かな交じり文を空白なしで書く" * 4), (61, "x" * 300), (62, "a b c"), (63, "a b c d")]
    assert cases.rows_of(syncmers.fingerprints(cases.frame(spark, rows)), *COLUMNS) == plain(rows)


def test_followers_across_many_ranges_and_shared_ids(spark):
    rng = random.Random(3)
    rows = [(i * i, cases.sentence(rng, 12)) for i in range(40)] + [(100, cases.sentence(rng, 5)) for _ in range(40)] + [(None, cases.sentence(rng, 3)) for _ in range(30)]
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("order_hash", F.xxhash64("text")).repartition(5)
    for per_range in (1, 7, 1000):
        got = cases.rows_of(syncmers.with_next(docs, ["text"], range_rows=per_range), "doc_id", "text", "next_text")
        ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed(r[1]))))
        assert got == sorted([(*r, ordered[(n + 1) % len(ordered)][1]) for n, r in enumerate(ordered)], key=repr), per_range


def test_one_row_and_none(spark):
    assert cases.rows_of(syncmers.fingerprints(cases.frame(spark, [(5, "one two three four five")])), *COLUMNS) == plain([(5, "one two three four five")])
    assert syncmers.fingerprints(cases.frame(spark, [])).count() == 0


def test_equal_texts_and_halves(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.random()) for _ in range(400))) for i in range(12)]
    rows.append((20, rows[5][1]))
    found = syncmers.fingerprints(cases.frame(spark, rows)).collect()
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].fingerprint == by_id[20].fingerprint
    assert all(0.25 < r.near_edited < 0.8 and r.near_next < 0.05 for r in found)
