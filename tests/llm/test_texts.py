"""Index, token files, packing, shards, licence scans and classifiers against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcast.llm import license_scan, packing, positional_index, quality, shards, simple8b, token_files, tokens, toxicity
from flowcast.llm.common import Scratch, without_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(cases.fold(text))


# --- positional index

ITEMS = [(1, "Kappa alpha, beta GAMMA; delta été mit license zeta eta theta iota"), (2, "only four words here"), (2, "a second row of two"), (3, None), (4, ""),
         (None, "no name for this item at all"), (5, "x x x x x x x x x x x x")]


def hits_loop(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            for s in range(max(1, len(w) - window + 1) if w else 0):
                gram = w[s:s + window]
                for at in range(len(own) - len(gram) + 1):
                    if own[at:at + len(gram)] == gram:
                        hit |= set(range(at, at + len(gram)))
                        names |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark):
    w = words(ITEMS[0][1])
    docs = cases.texts() + [
        (60, "before " + " ".join(w).upper() + " after"), (61, " ".join(w[:9])), (62, " - ".join(w[1:11])), (63, "ONLY four. words, here"), (64, "x " * 15),
        (65, " ".join(w) + " z " + " ".join(w[2:])), (66, "no name for this item at all"), (60, "second text of sixty"),
    ]
    items = spark.createDataFrame([(i, t, "?") for i, t in ITEMS], "item_id long, text string, term string")
    found = positional_index.contamination(cases.frame(spark, docs), items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert cases.rows_of(found, *columns) == hits_loop(docs, ITEMS)
    none = positional_index.contamination(cases.frame(spark, docs), items.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)
    assert positional_index.contamination(cases.frame(spark, []), items).count() == 0


def test_proximity(spark):
    docs = [(1, "red green filler blue"), (2, "red filler filler filler filler filler green blue"), (3, "blue green red"), (4, "red green")]
    scratch = Scratch(spark, "proximity")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    index, test = positional_index.prepare(cases.frame(spark, docs, 1), items, scratch)
    got = {r["doc"] for r in positional_index.proximity_matches(index, test, 3).collect()}
    ids = {r["doc"]: r["doc_id"] for r in index.where("term = -1").collect()}
    want = set()
    for doc_id, text in docs:
        own = text.split()
        places = {w: [i for i, x in enumerate(own) if x == w] for w in ("red", "green", "blue")}
        # The rarest word of the corpus is the anchor; here blue (three times) comes first.
        if any(all(any(abs(i - a) <= 3 for i in places[w]) for w in places) for a in places["blue"]):
            want.add(doc_id)
    assert {ids[d] for d in got} == want == {1, 3}


# --- tokens, files, packing

def test_pieces_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary(), remembered=50)
    odd = ["á ́b <|endoftext|>x y　z's 12", "İSTANBUL ΣΑΣ ΟΔΟΣ. 3.14'll!!", "\x1c a\x1fb  c", "​x ́", "É'S don't WON'T.*** a²b Ⅷ", "ſs ß K", "a" * 5000]
    texts = [text or "" for _, text in cases.texts()] + odd
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [
    [], [0] * 5000, [2**64 - 1], [0, 2**60, 5, 2**60 - 1, 2**63, 0], list(range(0, 50000, 7)), [3, 0, 1] * 900, [2**61, 1] * 700,
])
def test_simple8b_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    coded, offsets = simple8b.encode(values)
    assert (simple8b.decode(coded, offsets, len(values)) == values).all()
    for block in range(len(offsets) - 1):
        part = values[block * simple8b.BLOCK:(block + 1) * simple8b.BLOCK]
        assert (simple8b.decode_block(coded, offsets, len(values), block) == part).all()


def ids_of(text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files(spark):
    rows = [r for r in cases.texts() if r[0] not in (46, 47)]  # order within one doc_id is open
    found = token_files.token_files(cases.frame(spark, rows)).collect()
    start = 0
    by_text = {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text, 1)
        by_text.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), start))
        start += len(ids)
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"], r["start"]))
    assert {k: sorted(v) for k, v in got.items() if k is not None} == {k: sorted(v) for k, v in by_text.items() if k is not None}
    assert sorted(v[:2] for v in got[None]) == sorted(v[:2] for v in by_text[None])
    assert token_files.token_files(cases.frame(spark, [])).count() == 0


def test_packing_reads_few_texts_at_once(spark, tmp_path, monkeypatch):
    docs = cases.written(spark, [(i, "word") for i in range(4000)], tmp_path).coalesce(1)
    limit, seen, put = "spark.sql.execution.arrow.maxRecordsPerBatch", [], Scratch.put
    before = spark.conf.get(limit)

    def watched(self, df, name, *rest):
        if name == "pieces":
            seen.append(rest[0] if rest else int(spark.conf.get(limit)))
        return put(self, df, name, *rest)

    monkeypatch.setattr(Scratch, "put", watched)
    assert packing.pack_documents(docs).count() == 4000
    assert seen == [packing.BATCH_ROWS] and seen[0] <= 1000 and spark.conf.get(limit) == before


def test_encoder_forgets_before_it_grows_large():
    own = tokens.Encoder(tokens.vocabulary())
    assert own._remembered <= 400_000


def test_packing(spark):
    rows = cases.texts()
    found = packing.pack_documents(cases.frame(spark, rows), capacity=64).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = ids_of(text, 0)
        for piece, at in enumerate(range(0, len(ids), 64)):
            own = ids[at:at + 64]
            want[doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // 64) + 1
    assert packing.pack_documents(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("counts", [{3: 1, 2: 1100}, {2: 5000, 3: 3}, {1: 3000, 2: 3000}])
def test_plans_of_very_short_pieces(counts):
    plan = packing.plan_sequences(counts, 2048)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 2048
        for size in filling:
            used[size] += times
    assert used == counts
    assert sum(times for _, times in plan) == -(-sum(size * n for size, n in counts.items()) // 2048)


def sequences_of(plan):
    return sum(times for _, times in plan)


def test_plans_are_never_worse_than_best_fit():
    counts = {1340: 1000, 700: 1000, 354: 2000}
    assert sequences_of(packing.best_fit_plan(counts, 2048)) == 1400
    assert sequences_of(packing.plan_sequences(counts, 2048)) <= 1400


def test_branching_beats_both_first_plans():
    rng = random.Random(3)
    wins = 0
    for _ in range(40):
        counts = Counter(rng.randint(15, 60) for _ in range(30))
        first = min(sequences_of(packing.best_fit_plan(counts, 100)), sequences_of(packing.completed_plan(counts, 100)))
        plan = packing.plan_sequences(counts, 100)
        used = Counter()
        for filling, times in plan:
            assert sum(filling) <= 100
            for size in filling:
                used[size] += times
        sizes = sorted(counts)
        assert used == counts and packing.fewest(np.array(sizes), np.array([counts[s] for s in sizes]), 100) <= sequences_of(plan) <= first
        wins += sequences_of(plan) < first
    assert wins


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_of_groups_equals_best_fit_of_pieces(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 60) for _ in range(200))
    rooms = []
    for size in sorted(counts.elements(), reverse=True):
        at = min((i for i, room in enumerate(rooms) if room >= size), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(100 - size)
        else:
            rooms[at] -= size
    assert sequences_of(packing.best_fit_plan(counts, 100)) == len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_optimum(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(14)]

    def least(rest, bins, best):
        if len(bins) >= best:
            return best
        if not rest:
            return len(bins)
        for i in range(len(bins)):
            if bins[i] + rest[0] <= 20 and bins[i] not in bins[:i]:
                best = least(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1:]], best)
        return least(rest[1:], [*bins, rest[0]], best)

    plan = packing.plan_sequences(Counter(sizes), 20)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 20
        for size in filling:
            used[size] += times
    assert used == Counter(sizes)
    assert sum(times for _, times in plan) == least(sorted(sizes, reverse=True), [], len(sizes))


# --- shards

@pytest.mark.parametrize("rows", [cases.texts(), [(i, "the same text " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * (i % 30)) for i in range(600)], []], ids=["odd", "hot", "empty"])
def test_shards(spark, rows):
    found = shards.byte_shards(cases.frame(spark, rows), shards=8).collect()
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == want
    slots, sizes = {}, Counter()
    for r in found:
        assert 0 <= r["shard"] < 8 and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    if len(rows) > 500:
        mean = sum(sizes.values()) / 8
        assert all(abs(own - mean) <= 0.02 * mean + max(r["size"] for r in found) for own in sizes.values())


# --- licences

def test_license_scan(spark):
    rows = cases.texts() + [
        (70, "MIT\nLicense and mit-license, apachelicense"), (71, "Relesed under the MIT licens"), (72, "see the Apache  License; General Public License. MIT license"),
        (73, "Licensed under CC BY-NC 4.0"), (74, "all rigths reserved"), (75, "allrights"), (76, "é MIT LICENSE é"),
    ]
    got = {}
    for r in license_scan.license_scan(cases.frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    want = {}
    for doc_id, text in rows:
        own, at, labels = words(text), [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            here = [i for i in range(len(own) - len(p) + 1) if own[i:i + len(p)] == p]
            at, labels = at + here, labels | ({label} if here else set())
        want.setdefault(doc_id, []).append((len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert license_scan.license_scan(cases.frame(spark, [])).count() == 0


def test_every_harmed_notice_within_the_bound_is_found():
    rng = random.Random(2)
    for notice, label in license_scan.NOTICES:
        for _ in range(30):
            harmed = list(notice)
            for _ in range(len(notice) // license_scan.ERRORS_PER):
                at = rng.randrange(len(harmed))
                harmed[at] = rng.choice(["", "q", harmed[at] + "q"])
            text = "some text before " + "".join(harmed) + " and after"
            found = [f for f in license_scan.notices_in(text) if f[0] == label]
            assert found and found[0][3] <= len(notice) // license_scan.ERRORS_PER
            assert abs(found[0][1] - 17) <= 5
    assert license_scan.notices_in("nothing of that kind stands here") == []


# --- classifiers

def labelled_rows(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.6)
        body = [rng.choice(("river", "stone", "meadow", "winter", "garden", "travel", "idea")) + rng.choice(("", "s", "ly", "ed")) for _ in range(30)]
        if toxic:
            body[rng.randrange(30)] = rng.choice(("blockhead", "numbskull", "dimwit"))
        text = " ".join(body) + "."
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), good, toxic))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = labelled_rows()
    docs = cases.frame(spark, [(i, t) for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_toxicity_on_the_held_out_fold(spark, labelled):
    rows, docs, labels = labelled
    model = toxicity.train(spark, docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_scores(docs, model).collect()}
    held = [(scores[i], x) for i, _, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((s >= toxicity.THRESHOLD) == bool(x) for s, x in held)
    reader = toxicity.Reader(model.landmarks)
    tampered = ["you block-head here", "a numb.skull", "dimxwit", "n u m b s k u l l it is", "blockkhead"]
    plain = ["by the river in winter", "", "stone garden"]
    assert min(toxicity.score_texts(tampered, model, reader)) > max(toxicity.score_texts(plain, model, reader))


def test_quality_on_the_held_out_fold(spark, labelled):
    rows, docs, labels = labelled
    weights = quality.train(spark, docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    held = [(scores[i], q) for i, _, q, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert min(s for s, q in held if q) > max(s for s, q in held if not q)


def test_classifiers_take_any_text(spark, labelled):
    _, docs, labels = labelled
    odd = cases.texts()
    for got in (quality.score(cases.frame(spark, odd), quality.train(spark, docs, labels)), toxicity.with_scores(cases.frame(spark, odd), toxicity.train(spark, docs, labels))):
        values = [r["score"] for r in got.collect()]
        assert len(values) == len(odd) and all(0 <= v <= 1 for v in values)
    flat = toxicity.train(spark, docs, labels.limit(0))
    assert toxicity.with_scores(cases.frame(spark, odd), flat).select("score").distinct().count() == 1
    assert toxicity.with_scores(cases.frame(spark, []), flat).count() == 0
    assert quality.score(cases.frame(spark, odd), quality.train(spark, docs, labels.limit(0))).count() == len(odd)


def test_subsequence_kernel_against_its_definition():
    from itertools import combinations

    def weight(a, b):
        return sum(toxicity.DECAY ** (p[-1] - p[0] + 1 + q[-1] - q[0] + 1)
                   for p in combinations(range(len(a)), 3) for q in combinations(range(len(b)), 3) if [a[i] for i in p] == [b[i] for i in q])

    pairs = [("idiot", "idxiot"), ("abc", "abc"), ("aaa", "aaaa"), ("ab", "abc"), ("stupid", "diputs")]
    got = toxicity.subsequence_kernel(toxicity._coded([a for a, _ in pairs], -1), toxicity._coded([b for _, b in pairs], -2))
    assert np.allclose(got, [weight(a, b) for a, b in pairs])


def test_rows_leave_by_number(spark, tmp_path):
    docs = cases.written(spark, cases.texts(), tmp_path)
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    gone = numbered.where(F.pmod(F.xxhash64("row"), F.lit(3)) == 0).select("row")
    assert without_rows(docs, gone).count() == docs.count() - gone.count()
    assert without_rows(docs, gone).columns == docs.columns
