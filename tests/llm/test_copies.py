"""Exact copies, near copies and near-equal lines against plain loops."""

import hashlib
import random
import re
import time

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowcast.llm import jaccard_join, line_join, stream_dedup
from flowcast.llm.common import Scratch
from flowcast.llm.components import connected


def exact_loop(rows):
    groups = {}
    for n, (doc_id, text) in enumerate(rows):
        norm = re.sub("[ \t-\r]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, n))
    out = []
    for norm, group in groups.items():
        first = min(group)
        for member in group:
            doc_id = rows[member[3]][0]
            out.append((doc_id, rows[first[3]][0], len(group), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_copies_also_with_colliding_digests(spark, digest):
    rows = cases.texts()
    found = stream_dedup.exact_duplicates(cases.frame(spark, rows), digest=digest, files_per_batch=1)
    want, groups = exact_loop(rows)
    got = cases.rows_of(found, "doc_id", "keep_id", "group_size", "text_sha256")
    if digest is stream_dedup.sha256:
        assert got == want
    else:
        assert [g[:3] for g in got] == sorted((w[:3] for w in want), key=repr) or {g[:3] for g in got} == {w[:3] for w in want}
    assert found.where("kept").count() == groups


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    paths = [f"file://{tmp_path}/{n}" for n in ("arrivals", "state", "groups")]
    for part in ([(5, "same text"), (6, "other")], [(3, "same  text"), (4, "sametext")]):
        stream_dedup.land_arrivals(cases.frame(spark, part), paths[0], mode="append")
        stream_dedup.run_stream(spark, *paths)
    last = spark.read.parquet(paths[2]).where("group_size = 3").select("first.doc_id", "batch").collect()
    assert [tuple(r) for r in last] == [(3, 1)]


def test_exact_copies_of_nothing(spark):
    assert stream_dedup.exact_duplicates(cases.frame(spark, [])).count() == 0


def shingles(text):
    words = re.findall("[^ \t-\r]+", cases.fold(text))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_loop(rows):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def family(seed, size, words, changes):
    """A source, copies with a few words changed, copies of copies, and strangers that share a passage."""
    rng = random.Random(seed)
    source = [f"w{rng.randrange(4000)}" for _ in range(words)]
    passage = [f"p{i}" for i in range(60)]
    out = [source]
    for _ in range(size):
        copy = list(rng.choice(out[:6]))
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        out.append(copy)
    for k in range(25):
        out.append(passage + [f"s{rng.randrange(10**6)}" for _ in range(rng.randint(3, 40))])
    rng.shuffle(out)
    return [(100 + i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("rows", [
    cases.texts(), cases.texts(5), family(1, 150, 120, 6), family(2, 120, 300, 14), family(3, 150, 40, 3), [],
], ids=["odd", "odd2", "family", "long-family", "short-family", "empty"])
def test_near_copies(spark, rows):
    found = jaccard_join.near_duplicates(cases.frame(spark, rows))
    assert cases.rows_of(found, "doc_id", "n_shingles", "component_id") == near_loop(rows)


def test_shingle_sets_of_batches_equal_those_of_single_texts():
    texts = [text for _, text in cases.texts()]
    value, bounds = jaccard_join.shingle_sets(texts)
    for i, text in enumerate(texts):
        own, _ = jaccard_join.shingle_sets([text])
        assert own.tolist() == value[bounds[i]:bounds[i + 1]].tolist()
        assert len(own) == len(shingles(text))


def test_often_shingles_stand_apart_among_many_rare_ones(spark):
    rng = np.random.default_rng(1)
    rare, often = (rng.integers(0, 2**58, n, np.uint64) for n in (1_000_000, 300))  # crowded as in a corpus of 64 million shingles
    runs = [np.concatenate([part, often, often]) for part in np.array_split(rare, 10)]
    rows = [row for run in runs for row in zip(*jaccard_join._by_slice([(run >> np.uint64(32)).astype(np.uint32)]))]
    read = spark.createDataFrame([(number, bytearray(packed)) for number, packed in rows], "slice int, counts binary")
    classes, frequent = jaccard_join.frequency_classes(read, Scratch(spark, "classes"))
    assert frequent == 8 and (jaccard_join._prefix(often, classes)[1] == 8).all()  # 20 times each
    assert (jaccard_join._prefix(rare, classes)[1] == 0).mean() > 0.95
    packed = [jaccard_join._packed(p) for p in (np.zeros(0, np.uint32), np.array([0, 0, 5, 2**22 - 1], np.uint32))]
    assert [jaccard_join._unpacked(p).tolist() for p in packed] == [[], [0, 0, 5, 2**22 - 1]]


def test_shuffle_files_go_when_a_scratch_table_is_written(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    before, scratch = files(), Scratch(spark, "shuffled")
    rows = scratch.put(spark.range(1000).repartition(3, "id"), "rows")
    kept = scratch.keep(rows.groupBy("id").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == 1000


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(edges, Scratch(spark, "path"), "p").collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
        last = row
    return last[-1]


def lines_loop(docs, edits=2, shortest=12):
    said = [(d is None, d or 0, n, i, line.strip(" ")) for n, (d, t) in enumerate(docs) for i, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    distinct = sorted({s[4] for s in said})
    root = {line: line for line in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [line for line in distinct if len(line) >= shortest]
    for i, a in enumerate(long):
        for b in long[:i]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                root[find(a)] = find(b)
    first = {}
    for s in sorted(said):
        first.setdefault(find(s[4]), s)
    out = []
    for n, (d, _) in enumerate(docs):
        own = [s for s in said if s[2] == n]
        gone = [s for s in own if first[find(s[4])] != s]
        out.append((d, len(own), len(gone), sum(first[find(s[4])][4] != s[4] for s in gone), ",".join(str(s[3]) for s in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowded", [64, 1])
def test_near_lines(spark, crowded):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcde é\U0001F600") for _ in range(rng.randint(12, 40))) for _ in range(20)]

    def changed(line):
        line = list(line)
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(line)), rng.random()
            if kind < 0.33:
                line[at] = rng.choice("abxy")
            elif kind < 0.66:
                line.insert(at, rng.choice("abxy"))
            else:
                del line[at]
        return "".join(line)

    docs = [(i if i != 7 else None, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 4)))) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "ab\nab\n\n"), (502, "ab\nab\n\n"), (503, "q" * 3000 + "\n" + "q" * 2999)]
    found = line_join.near_lines(cases.frame(spark, docs, 1), crowded=crowded)
    assert cases.rows_of(found, "doc_id", "n_lines", "n_dropped", "n_near", "dropped") == lines_loop(docs)


def test_near_lines_when_a_later_scan_is_split_otherwise(spark, tmp_path, monkeypatch):
    docs = [(i, f"the same line of words\nline {i} of its own" if i % 3 else "") for i in range(40)]
    written = cases.written(spark, docs, tmp_path)
    sizes = {"spark.sql.files.maxPartitionBytes": "1000000000", "spark.sql.files.openCostInBytes": "64", "spark.sql.files.minPartitionNum": "1"}
    put = Scratch.put

    def resized(self, df, name, *rest):
        out = put(self, df, name, *rest)
        if name == "light":
            spark.conf.set("spark.sql.files.minPartitionNum", "30")
        return out

    monkeypatch.setattr(Scratch, "put", resized)
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        found = line_join.near_lines(written)
    finally:
        for key in sizes:
            spark.conf.unset(key)
    assert cases.rows_of(found, "doc_id", "n_lines", "n_dropped", "n_near", "dropped") == lines_loop(docs)


def test_lines_of_nothing(spark):
    assert line_join.near_lines(cases.frame(spark, [])).count() == 0


def test_banded_bits_agree_with_the_plain_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) if rng.random() < 0.5 else a[:3] + rng.choice("abc") + a[4:]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", line_join.within(F.col("a"), F.col("b"), edits).alias("near")).collect()
        assert [(r.a, r.b, r.near) for r in got] == [(a, b, distance(a, b) <= edits) for a, b in pairs]


def test_marks_and_segments_keep_lines_that_are_near(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab  é\U0001F600") for _ in range(rng.randint(1, 60)))
        b, edits = list(a), rng.randint(1, 3)
        for _ in range(edits):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = [rng.choice("ab é ")] * rng.randint(0, 1)
        pairs.append((a, "".join(b), edits))
    df = spark.createDataFrame(pairs, "a string, b string, edits int")
    for edits in (1, 2, 3):
        apart = F.bit_count(line_join.mark_of(F.col("a")).bitwiseXOR(line_join.mark_of(F.col("b"))))
        got = df.where(F.col("edits") == edits).select(apart.alias("apart"), line_join.keeps_segments(F.col("a"), F.col("b"), edits).alias("kept")).collect()
        assert got and all(r.apart <= 2 * edits and r.kept for r in got)


def test_lines_that_share_a_part_only_are_not_compared(spark, monkeypatch):
    rng = random.Random(5)
    start = " ".join(cases.WORDS * 3)
    docs = [(i, start + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(len(start) // 4))) for i in range(30)]
    docs.append((30, docs[3][1].replace("alpha", "alphas", 1)))
    put, compared = Scratch.put, []

    def counted(self, df, name, *rest):
        out = put(self, df, name, *rest)
        if name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    found = line_join.near_lines(cases.frame(spark, docs), crowded=1)
    assert cases.rows_of(found, "doc_id", "n_lines", "n_dropped", "n_near", "dropped") == lines_loop(docs)
    assert 1 <= compared[0] < 20
