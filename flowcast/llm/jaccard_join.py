"""Exact Jaccard join of documents on word shingles with token-combination prefixes.

Shingles are ordered by how often the corpus holds them, rare ones first. They are counted in 2**32 cells by a shuffle of about
a byte and a half each. Only the fullest cells, ``LISTED`` at most, pass through the driver: a table of 2**TABLE_BITS bytes
at most has the class of their counts, and all other shingles but those that share an entry with them are equally rare. By the prefix rule two similar sets share a shingle among their first few; with prefixes
longer by one they share two. So rare shingles of the longer prefix are index keys by themselves, and frequent ones only
in pairs. Documents of over ``PAIRED`` shingles index frequent ones singly, and so do those just below, so that every
similar pair uses a common kind of key.

Documents of a key are paired with each other only if they are few. Of more, one, the pivot (the one with the fewest rare
shingles, most likely the source of copies), is compared with all. What that leaves open for two others is settled by set arithmetic:
unless both overlap enough with the pivot, they can only be similar if they share a shingle that the pivot lacks, and
those are rare. Only such pairs are compared then, and only between components that are not yet connected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import Scratch, release_memory, slices, table
from flowcast.llm.components import connected

SHINGLE = 5
PERCENT = 75
CELL_BITS, SLICE_BITS = 32, 22  # shingles are counted by their first bits; of these the last are a place in a slice
RUN = 4_000_000  # shingles that a task counts at once
SELDOM = 3  # class of a cell that may be listed: three documents and up
FREQUENT = 8  # class of 16 documents and up
LISTED, TABLE_BITS = 2**24, 25
PAIRED = 256
FEW = 8  # nodes of a key that are compared pair by pair
PAIR, STAR = 0, 1
LARGE_ROWS = 100  # rows with whole sets that pass to Python at once
SLICE_ROWS = 500  # rows with slices of cells that do
NO_ID = -(2**63)  # stands for a null doc_id inside
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, _U)


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        _powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, 0xD6E8FEB86659FD93, _U))])
    return _powers


def _word_hashes(raw: bytes, size: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where words begin and a 64-bit hash of each, for stretches of about ``size`` bytes that end between words."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, min(at + size, len(raw)))
        end = gap.end() if gap else len(raw)
        data = np.frombuffer(raw, np.uint8, end - at, at)
        blank = _BLANK[data]
        starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        if len(starts):
            inside = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(data))))
            letters = np.where(blank[starts[0]:], _U(0), data[starts[0]:].astype(_U) + _U(1))
            yield starts + at, _mix(np.add.reduceat(letters * _power_table(int(inside.max()) + 1)[inside], starts - starts[0]))
        at = end


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, and where each text's begin (one more entry than texts).

    A text's hashes are in ascending order. A text of fewer words than a shingle has one for all its words, and one
    without words has none.
    """
    raw = [text.encode("utf-8", "surrogatepass").lower() if text else b"" for text in texts]
    hashes, words = [], np.zeros(len(texts), np.int64)
    joined, lengths = b"\n".join(raw) + b"\n", np.cumsum([len(r) + 1 for r in raw])
    for start, found in _word_hashes(joined):
        hashes.append(found)
        words += np.diff(np.searchsorted(start, np.append(0, lengths)))
    hashes, bounds = np.concatenate(hashes) if hashes else np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    if not len(hashes):
        return np.zeros(0, _U), bounds
    first = np.append(0, np.cumsum(words))  # first word of each text, then the end
    owner = np.repeat(np.arange(len(texts)), words)
    left = np.repeat(first[1:], words) - np.arange(len(hashes))  # words from here to the end of the text
    padded = np.concatenate([hashes, np.zeros(SHINGLE, _U)])
    total = np.zeros(len(hashes), _U)
    for k in range(SHINGLE):
        total = total * _U(0xD1342543DE82EF95) + np.where(left > k, padded[k:k + len(hashes)], _U(0))
    keep = (left >= SHINGLE) | ((np.arange(len(hashes)) == first[:-1][owner]) & (words[owner] < SHINGLE))
    value, owner = _mix(total[keep] + np.minimum(words[owner[keep]], SHINGLE).astype(_U), 1), owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(value) != 0)) if len(value) else np.zeros(0, bool)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def _nodes(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set: equal sets have the same; sets that differ do but for a 64-bit accident."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(value, 2))])
    return _mix(sums[bounds[1:]] - sums[bounds[:-1]], 3).view(np.int64)


READ = "doc_id long, row long, node long, n_shingles long, slice int, counts binary"


def _packed(places: np.ndarray) -> bytes:
    """Sorted places in a slice as gaps; their lowest bytes are as good as random, the others are compressed."""
    gaps = np.diff(places, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return len(gaps).to_bytes(4, "little") + gaps[:, 0].tobytes() + zlib.compress(gaps[:, 1:3].T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    high = np.frombuffer(zlib.decompress(packed[4 + n:]), np.uint8).reshape(2, n).astype(np.uint32)
    return np.cumsum(np.frombuffer(packed, np.uint8, n, 4) + (high[0] << 8) + (high[1] << 16), dtype=np.uint32)


def _by_slice(cells: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    own = np.concatenate(cells)
    own.sort()
    numbers, first = np.unique(own >> SLICE_BITS, return_index=True)
    return numbers.tolist(), [_packed(part & np.uint32(2**SLICE_BITS - 1)) for part in np.split(own, first[1:])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set number and size, and now and then the cells of its shingles and of those before, by slice."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
    release_memory()
    held, size = [], 0

    def told() -> pa.RecordBatch:
        numbers, packed = _by_slice(held)
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(numbers), pa.int64())] * 4, pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    for batch in batches:
        for part in slices(batch):
            value, bounds = shingle_sets(part["text"].to_pylist())
            held.append((value >> _U(64 - CELL_BITS)).astype(np.uint32))
            size += len(value)
            n = len(bounds) - 1
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], pa.array(_nodes(value, bounds)), pa.array(np.diff(bounds)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
            if size >= RUN:
                yield told()
                held, size = [], 0
    if size:
        yield told()


def _summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cells, counts = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    return cells[first], np.add.reduceat(counts, first)


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice become, for each slice and class, the cells of that class; the partition holds all rows of its slices."""
    last, cells, counts, size = None, [], [], 0

    def told() -> Iterator[pa.RecordBatch]:
        place, n = _summed(cells, counts)
        place, n = place[n >= 2**(SELDOM / 2)], n[n >= 2**(SELDOM / 2)]
        kind = np.floor(2 * np.log2(n)).astype(np.uint8)
        for k in np.unique(kind).tolist():
            own = place[kind == k]
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([k], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([_packed(own)], pa.binary())], names=["slice", "class", "n", "cells"])

    for batch in batches:
        for k, packed in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            if k != last and size:
                yield from told()
                cells, counts, size = [], [], 0
            last = k
            place, n = np.unique(_unpacked(packed), return_counts=True)
            cells.append(place)
            counts.append(n)
            size += len(place)
            if size > 2 * max(2**20, len(cells[0])):  # so many that summing them is worth it
                cells, counts = ([c] for c in _summed(cells, counts))
                size = len(cells[0])
    if size:
        yield from told()


def frequency_classes(read: DataFrame, scratch: Scratch) -> tuple[np.ndarray, int]:
    """A class for each hash by its first bits, 0 for rare ones, and the class from which a shingle counts as frequent.

    All cells of a class are listed or none, and ``LISTED`` at most, so they may pass through the driver to all workers
    whatever the corpus.
    """
    runs = read.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").sortWithinPartitions("slice")
    often = scratch.put(runs.mapInArrow(_often, "slice int, class int, n long, cells binary"), "often", SLICE_ROWS)
    least, listed = 255, 0
    for kind, n in sorted(often.groupBy("class").agg(F.sum("n")).collect(), reverse=True):
        if listed + n > LISTED:
            break
        least, listed = kind, listed + n
    bits = min(TABLE_BITS, max(20, (4 * listed).bit_length()))
    classes = np.zeros(2**bits, np.uint8)
    for number, kind, packed in sorted(often.where(F.col("class") >= least).select("slice", "class", "cells").collect(), key=lambda row: row["class"]):
        classes[(_unpacked(packed) + np.uint32(number << SLICE_BITS)) >> (CELL_BITS - bits)] = kind  # the largest is the last
    return classes, max(FREQUENT, least)


def _prefix(own: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's hashes in the global order with their classes, and the length of its prefix."""
    kind = classes[own >> _U(65 - len(classes).bit_length())]
    order = np.lexsort((own, kind))
    return own[order], kind[order], len(own) - (len(own) * PERCENT + 99) // 100 + 1


def index_keys(own: np.ndarray, classes: np.ndarray, frequent: int) -> tuple[np.ndarray, int]:
    """Index keys of a set, and its rank as a pivot: twice its share of rare shingles in thousandths, odd if any shingle
    of its prefix is frequent."""
    own, kind, prefix = _prefix(own, classes)
    rare_share = int(1000 * (kind < frequent).mean())
    head, often = own[:prefix + 1], kind[:prefix + 1] >= frequent
    keys = [head[~often]]
    if often.any():
        if len(own) <= PAIRED:
            a, b = np.triu_indices(int(often.sum()), 1)
            keys.append(_mix(head[often][a] * _U(0xD1342543DE82EF95) + head[often][b], 4))
        if len(own) >= PAIRED * PERCENT // 100:
            keys.append(head[often])
    return np.concatenate(keys).view(np.int64), 2 * rare_share + int(often.any())


def _index(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, frequent = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                value, bounds = shingle_sets(part["text"].to_pylist())
                keys, nodes, scores = [], [], []
                for node, a, b in zip(_nodes(value, bounds).tolist(), bounds[:-1], bounds[1:], strict=True):
                    if a == b or node in seen:  # copies in the same task need not be indexed again
                        continue
                    seen.add(node)
                    own, score = index_keys(value[a:b], classes, frequent)
                    keys.append(own)
                    nodes.append(np.full(len(own), node))
                    scores.append(np.full(len(own), score, np.int32))
                if len(seen) > 500_000:
                    seen.clear()
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, scores)], names=["key", "node", "score"])
    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, score and node become rows (kind, a, b, both hold frequent shingles):

    PAIR    two nodes of a key that at most ``FEW`` nodes share
    STAR    the pivot and another node of a key that more share: of a crowd

    Between batches at most ``FEW`` rows and a pivot are kept, so memory does not depend on how often a key occurs.
    """
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    big, last = None, None  # key, pivot and its mark of a crowd that goes on; the last row's key and node

    def told(key: np.ndarray, node: np.ndarray, odd: np.ndarray, ended: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, big
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, np.diff(key) != 0))
        sizes = np.diff(np.append(first, len(key)))
        crowd = sizes > FEW
        pivots, odds = node[first].copy(), odd[first].copy()
        goes_on = big is not None and key[0] == big[0]
        if goes_on:
            crowd[0], pivots[0], odds[0] = True, big[1], big[2]
        if not ended and not crowd[-1]:  # may go on in the next batch
            held = (key[first[-1]:], node[first[-1]:], odd[first[-1]:])
            key, node, odd, sizes, crowd = key[:first[-1]], node[:first[-1]], odd[:first[-1]], sizes[:-1], crowd[:-1]
        elif crowd[-1]:
            big = (key[-1], pivots[-1], odds[-1])
        run = np.repeat(np.arange(len(sizes)), sizes)
        few = ~crowd[run]
        out = []
        for step in range(1, FEW):
            at = np.flatnonzero(few[:-step] & (run[:-step] == run[step:])) if len(run) > step else np.zeros(0, np.int64)
            out.append((np.full(len(at), PAIR, np.int8), node[at], node[at + step], odd[at] & odd[at + step]))
        at = np.flatnonzero(~few)
        other = at[node[at] != pivots[run[at]]]
        out.append((np.full(len(other), STAR, np.int8), pivots[run[other]], node[other], odds[run[other]] & odd[other]))
        kind, a, b, both = (np.concatenate(c) for c in zip(*out, strict=True))
        if len(kind):
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(both)], names=["kind", "a", "b", "both"])

    for batch in batches:
        key, node, odd = batch["key"].to_numpy(), batch["node"].to_numpy(), batch["score"].to_numpy() % 2 == 1
        if not len(key):
            continue
        same = np.append(last == (key[0], node[0]), (np.diff(key) == 0) & (np.diff(node) == 0))
        last = (key[-1], node[-1])
        rows = [np.concatenate([h, c[~same]]) for h, c in zip(held, (key, node, odd), strict=True)]
        held = tuple(h[:0] for h in held)
        yield from told(*rows, False)
    yield from told(*held, True)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            value, bounds = shingle_sets(part["text"].to_pylist())
            node = _nodes(value, bounds)
            own = np.flatnonzero(node == part["node"].to_numpy())  # a doc_id may stand for several texts
            sets = [value[bounds[i]:bounds[i + 1]].tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(sets, pa.binary())], names=["node", "hashes"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = []
        sizes = []
        for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            both.append(int((large[np.minimum(at, len(large) - 1)] == small).sum()))
            sizes.append((len(x), len(y)))
        na, nb = (pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], na, nb, pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "common"])


def _residues(shared: Broadcast):
    """Per set and its anchor: the first shingles in global order that the anchor lacks, as many as a prefix holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, _ = shared.value
        for batch in batches:
            keys, nodes = [], []
            for node, anchor, x, y in zip(batch["node"].to_pylist(), batch["anchor"].to_pylist(), batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                own, _, prefix = _prefix(x, classes)
                rest = own[~np.isin(own, y, assume_unique=True)][:prefix]
                keys.append(_mix(rest + _U(anchor % 2**64), 5).view(np.int64))
                nodes.append(np.full(len(rest), node))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, common) of pairs of nodes. The first join follows b, of which pairs have many, then a."""
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")
    joined = joined.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(_overlaps, "a long, b long, na long, nb long, common long")


def _linked(common: Column, na: Column, nb: Column) -> Column:
    return 100 * common >= PERCENT * (na + nb - common)


def _between(rows: DataFrame, apart: str) -> DataFrame:
    """Pairs of nodes under one key whose ``apart`` differs; groups are paired first, then their members."""
    groups = rows.select("key", apart).distinct()
    pairs = groups.select("key", F.col(apart).alias("x")).join(groups.select("key", F.col(apart).alias("y")), "key").where("x < y")
    one = rows.select("key", F.col(apart).alias("x"), F.col("node").alias("u"), F.col("root").alias("root_u"), F.col("n").alias("nu"))
    two = rows.select("key", F.col(apart).alias("y"), F.col("node").alias("v"), F.col("root").alias("root_v"), F.col("n").alias("nv"))
    return pairs.join(one, ["key", "x"]).join(two, ["key", "y"])


def similar_nodes(docs: DataFrame, reps: DataFrame, shared: Broadcast, scratch: Scratch) -> DataFrame:
    """(node, root) of all sets that are linked with another one."""
    keys = docs.select("text").mapInArrow(_index(shared), "key long, node long, score int")
    met = scratch.put(keys.repartition("key").sortWithinPartitions("key", "score", "node").mapInArrow(_stars, "kind byte, a long, b long, both boolean"), "met")
    # Similar sets share two keys of their longer prefixes, or one and a pair with a frequent shingle in it. Pairs that
    # met only once among few are similar only if they meet in a crowd too, where every node gets a pivot.
    edges = met.groupBy("a", "b").agg(
        (F.count(F.lit(1)) > 1).alias("twice"), F.max("both").alias("both"), F.max(F.col("kind") == STAR).alias("star"))
    edges = edges.where("star OR twice OR both")
    for side in ("a", "b"):
        edges = edges.join(reps.select(F.col("node").alias(side), F.col("n").alias(f"n{side}")), side)
    fit = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    edges = scratch.put(edges.where(F.col("star") | fit).select("a", "b", "star"), "edges")
    scratch.drop("met")

    # Sets of the nodes that met another one, each computed once from its representative.
    involved = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = reps.join(involved, "node", "left_semi").select("doc_id", "node")
    sets = scratch.put(docs.join(wanted, "doc_id").select("text", "node").mapInArrow(_set_rows, "node long, hashes binary"), "sets", LARGE_ROWS)

    compared = scratch.put(_compared(edges.select("a", "b"), sets), "compared", LARGE_ROWS)
    link = _linked(F.col("common"), F.col("na"), F.col("nb"))
    roots = scratch.put(connected(compared.where(link).select("a", "b"), scratch, "first"), "first-roots")

    # Nodes of a crowd and what they have in common with its pivot, for every pivot that a node has met.
    stars = compared.join(edges.where("star").select("a", "b"), ["a", "b"])
    known = stars.select(F.col("b").alias("node"), F.col("a").alias("anchor"), "common", F.col("nb").alias("n"), F.col("na").alias("n_anchor"))
    known = scratch.put(known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")

    # Two nodes of a crowd share a shingle beyond its pivot, or both are close enough to it; else they are not similar.
    fit = (F.col("root_u") != F.col("root_v")) & (100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv"))
    order = (F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    withs = known.select("node", "anchor").join(sets.select("node", F.col("hashes").alias("set_a")), "node")
    withs = withs.join(sets.select(F.col("node").alias("anchor"), F.col("hashes").alias("set_b")), "anchor")
    residue = withs.select("node", "anchor", "set_a", "set_b").mapInArrow(_residues(shared), "key long, node long").distinct()
    residue = scratch.put(residue, "residue", LARGE_ROWS)
    beyond = _between(residue.join(known.select("node", "root", "n").distinct(), "node"), "root").where(fit).select(*order)
    # A node may pair with one of size m if 3/7 (n + m) <= its overlap with the pivot.
    reach = F.floor((F.col("common") * (100 + PERCENT)) / PERCENT) - F.col("n")
    near = known.withColumn("reach", reach)
    span = near.groupBy("anchor").agg(F.min("n").alias("least_n"), F.max("reach").alias("most_reach"))
    near = near.join(span, "anchor").where("reach >= least_n AND n <= most_reach")
    loose = near.where(~_linked(F.col("common"), F.col("n"), F.col("n_anchor")))
    one = near.select("anchor", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("reach").alias("reach_u"), F.col("root").alias("root_u"))
    two = loose.select("anchor", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("reach").alias("reach_v"), F.col("root").alias("root_v"))
    close = one.join(two, "anchor").where((F.col("nu") <= F.col("reach_v")) & (F.col("nv") <= F.col("reach_u")) & fit).select(*order)
    rest = beyond.unionByName(close).distinct()
    rest = scratch.put(rest.join(compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    late = scratch.put(_compared(rest, sets).where(link).select("a", "b"), "late", LARGE_ROWS)
    links = scratch.put(late.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")
    return connected(links, scratch, "last")


def near_duplicates(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links; besides
    component (a number per component, null without shingles) and row (a number of the row: the given stored one, or one
    that holds for this result only).

    Two documents link when 100 x common >= 75 x united shingles. Null, empty and blank texts have no shingles and
    are linked with nothing; texts of one to four words are one shingle. Equal sets are one node, whatever their number.
    A null doc_id takes part but is never the smallest; a component of nulls has a null component_id. Repeated rows each
    get their row; other columns are not read; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    number = F.monotonically_increasing_id() if row is None else row.cast("long")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("row"))
    read = scratch.put(docs.mapInArrow(_read, READ), "read")
    members = scratch.put(read.where("slice IS NULL").select("doc_id", "row", "node", "n_shingles"), "members")
    shared = spark.sparkContext.broadcast(frequency_classes(read, scratch))
    scratch.drop("read")
    filled = members.where("n_shingles > 0")
    reps = scratch.put(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n")), "reps")
    roots = similar_nodes(docs, reps, shared, scratch)
    named = filled.groupBy("node").agg(F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("least"))
    named = scratch.put(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.select("node", "root").join(least, "root").select("node", "root", "component_id")
    found = filled.join(of_node, "node").select("doc_id", "n_shingles", "component_id", F.col("root").alias("component"), "row")
    bare = members.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("component_id"), F.lit(None).cast("long").alias("component"), "row")
    return scratch.keep(found.unionByName(bare).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
