"""Packing token pieces into as few sequences as possible by bin completion with branch and bound.

Pieces differ only by length and there are at most ``capacity`` lengths, so the search runs on a histogram whose size
does not depend on the corpus: how many pieces of each length are left. The better of best fit decreasing and of a
greedy completion is the incumbent. Unless that meets the lower bound, the search branches over the undominated fillings
of the longest length left and how often each is used, with the incumbent and the lower bound of what is left to prune,
within a fixed number of steps. The resulting plan (a few thousand patterns with multiplicities) is dealt out to the pieces by their rank within their length, which
Spark computes over salted groups.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowcast.llm import tokens
from flowcast.llm.common import Scratch, release_memory, slices

CAPACITY = 2048
BATCH_ROWS = 1000  # whole texts that pass to Python at once
Plan = list[tuple[list[int], int]]  # fillings with their multiplicities
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Encode every whole text, append ``end_id``, and cut documents of more than ``capacity`` ids into pieces."""
    path = vocabulary or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of what the worker did before
        encode, end = tokens.encoder(path), np.uint32(end_id).astype("<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode.encode(part["text"].to_pylist()), strict=True):
                    ids = memoryview(ids + end)
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start:start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class _Left:
    """How many pieces of each length are left, with the lengths that occur in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {size: n for size, n in counts.items() if n}
        self.sizes = sorted(self.count)

    def take(self, size: int, times: int) -> None:
        self.count[size] -= times
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]


def _best_fit(left: _Left, room: int) -> list[int]:
    """The incumbent: again and again the longest length that still fits."""
    chosen, used = [], {}
    top = room
    while True:
        at = bisect.bisect_right(left.sizes, min(room, top)) - 1
        if at < 0:
            return chosen
        size = left.sizes[at]
        if used.get(size, 0) < left.count[size]:
            chosen.append(size)
            used[size] = used.get(size, 0) + 1
            room -= size
        else:
            top = size - 1
            if top <= 0:
                return chosen


def _complete(left: _Left, room: int, waste_bound: int, nodes: int) -> list[int]:
    """The filling of ``room`` with the least waste, by depth-first search over lengths in descending order.

    A filling is dominated when a left length could still be added or put in place of one of its lengths without
    overfilling; the search therefore always tries the longest length first and leaves a branch once its waste cannot
    fall below the best waste so far. It ends at ``waste_bound`` (waste that costs no further sequence) or after
    ``nodes`` steps, with the best-fit incumbent as the least it returns.
    """
    best = _best_fit(left, room)
    waste = room - sum(best)
    if waste <= waste_bound:
        return best
    sizes, steps = left.sizes, [nodes]

    def search(room: int, limit: int, chosen: list[int]) -> bool:
        # A level is one length, as often as it is used, so the depth is at most the number of different lengths that fit.
        nonlocal best, waste
        if room < waste:
            best, waste = list(chosen), room
            if waste <= waste_bound:
                return True
        at = bisect.bisect_right(sizes, min(room, limit)) - 1
        while at >= 0:
            size = sizes[at]
            most = min(left.count[size], room // size)
            for times in range(most, 0, -1):
                if steps[0] <= 0:
                    return False
                steps[0] -= 1
                rest = room - times * size
                # One exact partner ends the branch without going through the lengths between.
                if 0 < rest < size and rest in left.count:
                    best, waste = [*chosen, *[size] * times, rest], 0
                    return True
                if search(rest, size - 1, [*chosen, *[size] * times]):
                    return True
            at -= 1
        return False

    search(room, room, [])
    return best


def completed_plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 3000) -> Plan:
    """Greedy completion: the longest length left gets its fullest filling, as often as the counts allow."""
    left, plan = _Left(counts), []
    total = sum(size * n for size, n in left.count.items())
    slack = -total % capacity  # waste that the lower bound of ceil(total / capacity) sequences allows anyway
    while left.sizes:
        longest = left.sizes[-1]
        left.take(longest, 1)
        filling = [longest, *_complete(left, capacity - longest, 0, nodes)]
        left.count[longest] = left.count.get(longest, 0) + 1
        if left.count[longest] == 1:
            bisect.insort(left.sizes, longest)
        waste = capacity - sum(filling)
        need = {size: filling.count(size) for size in set(filling)}
        times = min(left.count[size] // n for size, n in need.items())
        if waste > slack:
            times = max(1, times // 2)  # costly fillings are taken up with care, as the mix left changes
        slack = max(0, slack - waste * times)
        for size, n in need.items():
            left.take(size, n * times)
        plan.append((filling, times))
    return plan


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit decreasing of single pieces, done for whole groups of equal sequences at once."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: list[int], times: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
        open_.setdefault(room, []).append((filling, times))

    for size in sorted((size for size, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, filling, times = capacity, [], n  # sequences not begun yet
            each = min(room // size, n)
            whole = min(times, n // each)
            put(room - each * size, filling + [size] * each, whole)
            if times > whole and filling:
                put(room, filling, times - whole)
            n -= each * whole
    return [own for groups in open_.values() for own in groups]


def fewest(sizes: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """A lower bound of the sequences needed (Martello and Toth's L2). ``sizes`` ascend."""
    total = int(sizes @ count)
    bound = -(-total // capacity)
    n, volume = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(sizes * count)])
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    # Pieces under k are left out; those over capacity - k stand alone, and others of more than half have some room left.
    k = np.concatenate([[0], sizes[:half]])
    low, high = np.searchsorted(sizes, k), np.maximum(np.searchsorted(sizes, capacity - k, side="right"), half)
    room = (n[high] - n[half]) * capacity - (volume[high] - volume[half])
    over = np.maximum(0, volume[half] - volume[low] - room)
    return max(bound, int((n[-1] - n[half] + -(-over // capacity)).max()))


def _dominates(one: list[int], other: list[int]) -> bool:
    """Whether the pieces of ``other`` fit into the places of ``one``, found by first fit; False may be wrong."""
    rooms = list(one)
    for size in other:
        for i, room in enumerate(rooms):
            if room >= size:
                rooms[i] -= size
                break
        else:
            return False
    return True


def _fillings(sizes: list[int], count: list[int], capacity: int, steps: int, most: int = 24) -> list[list[tuple[int, int]]]:
    """Undominated fillings with the longest length left, fullest first: pairs of (index of a length, times).

    At most ``steps`` steps and ``most`` fillings.
    """
    left = [i for i, n in enumerate(count) if n]
    top, shortest = left[-1], sizes[left[0]]
    found: list[tuple[int, list[tuple[int, int]]]] = []
    # What is left to look at: fillings begun, with the place in ``left`` below which lengths may be added. An explicit stack.
    stack = [(capacity - sizes[top], len(left) - 1, [(top, 1)])]
    while stack and steps > 0:
        room, at, chosen = stack.pop()
        steps -= 1
        if at < 0 or room < shortest:
            # Full, unless a length that was passed over would still fit.
            used = dict(chosen)
            if not any(count[i] > used.get(i, 0) for i in left[:bisect.bisect_right(left, room, key=lambda i: sizes[i])]):
                found.append((room, chosen))
            continue
        at = min(at, bisect.bisect_right(left, room, key=lambda i: sizes[i]) - 1)
        i = left[at]
        times = min(count[i] - (i == top), room // sizes[i])
        for t in range(times + 1):  # the most copies are looked at first
            own = [*chosen[:-1], (i, t + 1)] if i == top and t else [*chosen, (i, t)] if t else chosen
            stack.append((room - t * sizes[i], at - 1, own))
    found.sort(key=lambda own: (own[0], len(own[1])))
    kept: list[list[tuple[int, int]]] = []
    spread: list[list[int]] = []
    for _, chosen in found[:8 * most]:
        pieces = [sizes[i] for i, t in chosen for _ in range(t)]
        if len(kept) < most and not any(_dominates(other, pieces) for other in spread):
            kept.append(chosen)
            spread.append(pieces)
    return kept


def _branch(counts: dict[int, int], capacity: int, nodes: int, best: Plan, bound: int) -> Plan:
    """The best plan found within ``nodes`` steps; states that depart least from the first choices come first."""
    sizes = sorted(size for size, n in counts.items() if n)
    each = np.array(sizes, dtype=np.int64)
    least = sum(times for _, times in best)
    plan = best
    serial = itertools.count()
    # (departures, -depth, serial, sequences so far, counts left before the choice, choice, times, choices before)
    heap: list = [(0, 0, next(serial), 0, np.array([counts[size] for size in sizes], dtype=np.int64), [], 0, None)]
    seen: dict[bytes, int] = {}
    while heap and nodes > 0 and least > bound:
        away, depth, _, made, count, choice, times, before = heapq.heappop(heap)
        nodes -= 1
        count = count.copy()
        for i, t in choice:
            count[i] -= t * times
        made += times
        chosen = (choice, times, before) if times else None
        if not count.any():
            if made < least:
                least, plan = made, []
                while chosen:
                    own, often, chosen = chosen
                    plan.append(([sizes[i] for i, t in own for _ in range(t)], often))
                plan.reverse()
            continue
        state = count.tobytes()
        if made + fewest(each, count, capacity) >= least or seen.get(state, least) <= made:
            continue
        seen[state] = made
        further = 0
        for own in _fillings(sizes, count.tolist(), capacity, 500):
            # Halves down to 1 are enough: a filling can be chosen again.
            often = int(min(count[i] // t for i, t in own))
            while often:
                heapq.heappush(heap, (away + further, depth - 1, next(serial), made, count, own, often, chosen))
                further, often = further + 1, often // 2
    return plan


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 3000) -> Plan:
    """Fillings with their multiplicities that use every piece once. ``counts``: pieces by length.

    Never more sequences than best fit decreasing, or than the greedy completion. The fewest possible if they meet the lower
    bound; where they do not, the branching ends after ``nodes`` states and returns the best plan so far.
    """
    counts = {int(size): int(n) for size, n in counts.items() if n}
    if not counts:
        return []
    sizes = sorted(counts)
    bound = fewest(np.array(sizes, dtype=np.int64), np.array([counts[size] for size in sizes], dtype=np.int64), capacity)
    best = best_fit_plan(counts, capacity)
    if sum(times for _, times in best) > bound:
        best = min(best, completed_plan(counts, capacity, nodes), key=lambda plan: sum(times for _, times in plan))
    if sum(times for _, times in best) > bound:
        best = _branch(counts, capacity, nodes, best, bound)
    return best


def _slots(plan: Plan) -> tuple[dict[int, np.ndarray], int]:
    """Per length: rows (first rank, first sequence, offset) in ascending rank; a row covers one place of a filling."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for size in filling:
            slots.setdefault(size, []).append((used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        sequence += times
    return {size: np.array(rows, dtype=np.int64) for size, rows in slots.items()}, sequence


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = 3000, salts: int = 64) -> DataFrame:
    """Give each row of ``pieces`` (any columns, with ``length`` between 1 and ``capacity``) a sequence_id and offset.

    ``pieces`` must be stable (a written table): it is read twice. Equal lengths are interchangeable, so repeated rows
    and ties need no order; null identifiers are packed like any other. No pieces give no rows.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # At most capacity x salts rows, whatever the corpus.
    tally = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for row in sorted(tally):
        base[row["length"], row["_salt"]] = counts.get(row["length"], 0)
        counts[row["length"]] = counts.get(row["length"], 0) + row["n"]
    slots, _ = _slots(plan_sequences(counts, capacity, nodes))
    shared = spark.sparkContext.broadcast((slots, base))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(order).cast("long") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, base = shared.value
        for batch in batches:
            length, salt = batch["length"].to_numpy(), batch["_salt"].to_numpy()
            rank = batch["_rank"].to_numpy().copy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                own = rank[at] + np.array([base[int(size), int(s)] for s in salt[at]], dtype=np.int64)
                rows = slots[int(size)]
                row = np.searchsorted(rows[:, 0], own, side="right") - 1
                sequence[at], offset[at] = rows[row, 1] + own - rows[row, 0], rows[row, 2]
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    fields = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Documents of up to ``capacity`` ids are never cut. Rows that
    repeat are packed one by one; a null doc_id stays null. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.put(cut_pieces(docs, vocabulary, capacity), "pieces", BATCH_ROWS)
    return scratch.keep(pack(pieces, capacity))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"))
