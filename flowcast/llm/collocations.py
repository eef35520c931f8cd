"""The best collocations of each language: phrases of two to four words, grown best first.

A phrase is grown word by word from its prefix P, and P's count bounds all that grow from it: cut after the first word, a
phrase Q scores 2000000 f(Q) / (f(first word) + f(rest)), f(rest) >= f(Q) and f(Q) <= f(P), so at most
bound(P) = 2000000 f(P) / (f(first word) + f(P)). Only prefixes whose bound reaches a threshold are expanded, by one pass over
the coded corpus that counts their continuations; with them those prefixes that may hold a longer phrase which drops one of
the best. The threshold of a language starts at the score of its 4000th pair and falls until 2000 phrases that survive reach
it, or nothing is left to expand: then the 2000th score and its ties are settled.

Words are coded by 64-bit hashes that are checked to be free of collisions. Which prefixes a pass expands travels as a bit set
of fixed size; a bit that several prefixes share costs counting, never a count.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowcast.llm.common import Scratch, slices, table

LIMIT, LEAST, KEPT = 2000, 30, 80  # phrases per language, least count, percentage of a phrase that a longer one must hold
BITS = 1 << 26
CHUNK = 1_000_000  # bytes of a text that a task works on at once
PHRASES = 400_000  # words among which phrases are counted at once
BATCH_ROWS = 1_000  # rows that pass to Python at once
REMEMBERED = 200_000
_MARKS = b".,;:!?\n\x0b\x0c\r"
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
_BREAK = b"\n"
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_MARKED = bytes.maketrans(_MARKS + b"\t" + _UPPER, _BREAK * len(_MARKS) + b" " + _LOWER)
_SPACED = bytes.maketrans(_MARKS + b"\t" + _UPPER, b" " * len(_MARKS) + b" " + _LOWER)
_NEXT = 3  # words before a phrase's last one, at most
# The primes of the 64-bit xxHash, by which Spark hashes columns.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed_onto(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 makes of a long after the columns before it gave ``seed``; both unsigned."""
    h = (seed + _P5 + np.uint64(8)) ^ (_turned(value * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _parts(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about CHUNK bytes that end between words, and whether a part goes on in the piece before."""
    at, goes_on = 0, False
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        end = gap.end() if gap else len(text)
        yield text[at:end], goes_on
        goes_on = text[end - 1] not in _MARKS
        at = end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """lang and text in UTF-8; nulls are empty."""
    for part in slices(batch):
        yield from zip(part["lang"].to_pylist(), (x or b"" for x in part["text"].cast(pa.binary()).to_pylist()))


def _tokens(part: bytes) -> list[bytes]:
    """Words with A-Z in lower case, and a line break for every mark."""
    return list(filter(None, part.translate(_MARKED).replace(_BREAK, b" \n ").split(b" ")))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def given() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
        counts.clear()
        langs, words, ns = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in _texts(batch):
            mine = counts.setdefault(lang, Counter())
            for part, _ in _parts(text):
                mine.update(part.translate(_SPACED).split())
                if sum(map(len, counts.values())) > REMEMBERED:
                    yield given()
                    mine = counts.setdefault(lang, Counter())
    yield given()


class _Codes(dict):
    """Code of a word; marks and words that are rare for sure have 0."""

    def __init__(self, seed: int, bits: np.ndarray):
        super().__init__()
        self.seed, self.bits = seed, bits

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        code = 0
        if word != _BREAK:
            code = xxhash.xxh64_intdigest(word, self.seed)
            cell = code & (BITS - 1)
            if not int(self.bits[cell >> 6]) >> (cell & 63) & 1:
                code = 0
            elif code >> 63:
                code -= 1 << 64
        self[word] = code
        return code


def code_texts(seed: int, bits) -> Callable:
    """lang, lead, ids: the coded words, 0 between those that no phrase may span. The first ``lead`` ids are context that an
    earlier row has counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(seed, bits.value)
        for batch in batches:
            for part in slices(batch):
                langs, leads, ids = [], [], []
                for lang, text in _texts(part):
                    tail = np.zeros(0, np.int64)
                    for piece, goes_on in _parts(text):
                        tokens = _tokens(piece)
                        found = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
                        tail = tail[-_NEXT:] if goes_on else tail[:0]
                        row = np.concatenate([tail, found])
                        # One 0 is as good as many, but the context must keep its length.
                        keep = np.ones(len(row), bool)
                        keep[len(tail) + 1:] = (row[len(tail) + 1:] != 0) | (row[len(tail):-1] != 0)
                        langs.append(lang), leads.append(len(tail)), ids.append(row[keep])
                        tail = row
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(leads, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["lang", "lead", "ids"])
    return run


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    cell = key & np.uint64(BITS - 1)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) != 0


def _counted(lang: np.ndarray, words: list[np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each distinct phrase; equal keys of different phrases are told apart."""
    order = np.argsort(key)
    columns = [key, lang, *words]
    new = np.ones(len(key), bool)
    new[1:] = reduce(np.logical_or, (c[order[1:]] != c[order[:-1]] for c in columns))
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(key)))


def count_phrases(size: int, heads=None, tails=None, done=None) -> Callable:
    """lang, w1 ... w<size>, n: how often each phrase occurs in a batch. Its first words but one must be in ``heads`` and not in
    ``done``, its last two in ``tails``."""
    names = ["lang", *(f"w{i + 1}" for i in range(size)), "n"]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lengths = pc.list_value_length(batch["ids"]).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, before + PHRASES, side="right"))))
            yield batch.slice(at, end - at)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows(batch):
                lengths = pc.list_value_length(part["ids"]).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part["ids"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) < size:
                    continue
                coded = part["lang"].dictionary_encode()
                seeds = np.array([xxhash.xxh64_intdigest(x, 42) for x in coded.dictionary.to_pylist()], np.uint64)
                row = np.repeat(np.arange(part.num_rows), lengths)
                counted = np.cumsum(lengths) - lengths + part["lead"].to_numpy()
                last = np.arange(size - 1, len(ids))
                good = (row[last] == row[last - size + 1]) & (last >= counted[row[last]])
                for back in range(size):
                    good &= ids[last - back] != 0
                last = last[good]
                lang = coded.indices.to_numpy()[row[last]]
                words = [ids[last - size + 1 + i] for i in range(size)]

                def keyed(columns: list[np.ndarray]) -> np.ndarray:
                    return reduce(hashed_onto, (c.view(np.uint64) for c in columns), seeds[lang])

                for bits, span, wanted in ((tails, slice(size - 2, size), True), (heads, slice(0, size - 1), True), (done, slice(0, size - 1), False)):
                    if bits is not None and len(lang):
                        keep = _has(bits.value, keyed(words[span])) == wanted
                        lang, words = lang[keep], [w[keep] for w in words]
                if len(lang):
                    first, n = _counted(lang, words, keyed(words))
                    yield pa.RecordBatch.from_arrays([pa.array(coded.dictionary).take(pa.array(lang[first])), *(pa.array(w[first]) for w in words), pa.array(n)], names)
    return run


def _schema(size: int) -> str:
    return "lang string, " + "".join(f"w{i + 1} long, " for i in range(size)) + "n long"


def bit_set(keys: DataFrame, key: Column) -> np.ndarray:
    """A bit for every key, by its lower bits: what reaches the driver is BITS / 64 numbers at most."""
    cell = key.bitwiseAND(F.lit(BITS - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = keys.select(F.shiftright(cell, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    if words.num_rows:
        out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _exact(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("decimal(20,0)")


def _score(a, l, r) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)), in whole numbers of any size."""
    return F.call_function("div", _exact(a) * F.lit(2_000_000).cast("decimal(7,0)"), _exact(l) + _exact(r))


def _holds(longer, shorter) -> Column:
    """The longer phrase has so much of the shorter one's count that it drops it."""
    return _exact(longer) * 100 >= _exact(shorter) * KEPT


def _lowest(cuts: list[tuple]) -> list[Column]:
    """l, r and score of the cut (l, r, a) that scores lowest, the first of equal ones."""
    best = F.least(*[F.struct(_score(a, l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r, a) in enumerate(cuts)])
    return [best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score")]


class Growth:
    """Counts of the phrases expanded so far, and what can be told from them."""

    def __init__(self, coded: DataFrame, words: DataFrame, scratch: Scratch):
        self.coded, self.scratch, self.spark, self.steps = coded, scratch, coded.sparkSession, 0
        one = words.select("lang", F.col("code").alias("w"), F.col("f").alias("fw"))
        pairs = self._count(2)
        pairs = pairs.join(one.withColumnsRenamed({"w": "w1", "fw": "f1"}), ["lang", "w1"]).join(one.withColumnsRenamed({"w": "w2", "fw": "f2"}), ["lang", "w2"])
        self.pairs = self._put(pairs.select("lang", "w1", "w2", "a", "f1", "f2", _score("a", "f1", "f2").alias("score"), _score("a", "f1", "a").alias("bound")))
        self.tails = self._bits(self.pairs, 2)
        self.threes: DataFrame | None = None
        self.fours: DataFrame | None = None
        self.heads = {3: np.zeros(BITS >> 6, np.uint64), 4: np.zeros(BITS >> 6, np.uint64)}

    def _put(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return self.scratch.put(df, f"growth-{self.steps}", BATCH_ROWS)

    def _bits(self, df: DataFrame, size: int) -> np.ndarray:
        return bit_set(df, F.xxhash64("lang", *[f"w{i + 1}" for i in range(size)]))

    def _count(self, size: int, heads: np.ndarray | None = None, done: np.ndarray | None = None) -> DataFrame:
        share = self.spark.sparkContext.broadcast
        bits = [share(x) if x is not None else None for x in (heads, self.tails if size > 2 else None, done)]
        found = self.coded.mapInArrow(count_phrases(size, *bits), _schema(size))
        return found.groupBy("lang", *[f"w{i + 1}" for i in range(size)]).agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)

    def _expand(self, size: int, prefixes: DataFrame) -> DataFrame | None:
        """Counts of the phrases of ``size`` words that start with the prefixes and were not counted before."""
        wanted, done = self._bits(prefixes, size - 1), self.heads[size]
        if not (wanted & ~done).any():
            return None
        self.heads[size] = wanted | done
        return self._count(size, wanted, done)

    def _grow_threes(self, prefixes: DataFrame) -> None:
        found = self._expand(3, prefixes)
        if found is None and self.threes is not None:
            return
        found = found if found is not None else self.pairs.limit(0).select("lang", "w1", "w2", F.col("w2").alias("w3"), "a")
        head = self.pairs.select("lang", "w1", "w2", "f1", F.col("a").alias("f12"))
        tail = self.pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
        found = found.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
        l, r, score = _lowest([("f1", "f23", "a"), ("f12", "f3", "a")])  # noqa: E741
        found = found.select("lang", "w1", "w2", "w3", "a", "f1", "f12", "f23", "f3", l, r, score, _score("a", "f1", "a").alias("bound"))
        self.threes = self._put(found if self.threes is None else self.threes.unionByName(found))

    def _grow_fours(self, prefixes: DataFrame) -> None:
        found = self._expand(4, prefixes)
        if found is None and self.fours is not None:
            return
        found = found if found is not None else self.threes.limit(0).select("lang", "w1", "w2", "w3", F.col("w3").alias("w4"), "a")
        self.fours = self._put(found if self.fours is None else self.fours.unionByName(found))

    def round(self, floor: DataFrame) -> DataFrame:
        """Expands what may reach ``floor`` (lang, floor) or drop what does; the surviving phrases that reach it."""
        def reach(df: DataFrame, value: str = "score") -> DataFrame:
            return df.join(floor, "lang").where(F.col(value) >= F.col("floor")).drop("floor")

        def before(cands: DataFrame, size: int) -> DataFrame:
            """Phrases of ``size`` words whose last ones start a candidate that they may hold: they may begin what drops it."""
            ends = [f"w{i}" for i in range(2, size + 1)]
            first = cands.groupBy("lang", *[F.col(f"w{i + 1}").alias(f"w{i + 2}") for i in range(size - 1)]).agg(F.min("a").alias("least"))
            known = self.pairs if size == 2 else self.threes
            return known.join(first, ["lang", *ends]).where(_holds("a", "least"))

        two = ["lang", "w1", "w2"]
        pairs = self._put(reach(self.pairs))
        self._grow_threes(reach(self.pairs, "bound").select(two).unionByName(before(pairs, 2).select(two)))
        threes = self._put(reach(self.threes))
        ends = reach(self.threes, "bound").select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))  # cut after the first word, a four needs its last three
        self._grow_threes(before(threes, 2).select(two).unionByName(ends))
        threes = self._put(reach(self.threes))
        three = ["lang", "w1", "w2", "w3"]
        self._grow_fours(reach(self.threes, "bound").select(three).unionByName(before(threes, 3).select(three)))

        head = self.threes.select(*three, "f1", "f12", F.col("a").alias("f123"), "bound")
        tail = self.threes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("a").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4"))
        fours = reach(self.fours.join(head, three), "bound").join(tail, ["lang", "w2", "w3", "w4"])
        l, r, score = _lowest([("f1", "f234", "a"), ("f12", "f34", "a"), ("f123", "f4", "a")])  # noqa: E741
        fours = reach(fours.select("lang", "w1", "w2", "w3", "w4", "a", l, r, score))

        def survivors(cands: DataFrame, longer: DataFrame, size: int) -> DataFrame:
            """Candidates that no phrase longer by a word holds; what a still longer one holds, one of these holds too."""
            names = [f"w{i + 1}" for i in range(size)]
            begins = longer.groupBy("lang", *names).agg(F.max("a").alias("most"))
            closes = longer.groupBy("lang", *[F.col(f"w{i + 2}").alias(f"w{i + 1}") for i in range(size)]).agg(F.max("a").alias("most"))
            most = begins.unionByName(closes).groupBy("lang", *names).agg(F.max("most").alias("most"))
            left = cands.join(most, ["lang", *names], "left").where(F.col("most").isNull() | ~_holds("most", "a"))
            return left.select("lang", F.array(*names).alias("codes"), "a", F.col("l"), F.col("r"), "score")

        pairs = pairs.withColumnsRenamed({"f1": "l", "f2": "r"})
        fours = fours.select("lang", F.array("w1", "w2", "w3", "w4").alias("codes"), "a", "l", "r", "score")
        return self._put(survivors(pairs, self.threes, 2).unionByName(survivors(threes, self.fours, 3)).unionByName(fours))


def _floors(pairs: DataFrame, rank: int) -> DataFrame:
    """lang, floor: the score of the pair of that rank, 0 where there are fewer. Ranked in parts first, so that no task has a
    whole language."""
    part = F.pmod(F.xxhash64("w1", "w2"), F.lit(256))
    best = pairs.select("lang", "score", part.alias("part")).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("score")))).where(F.col("at") <= rank)
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))).where(F.col("at") <= rank)
    return best.groupBy("lang").agg(F.when(F.count(F.lit(1)) == rank, F.min("score")).otherwise(F.lit(0)).cast("long").alias("floor"))


def coded_corpus(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The texts as codes, and every word (lang, word, code, f)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = texts.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = scratch.put(words, "words", BATCH_ROWS)
    salt = 0
    while True:
        code = F.xxhash64(F.lit(salt).cast("long"), "word")
        same = words.groupBy(code.alias("code")).agg(F.min("word").alias("one"), F.max("word").alias("other"))
        if same.where("one <> other OR code = 0").isEmpty():
            break
        salt += 1
    words = words.withColumn("code", code)
    bits = spark.sparkContext.broadcast(bit_set(words.where(F.col("f") >= LEAST), F.col("code")))
    seed = xxhash.xxh64_intdigest(salt.to_bytes(8, "little"), 42)
    coded = texts.mapInArrow(code_texts(seed, bits), "lang string, lead int, ids array<long>")
    # Frequent words repeat a lot: a larger dictionary keeps their codes at a few bits each.
    return scratch.put(coded, "coded", BATCH_ROWS, {"parquet.dictionary.page.size": 4 << 20}), words


def collocations(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null lang is ``und``. Repeated rows count each for itself. Long texts are read in parts that end
    between words and carry their context along, so no phrase is lost or counted twice. Languages without a phrase, and empty
    tables, give no rows. Ties go by count, then by the phrase's bytes. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    coded, words = coded_corpus(docs, scratch)
    growth = Growth(coded, words.where(F.col("f") >= LEAST), scratch)
    rank, kept = 2 * limit, None
    floors = scratch.put(_floors(growth.pairs, rank), "floors-0")
    while True:
        found = growth.round(floors)
        enough = floors.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("found")), "lang", "left").withColumn("settled", (F.col("floor") == 0) | (F.coalesce("found", F.lit(0)) >= limit))
        settled = found.join(enough.where("settled").select("lang"), "lang", "left_semi")
        kept = settled if kept is None else kept.unionByName(settled)
        open_ = enough.where("NOT settled").select("lang")
        if open_.isEmpty():
            break
        rank *= 4
        floors = scratch.put(_floors(growth.pairs.join(open_, "lang", "left_semi"), rank), f"floors-{rank}")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = kept.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= limit)
    spelled = best.select("*", F.posexplode("codes").alias("at", "code")).join(words.select("lang", "code", "word"), ["lang", "code"])
    named = spelled.groupBy("lang", "codes", "a", "l", "r", "score").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= limit)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return scratch.keep(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


SQL = r"""
WITH piece AS (SELECT lang, doc_id, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, doc_id,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM ws GROUP BY 1),
g AS (SELECT lang, list_slice(w, s + 1, s + k) AS g, k FROM (SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM ws, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
fr AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cut AS (SELECT q.lang, q.k, q.g, q.f AS a, c, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * q.f) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT * FROM fr, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k) q JOIN fr l ON l.lang = q.lang AND l.g = list_slice(q.g, 1, q.c) JOIN fr r ON r.lang = q.lang AND r.g = list_slice(q.g, q.c + 1, q.k)),
cand AS (SELECT lang, k, g, a, arg_min(l, (score, c)) AS l, arg_min(r, (score, c)) AS r, min(score) AS score FROM cut GROUP BY 1, 2, 3, 4),
inner_ AS (SELECT lang, f, list_slice(g, s + 1, s + m) AS g FROM (SELECT lang, k, g, f, m, unnest(range(0, k - m + 1)) AS s FROM fr, (SELECT unnest([2, 3]) AS m) WHERE m < k)),
most AS (SELECT lang, g, max(f) AS f FROM inner_ GROUP BY 1, 2),
left_ AS (SELECT cand.* FROM cand LEFT JOIN most USING (lang, g) WHERE most.f IS NULL OR 100 * CAST(most.f AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
