"""Near-equal lines by a segment-partition edit join.

A line is cut into one segment more than edits are allowed, so of two lines within that distance the longer one holds
some segment of the shorter one unharmed, near its place. Segments are index keys together with the length of their
line; the longer line probes for each length and segment only with the substrings that position arithmetic leaves. A key
that very many lines share is refined: as that segment is equal, all edits lie in the rest of the line, which is cut and
probed the same way; there a key also carries a mark of its whole line, the parity of how many characters it has of each
of 31 sorts, which an edit can only change in two bits, and lines whose marks are further apart do not meet. Of the
rest, lines that keep too few of many short segments near their place are left out, and what remains is verified with an
edit distance that keeps a band of diagonals as bits, one word per number of edits, and moves it along the line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import Scratch, table
from flowcast.llm.components import connected

EDITS = 2
SHORTEST = 12  # lines of fewer characters are duplicates only if equal
CROWDED = 64  # index lines of a key beyond which it is refined


def rows_of(docs: DataFrame) -> DataFrame:
    """One row per line: doc (a number per row of ``docs``), doc_id, at, line. Blanks at its ends and blank lines drop out.

    Each document also has a row with at = -1 and no line, so that one scan, and its numbers, give lines and documents.
    """
    rows = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls")).withColumn("doc", F.monotonically_increasing_id())
    rows = rows.select("doc", "doc_id", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "ls")).alias("at", "raw"))
    return rows.select("doc", "doc_id", (F.col("at") - 1).alias("at"), F.trim("raw").alias("line")).where("at = -1 OR line <> ''")


def lines_of(docs: DataFrame) -> DataFrame:
    """The lines alone."""
    return rows_of(docs).where("at >= 0")


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def mark_of(line: Column) -> Column:
    """Bit k says whether the number of characters whose code modulo 31 is k is odd.

    An edit takes away one character at most and adds one at most, so the marks of lines ``edits`` apart differ in at most
    2 * ``edits`` bits.
    """
    bits = F.array(*[F.lit(1 << k) for k in range(31)])  # bit_count would count the sign of an int as 33 bits
    return F.aggregate(F.split(line, ""), F.lit(0), lambda mark, letter: mark.bitwiseXOR(F.get(bits, F.ascii(letter) % 31)))


def _keys(rows: DataFrame, kinds: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """(id, text, mark, key, start, size) of substrings of ``text``, for each kind (shorter, i, move): the substring at the place of
    segment ``i`` of a line that many characters shorter, moved. ``rows``: id, parent, text, mark.

    One row per kind and then one small expression for all keeps the generated code small.
    """
    parts = edits + 1
    spread = rows.select("id", "parent", "text", "mark", F.char_length("text").alias("own")).select(
        "*", F.explode(F.array(*[F.struct(F.lit(a).alias("shorter"), F.lit(b).alias("i"), F.lit(c).alias("move")) for a, b, c in kinds])).alias("kind"))
    spread = spread.select("id", "parent", "text", "mark", "own", (F.col("own") - F.col("kind.shorter")).alias("length"), F.col("kind.i").alias("i"), F.col("kind.move").alias("move")).where("length >= 1")
    # The last segments are one longer where the length doesn't divide.
    size, longer = F.floor(F.col("length") / parts).cast("int"), F.col("length") % parts
    start = 1 + F.col("i") * size + F.greatest(F.lit(0), F.col("i") - parts + longer) + F.col("move")
    spread = spread.select("id", "parent", "text", "mark", "own", "length", "i", start.alias("start"), (size + (F.col("i") >= parts - longer).cast("int")).alias("size"))
    spread = spread.where("start >= 1 AND start + size - 1 <= own")
    return spread.select("id", "text", "mark", F.xxhash64("parent", "length", "i", F.col("text").substr(F.col("start"), F.col("size"))).alias("key"), "start", "size")


def index_keys(rows: DataFrame, edits: int) -> DataFrame:
    """Keys of a line's own segments; an empty one, of a line too short for its segments, is a key like any other."""
    return _keys(rows, [(0, i, 0) for i in range(edits + 1)], edits)


def probe_keys(rows: DataFrame, edits: int) -> DataFrame:
    """Keys of substrings that can equal a segment of a line shorter by 0 to ``edits`` characters, but for the line's own
    segments, which are index keys.

    With at most i edits before segment i and ``edits`` - i behind it, or the other way round, it moves no further.
    """
    return _keys(rows, [
        (shorter, i, move) for shorter in range(edits + 1) for i in range(edits + 1)
        for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1) if shorter or move], edits)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are at most ``edits`` apart.

    Bit ``d`` of word ``e`` says that the first i letters of a and the first i + d - edits of b are at most e apart. A
    letter of a keeps the diagonals on which it matches; an edit takes a word's bits over to the next word: on the same
    diagonal (replaced), one lower (left out of b) or one higher (put into b).
    """
    edge = F.repeat(F.lit("￿"), edits)
    letters, others = F.split(a, ""), F.split(F.concat(edge, b, edge), "")
    band = (1 << (2 * edits + 1)) - 1

    # Per letter of a: on which diagonals it equals a letter of b. Whole arrays are zipped, so that each is made once.
    def bit(d: int):
        return lambda x, y: F.when(x == y, 1 << d).otherwise(0)

    same = [F.zip_with(letters, F.slice(others, d + 1, F.char_length(a)), bit(d)) for d in range(2 * edits + 1)]
    masks = reduce(lambda x, y: F.zip_with(x, y, lambda m, n: m.bitwiseOR(n)), same)

    def step(state: Column, match: Column) -> Column:
        words = [state["e0"].bitwiseAND(match)]
        for e in range(1, edits + 1):
            before = state[f"e{e - 1}"]
            word = state[f"e{e}"].bitwiseAND(match).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(word.bitwiseAND(F.lit(band)))
        return F.struct(*[w.alias(f"e{e}") for e, w in enumerate(words)])

    first = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).bitwiseAND(F.lit(band)).alias(f"e{e}") for e in range(edits + 1)])
    n, m = F.char_length(a), F.char_length(b)
    last = F.aggregate(masks, first, step)[f"e{edits}"]
    close = F.abs(n - m) <= edits
    return F.when((n == 0) | (m == 0), close).when(close, last.bitwiseAND(F.get(F.array(*[F.lit(1 << d) for d in range(2 * edits + 1)]), m - n + edits)) != 0).otherwise(False)


def keeps_segments(a: Column, b: Column, edits: int, parts: int = 8) -> Column:
    """Whether b holds, near their place, as many of a's ``parts`` segments as lines at most ``edits`` apart must.

    An edit harms one segment at most and moves those behind it by one character at most.
    """
    parts += edits
    size = F.floor(F.char_length(a) / parts).cast("int")

    def held(i: int) -> Column:
        start = F.greatest(F.lit(1), size * i + 1 - edits)
        return F.instr(b.substr(start, size + 2 * edits), a.substr(size * i + 1, size)) > 0

    return reduce(lambda x, y: x + y, [held(i).cast("int") for i in range(parts)]) >= parts - edits


def distinct_lines(said: DataFrame, shortest: int) -> DataFrame:
    """id, parent, text, mark (0, as marks are for crowds only): each different line of ``shortest`` characters up, once. Equal ones meet before the shuffle.

    Ids are 64-bit hashes of lines. They only lead to candidates, so lines that share one are still told apart.
    """
    lines = said.where(F.char_length("line") >= shortest).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return lines.select(F.xxhash64("line").alias("id"), F.lit(0).cast("long").alias("parent"), F.col("line").alias("text"), F.lit(0).alias("mark"))


def _candidates(lines: DataFrame, edits: int, crowded: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ids of ``lines`` that share a key, through the refined keys where a key is crowded, and there have near marks."""
    hot = index_keys(lines, edits).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key")
    hot = scratch.put(hot, "crowded")
    met = _met(index_keys(lines, edits), probe_keys(lines, edits), edits, hot)
    if not hot.isEmpty():
        def rest(rows: DataFrame) -> DataFrame:
            text = F.concat(F.substring("text", F.lit(1), F.col("start") - 1), F.substring(F.col("text"), F.col("start") + F.col("size"), F.char_length("text")))
            return rows.join(hot, "key", "left_semi").select("id", F.col("key").alias("parent"), text.alias("text"), mark_of(F.col("text")).alias("mark"))

        # A line stands for both sides: its rests are indexed where its own segment is hot, and probe there and elsewhere.
        own = scratch.put(rest(index_keys(lines, edits)), "hot-segments")
        moved = scratch.put(rest(probe_keys(lines, edits)), "hot-substrings")
        fine, seek = index_keys(own, edits), probe_keys(own, edits).unionByName(probe_keys(moved, edits)).unionByName(index_keys(moved, edits))
        met = met.unionByName(_met(fine, seek, edits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _met(cut: DataFrame, probes: DataFrame, edits: int, without: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of ids with an index key in common, or of which one probes for an index key of the other, and near marks."""
    cut, probes = cut.select("key", F.col("id").alias("a"), F.col("mark").alias("mark_a")), probes.select("key", F.col("id").alias("b"), F.col("mark").alias("mark_b"))
    if without is not None:
        cut, probes = cut.join(without, "key", "left_anti"), probes.join(without, "key", "left_anti")
    near = F.bit_count(F.col("mark_a").bitwiseXOR(F.col("mark_b"))) <= 2 * edits
    every = probes.unionByName(cut.select("key", F.col("a").alias("b"), F.col("mark_a").alias("mark_b")))
    return every.join(cut, "key").where((F.col("a") != F.col("b")) & near).select("a", "b")


def near_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, crowded: int = CROWDED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, n_near, dropped (positions in order, comma-joined).

    Lines are equal or at most ``edits`` single-character edits apart, and classes are what such links connect. The
    first line of a class, by doc_id and position, stays; all others are dropped, and n_near counts those that differ from
    the one that stays. Null and empty texts have no lines; null identifiers come last; rows that repeat are documents of their own, the
    first of which keeps its lines. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    said = lines_of(docs)
    lines = scratch.put(distinct_lines(said, shortest), "lines")
    pairs = scratch.put(_candidates(lines, edits, crowded, scratch), "pairs")

    needed = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    texts = lines.join(needed, "id", "left_semi").select("id", F.col("text").alias("line")).withColumn("number", F.monotonically_increasing_id())
    texts = scratch.put(texts, "texts")
    scratch.drop("lines")
    sides = [texts.select(F.col("id").alias(s), F.col("line").alias(f"line_{s}"), F.col("number").alias(f"number_{s}")) for s in ("a", "b")]
    checked = pairs.join(sides[0], "a").join(sides[1], "b")
    sides = F.col("line_a"), F.col("line_b")
    checked = checked.where(F.when(keeps_segments(*sides, edits), within(*sides, edits)).otherwise(False))
    links = scratch.put(checked.select(F.col("number_a").alias("a"), F.col("number_b").alias("b")), "links")
    roots = connected(links, scratch, "lines")
    numbered = texts.select(line_key(F.col("line")).alias("id"), F.col("number").alias("node"))
    classes = roots.join(numbered, "node").select("id", "root")

    # The only scan whose numbers are used: another one may split files, and number documents, otherwise.
    every = scratch.put(rows_of(docs).select("doc", "doc_id", "at", line_key(F.col("line")).alias("id")), "light")
    light = every.where("at >= 0")
    grouped = light.join(classes, "id", "left").withColumn("class", F.struct(F.col("root"), F.when(F.col("root").isNull(), F.col("id")).alias("own")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "at")
    first = grouped.groupBy("class").agg(F.min(F.struct(place.alias("place"), "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only classes of more than one line drop any; single lines need no second look.
    marked = grouped.join(first.drop("n"), "class").where(place != F.col("first.place")).select("doc", "at", (F.col("id") != F.col("first.id")).alias("near"))
    dropped = marked.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_dropped"), F.sum(F.col("near").cast("long")).alias("n_near"),
        F.concat_ws(",", F.sort_array(F.collect_list("at")).cast("array<string>")).alias("dropped"))
    sizes = light.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"))
    rows = every.where("at = -1").select("doc", "doc_id")
    return scratch.keep(rows.join(sizes, "doc", "left").join(dropped, "doc", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_dropped", "n_near")],
        F.coalesce("dropped", F.lit("")).alias("dropped")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_lines(table(spark, folder, "documents"))
