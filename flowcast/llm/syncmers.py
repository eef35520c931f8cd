"""Document fingerprints from closed syncmers.

A text is a sequence of tokens (words; letters of scripts without blanks stand alone). Of its K-token substrings those are
chosen whose smallest inner S-token substring, by hash, is the first or the last one. Whether a substring is chosen depends
on its own tokens alone, so an edit elsewhere never moves an anchor. The fingerprint of a text is its ANCHORS smallest
anchors with the token positions where they first stand. Two fingerprints are compared by the anchors that both texts share
at matching positions.

An anchor is one long: 31 bits of hash, 31 bits of position, one free bit. Everything runs in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowcast.llm.common import table

K, S = 4, 2  # tokens of an anchor and of its inner substrings; the choice below is written for K - S + 1 = 3 of them
ANCHORS = 64
SLACK = 16  # positions of shared anchors may differ from the usual shift by this many tokens, plus a quarter of the text
# A letter of a script that is written without blanks, or up to 16 other characters in a row.
TOKEN = r"([\x{2E80}-\x{D7FF}]|[^\s\x{2E80}-\x{D7FF}]{1,16})"
RANGE_ROWS, MAX_RANGES = 1_000, 10_000
_FIRST = -(2**63)


def _packed(digest: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(digest, 33), 32).bitwiseOR(F.shiftleft(position.cast("long"), 1))


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def _position(anchor: Column) -> Column:
    return F.shiftright(anchor.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 1)


def with_anchors(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of column ``text`` as an array of anchors, smallest first.

    A text of which nothing is chosen (fewer than K tokens, or little more) is one anchor; a null, empty or blank one has none. Repeated substrings count once.
    """
    t, h, g, a, d = (f"__{name}_{step}" for step in "thgad")
    step = rows.withColumn(t, F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(TOKEN), F.lit(1)))
    step = step.withColumn(h, F.transform(t, lambda token: F.xxhash64(token)))
    inner = F.transform(h, lambda x, i: F.shiftleft(x, 1).bitwiseXOR(F.get(F.col(h), i + 1)))
    step = step.withColumn(g, F.slice(inner, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))
    third = lambda i: F.get(F.col(g), i + 2)
    # The middle one being smaller than both edges is the only way to miss; beyond the last K-mer there is no third.
    chosen = F.transform(g, lambda x, i: F.when(F.get(F.col(g), i + 1) >= F.least(x, third(i)), F.when(third(i).isNotNull(), _packed(F.xxhash64(x, third(i)), i))))
    whole = F.array(_packed(F.xxhash64(F.concat_ws(" ", t)), F.lit(0)))
    step = step.withColumn(a, F.sort_array(chosen))
    first = F.filter(F.col(a), lambda x, i: x.isNotNull() & ~_hash(x).eqNullSafe(_hash(F.get(F.col(a), i - 1))))
    step = step.withColumn(d, F.slice(first, 1, ANCHORS))
    return step.withColumn(name, F.when((F.size(d) == 0) & (F.size(t) > 0), whole).otherwise(F.col(d))).drop(t, h, g, a, d)


def spelled(anchors: Column) -> Column:
    """The fingerprint as text: hash in eight hex digits and position of each anchor, comma-joined; nothing for no anchor."""
    return F.concat_ws(",", F.transform(anchors, lambda x: F.concat(F.lpad(F.lower(F.hex(_hash(x))), 8, "0"), F.lit("@"), _position(x).cast("string"))))


def with_likeness(rows: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """``rows`` with the likeness (0 to 1) of two fingerprints: 2J / (1 + J), J the share of the smallest anchors of both
    that both have at matching positions. Equal fingerprints give 1, also empty ones; no shared anchor gives 0."""
    s, u, o = (f"__{name}_{step}" for step in "suo")
    tagged = F.transform(F.col(other), lambda x: x.bitwiseOR(F.lit(1).cast("long")))
    step = rows.withColumn(s, F.sort_array(F.concat(F.col(one), tagged)))
    before = lambda i: F.get(F.col(s), i - 1)
    step = step.withColumn(u, F.slice(F.filter(F.col(s), lambda x, i: (i == 0) | (_hash(x) != _hash(before(i)))), 1, ANCHORS))
    last = _hash(F.element_at(F.col(u), -1))
    # A shared hash stands twice in a row; the tag tells which of the two comes from the other text.
    shift = F.transform(F.col(s), lambda x, i: F.when(
        (i > 0) & (_hash(x) == _hash(before(i))) & (_hash(x) <= last),
        (_position(x) - _position(before(i))) * F.when(x.bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1)))
    step = step.withColumn(o, F.sort_array(F.filter(shift, lambda x: x.isNotNull())))
    usual = F.get(F.col(o), F.floor(F.size(o) / 2).cast("int"))
    width = F.array_max(F.transform(F.col(s), lambda x: _position(x)))
    same = F.size(F.filter(F.col(o), lambda x: F.abs(x - usual) <= SLACK + width / 4))
    both = same + F.size(u)
    return step.withColumn(name, F.when(F.size(s) == 0, F.lit(1.0)).otherwise(2.0 * same / both)).drop(s, u, o)


def _range(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds lie at or above the key, as a balanced tree of comparisons."""
    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(len(bounds) - low)
        middle = (low + high) // 2
        return F.when(key > bounds[middle], part(middle + 1, high)).otherwise(part(low, middle))
    return part(0, len(bounds))


def with_next(docs: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """``docs`` (doc_id, order_hash and others) with next_<column>: the value of the following row by descending doc_id.

    Rows without doc_id come last, rows that share one go by ``order_hash``; the first row follows the last one. Rows are
    dealt out by ranges of doc_id with sampled bounds, an id that fills ranges by its hash; the first row of a range is also
    dealt to the range before, so that every row meets its follower in one exchange. The driver holds two numbers per range.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(_FIRST))
    keys = docs.select(key.alias("key"), "order_hash")
    n = keys.count()
    ranges = max(1, min(max_ranges, -(-n // range_rows)))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(1.0))
    cuts = keys.agg(F.percentile_approx("key", shares, F.lit(10 * ranges))).first()[0] or []
    bounds = sorted(set(cuts)) if ranges > 1 else []
    heavy = {b: cuts.count(b) for b in bounds if cuts.count(b) > 1}
    spread = F.lit(0)
    for value, times in heavy.items():
        unit = F.col("order_hash").cast("double") / F.lit(2.0**64) + F.lit(0.5)
        spread = F.when(F.col("key") == value, F.least(F.floor(unit * times), F.lit(times - 1)).cast("int")).otherwise(spread)
    alone = F.when(F.col("key").isin(*heavy), 0).otherwise(1) if heavy else F.lit(0)  # an id with ranges of its own stands before the rest of its range
    place = F.struct(_range(bounds, F.col("key")).alias("range"), alone.cast("int").alias("alone"), spread.alias("spread"))
    first = keys.withColumn("place", place).groupBy("place").agg(F.min(F.struct(F.bitwise_not("key").alias("down"), "order_hash")).alias("first")).orderBy("place").collect()
    follows = [(*r["place"], r["first"]["down"], r["first"]["order_hash"], *first[i - 1]["place"]) for i, r in enumerate(first)]
    named = "_range int, _alone int, _spread int, _down long, _hash long, _range0 int, _alone0 int, _spread0 int"
    seams = spark.createDataFrame(follows, named)  # at most max_ranges rows and their heavy ids
    placed = docs.withColumn("key", key).withColumn("place", place).withColumns({"_range": F.col("place.range"), "_alone": F.col("place.alone"), "_spread": F.col("place.spread")}).drop("place")
    placed = placed.join(F.broadcast(seams), ["_range", "_alone", "_spread"])
    leads = (F.bitwise_not("key") == F.col("_down")) & (F.col("order_hash") == F.col("_hash"))
    own = F.struct(F.col("_range").alias("r"), F.col("_alone").alias("a"), F.col("_spread").alias("s"), F.lit(False).alias("copy"))
    back = F.struct(F.col("_range0").alias("r"), F.col("_alone0").alias("a"), F.col("_spread0").alias("s"), F.lit(True).alias("copy"))
    dealt = placed.withColumn("_at", F.explode(F.when(leads, F.array(own, back)).otherwise(F.array(own)))).select(
        *docs.columns, "key", F.col("_at.r").alias("_r"), F.col("_at.a").alias("_a"), F.col("_at.s").alias("_s"), F.col("_at.copy").alias("_copy"))
    order = Window.partitionBy("_r", "_a", "_s").orderBy("_copy", F.col("key").desc(), F.col("doc_id").isNull(), "order_hash")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("NOT _copy").drop("key", "_r", "_a", "_s", "_copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the first half of the own one (the longer half, if they differ) and as many code points from the start
    of the next document as the other half has, or all of them. Null texts are empty; an empty text has an empty fingerprint,
    stays empty when edited and is like other empty ones. Rows with the same doc_id follow each other by a hash of their texts,
    rows without one come last; a table of one row follows itself. Long texts are read whole. An empty table gives no rows.
    Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("order_hash", F.xxhash64("text"))
    own = with_anchors(own, "text", "anchors")
    rows = with_next(own, ["text", "anchors"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))).drop("text", "next_text", "order_hash")
    rows = with_anchors(rows, "edited", "edited_anchors")
    rows = with_likeness(with_likeness(rows, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("anchors")).alias("fingerprint"),
                       spelled(F.col("edited_anchors")).alias("edited_fingerprint"), "near_edited", "near_next")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
