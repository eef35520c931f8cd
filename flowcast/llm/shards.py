"""Equal shards by range partitioning with sampled splitters.

Records are ordered by a hash of their text, so equal texts stand together, and by doc_id within it. Splitters are
weighted quantiles of a sample in which a record's chance grows with its size. A key that fills whole quantiles gets a
range of its own, and ranges that come out overfull are subdivided by splitters on doc_id. Exact sizes of all ranges then
give every record its byte position in the order, and the position gives the shard; a group of equal texts that a shard
border would cut moves to one side as long as that shifts no more than a hundredth of a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowcast.llm.common import Scratch, table

SHARDS = 40
OVERHEAD = 16
SAMPLED = 40  # sampled keys per range
LEAN = 100  # a group may move across a border if it is smaller than a shard divided by this


def _unit(*columns: Column | str) -> Column:
    """A number in 0..1 that depends on the columns alone."""
    return (F.xxhash64(*columns).cast("double") / F.lit(2.0**64)) + F.lit(0.5)


def _below(bounds: list[int], key: Column) -> Column:
    """How many of the bounds (a few hundred) lie below the key."""
    array = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    return F.size(F.filter(array, lambda bound: bound < key))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the ordering key of each row; a null text has no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"))


def byte_shards(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards hold nearly the same number of bytes, whatever the sizes: they differ by a hundredth of a shard and one
    record at most on either border. Slots run from 0 without gaps. Null and empty texts weigh their overhead alone;
    repeated rows and null identifiers are rows like others. With fewer rows than shards some shards stay empty; an empty
    table gives no rows. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shards")
    # A number per row tells repeated rows apart; it is fixed once written.
    rows = scratch.put(measured(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return _named(rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")))
    ranges = shards * ranges_per_shard

    # Size-weighted sample: about SAMPLED keys per range, more of large records than of small ones.
    chance = F.col("size") * F.lit(float(SAMPLED * ranges)) / F.lit(float(total))
    sample = rows.where(_unit("row", F.lit(11)) < chance)
    quantiles = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = sample.agg(F.percentile_approx("key", quantiles, F.lit(20 * ranges))).first()[0] or []
    bounds = sorted(set(cuts))
    heavy = [b for b in bounds if cuts.count(b) > 1]
    alone = F.col("key").isin(*heavy) if heavy else F.lit(False)
    ranged = rows.withColumn("range", 2 * _below(bounds, F.col("key")) + alone.cast("int"))

    # Overfull ranges: splitters on doc_id, as many as the range exceeds its share. At most one row per range.
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    parts = F.ceil(F.col("bytes") * ranges / F.lit(total)).cast("int")
    overfull = sizes.where(F.col("bytes") * ranges > 2 * total).select("range", parts.alias("parts"))
    shares = [i / 64 for i in range(1, 64)]
    splits = ranged.join(F.broadcast(overfull), "range").groupBy("range").agg(
        F.array_distinct(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(2000))).alias("cuts"))
    # Ranges are at most twice the number of bounds plus one, so this side is small whatever the data.
    cut = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("doc_id"))), F.lit(0))
    ranged = ranged.join(F.broadcast(splits), "range", "left").withColumn("part", F.when(F.col("cuts").isNull(), 0).otherwise(cut)).drop("cuts")
    ranged = scratch.put(ranged, "ranged")

    # Exact position of every record: what all ranges before hold, plus what stands before it in its own.
    held = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range and part
    base = held.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("range", "part").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "part", "key")
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0))).withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min("inside").over(group))
    placed = placed.join(F.broadcast(base), ["range", "part"])
    per_shard = total / shards
    middle = F.col("base") + F.when(F.col("group_bytes") * LEAN < per_shard, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("inside") + F.col("size") / 2)
    placed = scratch.put(placed.select(
        "doc_id", "size", "text_crc32", "key", "row", "range", "part",
        F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int").alias("shard")), "placed")

    # Slots: rows of the same shard in earlier ranges, plus the rank in the own one.
    counts = placed.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "range", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "range", "part").orderBy("key", "doc_id", "row"))
    numbered = placed.withColumn("rank", rank).join(F.broadcast(first), ["shard", "range", "part"])
    return scratch.keep(_named(numbered.withColumn("slot", F.col("first") + F.col("rank") - 1)))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return byte_shards(table(spark, folder, "documents"))
