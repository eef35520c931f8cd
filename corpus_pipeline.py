"""A corpus from raw documents to packed sequences.

Each stage works on everything its predecessor kept and is written before the next one reads it. A stage that drops rows
by number first stores its input with the numbers, as another scan may split files otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm import jaccard_join, packing, positional_index, stream_dedup, toxicity
from flowcast.llm.common import Scratch, numbered, scratch_removed, table, without_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine finds toxic go; the machine learns from the labelled ones outside its held-out fold."""
    column = "_toxicity"
    while column in docs.columns:
        column += "_"
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, column).where(F.col(column) < toxicity.THRESHOLD).drop(column)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks the longest stays, then the one with the smallest doc_id."""
    docs, row = numbered(docs, Scratch(spark, "exact-dedup-rows"))
    found = stream_dedup.exact_duplicates(docs, locator=F.col(row))
    return without_rows(docs, found.where(~F.col("kept")).select(F.col("locator").cast("long").alias("row")), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; documents without words all stay."""
    docs, row = numbered(docs, Scratch(spark, "near-duplicates-rows"))
    found = jaccard_join.near_duplicates(docs, F.col(row)).where("component IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = found.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = found.join(first, "component").where(F.col("row") != F.col("first.row"))
    return without_rows(docs, others.select("row"), row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    docs, row = numbered(docs, Scratch(spark, "decontamination-rows"))
    found = positional_index.contamination(docs, table(spark, sf_dir, "benchmark"), row=F.col(row))
    return without_rows(docs, found.where("contaminated").select("row"), row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
# Learned scores and sequence packing have no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. What a stage stores besides its rows is removed when it is done."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        with scratch_removed():
            docs = scratch.put(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            scratch.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
