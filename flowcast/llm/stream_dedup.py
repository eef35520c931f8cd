"""Exact duplicates over a stream of documents, with keyed state on disk that never expires.

Arrivals (digest, length, identifier, content locator; no text) are landed as files and read as a stream. The
streaming aggregation keeps, per digest, how many rows arrived and which of them stays, together with the stable
identifier and the place of its content. The state lives in RocksDB under a checkpoint, so a later run over new
arrivals goes on where the last one stopped. Whatever hit an existing digest is then compared by its full bytes;
texts that only share a digest are told apart by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm.common import Scratch

BLANKS = r"[\x20\x09-\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many partitions hold little state
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def land_arrivals(docs: DataFrame, path: str, digest=sha256, locator: Column | None = None, mode: str = "error") -> None:
    """One light row per document: what the state needs, without the text."""
    locator = F.lit(None).cast("string") if locator is None else locator
    (docs.select(
        F.col("doc_id"),
        digest(normalised(F.col("text"))).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        locator.alias("locator"),
    ).withColumn("arrival", F.expr("uuid()"))
     .write.mode(mode).parquet(path))


def run_stream(spark: SparkSession, arrivals: str, state: str, groups: str, files_per_batch: int = 1000) -> None:
    """Take up every arrival not seen yet; each batch writes the digests it changed to its own folder."""
    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        first = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "arrival", "locator")
        changed = (
            spark.readStream.schema("doc_id long, digest string, chars long, locator string, arrival string")
            .option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
            .groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{groups}/take={number}")

        (changed.writeStream.outputMode("update").option("checkpointLocation", state)
         .trigger(availableNow=True).foreachBatch(write).start().awaitTermination())
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _by_text(docs: DataFrame, digest) -> DataFrame:
    """Groups of one digest made by the text itself (only for digests that several texts share)."""
    text = normalised(F.col("text"))
    return docs.select("doc_id", "text", "locator_of_row", digest(text).alias("digest"), text.alias("norm"))


def exact_duplicates(docs: DataFrame, digest=sha256, locator: Column | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator, keep_locator.

    ``locator`` says where a row's content is found (a file and row, for instance); both the row's own and that of the row
    that stays are returned.

    Texts are equal when identical without blanks; the longest original stays, then the smallest doc_id. Null text is
    the empty text, and all empty texts are one group. A null doc_id loses ties. Rows that repeat entirely are
    separate rows of one group, of which exactly one is kept. An empty table gives no rows. Other columns of ``docs``,
    whatever their names, are not touched.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact-dedup")
    place = F.lit(None) if locator is None else locator
    docs = docs.select("doc_id", "text", place.cast("string").alias("locator_of_row"))
    land_arrivals(docs, scratch.path("arrivals"), digest, F.col("locator_of_row"))
    arrivals = spark.read.parquet(scratch.path("arrivals"))
    run_stream(spark, scratch.path("arrivals"), scratch.path("state"), scratch.path("groups"), files_per_batch)
    schema = "digest string, first struct<shorter: long, no_id: boolean, doc_id: long, arrival: string, locator: string>, group_size long, batch int, take int"
    groups = spark.read.schema(schema).parquet(scratch.path("groups")) if not arrivals.isEmpty() else spark.createDataFrame([], schema)
    groups = groups.groupBy("digest").agg(F.max_by(F.struct("first", "group_size"), "batch").alias("g")).select("digest", "g.*")

    # Full bytes of every hit: more than one text under a digest means that the digest alone was not enough.
    hits = groups.where("group_size > 1").select("digest")
    texts = docs.select(digest(normalised(F.col("text"))).alias("digest"), normalised(F.col("text")).alias("norm"))
    variants = texts.join(hits, "digest", "left_semi").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"))
    mixed = scratch.put(variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "mixed")

    named = arrivals.join(groups, "digest").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("arrival") == F.col("first.arrival")).alias("kept"), F.col("digest"), "locator", F.col("first.locator").alias("keep_locator"),
    )
    if not mixed.isEmpty():
        same = _by_text(docs, digest).join(mixed, "digest", "left_semi").withColumn("arrival", F.expr("uuid()"))
        same = scratch.put(same.withColumn("chars", F.char_length(F.coalesce("text", F.lit("")))).drop("text"), "same")
        first = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "arrival", F.col("locator_of_row").alias("locator"))
        exact = same.groupBy("norm").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        exact = same.select("doc_id", "arrival", "digest", "norm", F.col("locator_of_row").alias("locator")).join(exact, "norm").select(
            "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("arrival") == F.col("first.arrival")).alias("kept"),
            "digest", "locator", F.col("first.locator").alias("keep_locator"))
        named = named.join(mixed, "digest", "left_anti").select(exact.columns).unionByName(exact)
    return scratch.keep(named.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "locator", "keep_locator"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    found = exact_duplicates(docs, locator=place)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
