"""Token ids of a corpus in files of Simple-8b blocks, in ascending doc_id order.

A file set is a folder of Parquet containers, one sub-folder per range of doc_id. A row is a chunk of whole documents:

    range, first   the range, and how many ids the range holds before the chunk
    n_ids          ids in the chunk
    doc_ids, lengths   the documents in order, and how many ids each has
    offsets        the first word of each block of ids, and the number of words
    words          the 64-bit words, little-endian

so any block of any chunk can be decoded by itself, and ranges follow one another in doc_id order. Containers are written
by Spark's own writer, so a lost executor leaves no half-written file and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowcast.llm import simple8b, tokens
from flowcast.llm.common import Scratch, slices, table

CHUNK = 200_000
_FILE = "range int, first long, n_ids long, doc_ids array<long>, lengths array<long>, offsets array<int>, words binary"


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text and the number of the doc_id range; null identifiers come first."""
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(100 * ranges))).first()[0] or []
    cuts = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    number = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda cut: cut < F.col("doc_id"))))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), number.cast("int").alias("range"))


def _coded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(path), np.uint32(end_id).astype("<u4").tobytes()
        at, first = None, 0
        held: list[tuple[int | None, bytes]] = []

        def chunk() -> pa.RecordBatch:
            nonlocal first
            ids = np.frombuffer(b"".join(own for _, own in held), "<u4")
            words, offsets = simple8b.encode(ids)
            row = {
                "range": at, "first": first, "n_ids": len(ids), "doc_ids": [doc_id for doc_id, _ in held],
                "lengths": [len(own) // 4 for _, own in held], "offsets": offsets.tolist(), "words": words.astype("<u8").tobytes(),
            }
            first += len(ids)
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([
            ("range", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("words", pa.binary())])
        size = 0
        for batch in batches:
            for part in slices(batch):
                rows = zip(part["range"].to_pylist(), part["doc_id"].to_pylist(), encode.encode(part["text"].to_pylist()), strict=True)
                for number, doc_id, ids in rows:
                    if held and (number != at or size >= 4 * CHUNK):
                        yield chunk()
                        size = 0
                    if number != at:
                        at, first = number, 0
                    held.append((doc_id, ids + end))
                    size += len(ids) + 4
        if held:
            yield chunk()
    return run


def write_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, ranges: int | None = None) -> None:
    """Write the ids of every whole text (null is empty), each document's followed by ``end_id``, to folder ``path``."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _ranged(docs, ranges).repartition(ranges, "range").sortWithinPartitions("range", "doc_id")
    coded = ordered.mapInArrow(_coded(vocabulary or tokens.vocabulary(), end_id), _FILE)
    coded.write.partitionBy("range").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"]), row["n_ids"]).astype("<u4")
            ends = np.cumsum(row["lengths"], dtype=np.int64)
            starts, raw = ends - row["lengths"], memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["range"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"]),
                pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64()),
            ], names=["range", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``start`` counts over the whole corpus: the ranges' totals, one row each, are summed up in order.
    """
    files = spark.read.schema(_FILE).parquet(path)
    totals = files.groupBy("range").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    bases = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = files.mapInArrow(_decoded, "range int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "range").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32 of each row.

    Null, empty and blank texts hold the end id alone. Null identifiers come first; rows that share an identifier stand
    together in any order. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    write_files(docs, scratch.path("files"), vocabulary, end_id)
    return scratch.keep(read_files(docs.sparkSession, scratch.path("files")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"))
