"""Scratch tables in the cluster's shared folder, and word rules the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.session import remove, shared_folder

# Runs of characters that are not ASCII separators; letters of both cases belong to a word.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same words once A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_owners: list[list[Scratch]] = []


@contextmanager
def scratch_removed() -> Iterator[None]:
    """Whatever scratch tables are made inside are removed at the end, the kept results of operators too."""
    _owners.append([])
    try:
        yield
    finally:
        for made in _owners.pop():
            remove(made.spark, made.root)


class Scratch:
    """Intermediate tables of one run, written to the shared folder so that a lost executor loses nothing.

    ``keep`` writes the result beside them and then removes everything else.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
        if _owners:
            _owners[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/work/{name}"

    def put(self, df: DataFrame, name: str, batch_rows: int | None = None, options: dict | None = None) -> DataFrame:
        """``batch_rows`` limits what passes to Python at once, for steps whose rows are large; ``options`` go to the writer."""
        return self._written(df, self.path(name), {"spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows} if batch_rows else {}, options or {})

    def _written(self, df: DataFrame, path: str, settings: dict, options: dict) -> DataFrame:
        """Shuffle files of the write go when it is done; Spark would leave them until the driver collects its garbage."""
        settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | settings
        before = {key: self.spark.conf.get(key, None) for key in settings}
        for key, value in settings.items():
            self.spark.conf.set(key, value)
        try:
            df.write.options(**options).parquet(path)
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name))

    def keep(self, df: DataFrame) -> DataFrame:
        result = self._written(df, f"{self.root}/result", {}, {})
        remove(self.spark, f"{self.root}/work")
        return result


def lower_ascii(word: Column) -> Column:
    """A-Z to lower case and nothing else; words without other letters take the fast function."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` written once with a number per row, and the name of that column.

    Spark sizes the splits of a scan by the cores alive when it plans it, so only a stored number is the same in two scans.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    return scratch.put(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", options={"compression": "zstd"}), name


def without_rows(docs: DataFrame, dropped: DataFrame, row: str | None = None) -> DataFrame:
    """``docs`` without the rows whose number is in ``dropped`` (row); ``row`` names the stored number, which drops out.

    Without ``row`` this scan numbers the rows, which is the numbering of ``dropped`` only if both scans are split alike.
    """
    if row is None:
        row = "_row"
        while row in docs.columns:
            row += "_"
        docs = docs.withColumn(row, F.monotonically_increasing_id())
    return docs.join(dropped.select(F.col("row").alias(row)), row, "left_anti").drop(row)


def _cuts(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield at, end - at
        at = end


def slices(batch: pa.RecordBatch, rows: int = 500, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows whose ``text`` has about ``size`` bytes (or one longer text), so that what
    is made from a part stays small however long texts are."""
    for at, n in _cuts(batch["text"], rows, size):
        yield batch.slice(at, n)


def parts_of(texts: pa.Array, rows: int = 500, size: int = 1_000_000) -> Iterator[pa.Array]:
    """The same parts of a column of texts."""
    for at, n in _cuts(texts, rows, size):
        yield texts.slice(at, n)


def release_memory() -> None:
    """Give what a finished task no longer uses back to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there in glibc only
    if trim:
        trim(0)
