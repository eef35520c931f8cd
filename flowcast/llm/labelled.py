"""A bounded sample of labelled texts for fitting a classifier, and the fold rule of the label contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier's text, modulo ``folds``; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int) -> list[tuple[int, str, int]]:
    """Up to ``rows`` (doc_id, text, label) of the allowed documents, the same ones every time.

    ``rows`` bounds what reaches the driver. Labels that are null are left out; null texts count as empty.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
        .where(allowed).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    )
    # At most ``rows`` pairs of numbers, so this side may always be broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")), "_label")
    return sorted({r[0]: (r[0], r[1], r[2]) for r in found.collect()}.values())
