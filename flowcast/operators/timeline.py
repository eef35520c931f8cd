"""Ordered operators over long timelines, cut into chunks.

A plain ``Window.partitionBy(source).orderBy(time)`` sorts a whole source in one task, so a
source that holds a third of all rows holds up the job.  The helpers below give the same answers
with bounded groups: rows move once, to their (source, chunk) group, and are ordered there.  Across
chunks go only a chunk's totals, which come back by a join for which the rows already lie right, or
its first and last few rows (its halo).

``by`` are the timeline columns, ``order`` is unique inside a timeline, and ``chunk`` is any
expression that never decreases along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WINDOWS = 1440


def time_chunk(time: Column, window_seconds: int, windows: int = CHUNK_WINDOWS) -> Column:
    """Chunk number of a window start: at most ``windows`` windows fall into one chunk."""
    return F.floor(F.unix_seconds(time) / F.lit(window_seconds * windows)).cast("bigint")


def _local(by: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*by, "_chunk").orderBy(*order)


def _dealt(df: DataFrame, by: Sequence[str], chunk: Column) -> DataFrame:
    """Every row in its chunk's group: the one exchange of the rows, which all that follows shares."""
    return df.withColumn("_chunk", chunk).repartition(*by, "_chunk")


def _back(rows: DataFrame, per_chunk: DataFrame, by: Sequence[str]) -> DataFrame:
    """The columns of ``per_chunk`` on every row of the chunk; a NULL names a timeline like any other value."""
    keys = [*by, "_chunk"]
    other = per_chunk.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return rows.join(other, same, "left").drop(*[f"_of_{key}" for key in keys])


def with_previous(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    fields: Sequence[str],
    depth: int,
    chunk: Column,
    name: str = "_previous",
    following: bool = False,
) -> DataFrame:
    """Add ``name``: structs of the up to ``depth`` rows just before each row, oldest first.

    With ``following`` the rows just after are taken, nearest first.

    Rows with ``depth`` neighbours inside their chunk are done where they lie.  Only the others -- at most
    ``depth`` at each end of a chunk, its halo -- are exchanged again: they meet in one group per timeline,
    where the last rows of the earlier chunks directly precede them.
    """
    payload = F.struct(*[F.col(f) for f in fields])
    local = _local(by, [F.col(order)])
    before, after = local.rowsBetween(-depth, -1), local.rowsBetween(1, depth)
    near_frame, far_frame = (after, before) if following else (before, after)
    placed = _dealt(df, by, chunk).withColumns(
        {"_near": F.collect_list(payload).over(near_frame), "_others": F.count(F.lit(1)).over(far_frame)}
    )
    interior = (F.size("_near") == depth) & (F.col("_others") == depth)
    seam = Window.partitionBy(*by).orderBy(order)
    seam_frame = seam.rowsBetween(1, depth) if following else seam.rowsBetween(-depth, -1)
    done = placed.filter(interior).withColumnRenamed("_near", name)
    far = F.collect_list(payload).over(seam_frame)
    outer = placed.filter(~interior).withColumn(name, F.when(F.size("_near") == depth, F.col("_near")).otherwise(far)).drop("_near")
    return done.unionByName(outer).drop("_chunk", "_others")


def with_carry(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    totals: dict[str, Column],
    following: bool = False,
    whole: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``_chunk``, the row's ``_position`` in it and, per entry of ``totals``, what the earlier chunks of the
    timeline add up to (NULL for the first one).

    ``totals`` are aggregates that add over chunks with themselves, named by ``sum:``/``min:``/``max:``
    prefixes, e.g. ``{"sum:offset": F.count(...)}``.  With ``following`` the later chunks are taken.
    ``whole`` gives aggregates of the complete timeline in the same way.
    """
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    whole = whole or {}
    dealt = _dealt(df, by, chunk)
    rows = dealt.withColumn("_position", F.row_number().over(_local(by, order)))
    if not totals and not whole:
        return rows
    everything = {**totals, **whole}
    group = Window.partitionBy(*by, "_chunk")
    sums = rows.withColumns({"_total_" + key.split(":")[1]: total.over(group) for key, total in everything.items()})
    # Reading every column keeps this side on the very exchange of the rows; with fewer columns it would be made anew.
    read = [F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    same = F.hash(*read) >= -(2**31)
    sums = sums.filter((F.col("_position") == 1) & same).select(*by, "_chunk", *["_total_" + key.split(":")[1] for key in everything])
    across = Window.partitionBy(*by).orderBy("_chunk")
    unbounded = Window.unboundedFollowing if following else Window.unboundedPreceding
    frame = across.rowsBetween(1, unbounded) if following else across.rowsBetween(unbounded, -1)
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = []
    for entries, span in ((totals, frame), (whole, every)):
        for key in entries:
            how, name = key.split(":")
            carried.append(combine[how]("_total_" + name).over(span).alias(name))
    return _back(rows, sums.select(*by, "_chunk", *carried), by)


def with_row_index(df: DataFrame, by: Sequence[str], order: str, chunk: Column, name: str = "row_index", total: str | None = None) -> DataFrame:
    """Add the 0-based position along each timeline and, if named, the timeline's row count."""
    whole = {f"sum:{total}": F.count(F.lit(1))} if total else None
    carried = with_carry(df, by, [F.col(order)], chunk, {"sum:_offset": F.count(F.lit(1))}, whole=whole)
    index = F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_position") - 1
    return carried.withColumn(name, index.cast("bigint")).drop("_chunk", "_position", "_offset")


def explode_range(df: DataFrame, first: Column, last: Column, name: str, blocks: Sequence[int] = (1_000_000, 1_000)) -> DataFrame:
    """One row per whole number from ``first`` to ``last`` (none if it is smaller), in ``name``.

    A range is cut into blocks, those into smaller ones, and those into numbers, so no array is longer than a thousand
    for ranges up to a billion: a span of many years costs no more memory than one of a day.
    """
    df = df.withColumns({"_first": first.cast("bigint"), "_last": last.cast("bigint")}).filter("_first <= _last")
    for size in (*blocks, 1):
        unit = lambda c: F.floor(F.col(c) / size).cast("bigint")  # noqa: E731, B023 - used in this turn only
        df = df.withColumn("_unit", F.explode(F.sequence(unit("_first"), unit("_last"))))
        low = F.col("_unit") * size
        df = df.withColumns({"_first": F.greatest("_first", low), "_last": F.least("_last", low + (size - 1))})
    return df.withColumnRenamed("_first", name).drop("_last", "_unit")
