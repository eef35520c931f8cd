"""Stored tables: partitioned Parquet with keyed rewrites, and the manifest of loads."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowcast.session import Staging, exists, located, remove


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or NULL while nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _rewrite(merged: DataFrame, path: str, partitions: Sequence[str]) -> None:
    # Rebalancing keeps one file per small partition and lets adaptive execution split a hot one.
    writer = merged.hint("rebalance", *partitions)
    writer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _merged(rows: DataFrame, old: DataFrame, keys: Sequence[str], touched: DataFrame, partitions: Sequence[str]) -> DataFrame:
    affected = old.join(touched, list(partitions), "left_semi")
    return affected.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert_table(rows: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str]) -> None:
    """Replace rows with the same key, insert the others.  A repeat run leaves the same table.

    Only the partitions that ``rows`` touches are read and rewritten: the list of touched partitions
    prunes the old table, and dynamic overwrite replaces just these directories when the job commits.
    The rows are staged, so they are made once, and their true size decides how they are joined; the
    staged copies go when the table is written.
    """
    spark = rows.sparkSession
    old = table_or_none(spark, path)
    if old is None:
        return _rewrite(rows, path, partitions)
    with Staging(spark) as stage:
        fresh = stage.put(rows)
        touched = stage.put(fresh.select(*partitions).distinct())
        _rewrite(_merged(fresh, old, keys, touched, partitions), path, partitions)


def dated_rows(spark: SparkSession, path: str, schema: StructType, column: str, dates: Iterable) -> DataFrame:
    """The rows of some dates of a table whose first partition column is ``column``.

    Only these dates' folders are listed and read, so the cost does not grow with the table's history.
    """
    folders = [f"{path}/{column}={date}" for date in sorted(set(dates))]
    there = [folder for folder in folders if exists(spark, folder)]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*there)


def upsert_dates(rows: DataFrame, path: str, keys: Sequence[str], column: str, by: Sequence[str]) -> None:
    """``upsert_table`` for a table partitioned by a date, then by ``by``: the old rows are found by the dates
    of the new ones alone, without a look at any other folder.  ``rows`` should be stored."""
    spark, partitions = rows.sparkSession, [column, *by]
    dates = [r[0] for r in rows.select(column).distinct().collect()]  # as many as the rows span
    old = dated_rows(spark, path, rows.schema, column, dates)
    with Staging(spark) as stage:
        touched = stage.put(rows.select(*partitions).distinct())
        _rewrite(_merged(rows, old, keys, touched, partitions), path, partitions)


# --- Entries that exist once -----------------------------------------------------------------

LEASE = 600.0  # seconds after which a claim without an entry counts as left behind


def _created(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it was there.  One of several callers creates it.

    The file system decides: an exclusive create of a local disk or of HDFS has one winner.  An object store needs
    conditional writes for the same.
    """
    target, system = located(spark, path)
    system.mkdirs(target.getParent())
    if system.getScheme() == "file":
        try:
            os.close(os.open(target.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            return False
    try:
        system.create(target, False).close()
        return True
    except Py4JJavaError:
        if system.exists(target):
            return False
        raise


def _claimed(spark: SparkSession, folder: str, lease: float) -> str | None:
    """The file of the claim on an entry if this call takes it.  A claim older than ``lease`` is passed over by
    creating the next one, which again has one winner."""
    turn = 0
    while not _created(spark, f"{folder}/{turn}"):
        target, system = located(spark, f"{folder}/{turn}")
        if system.exists(target) and time.time() - system.getFileStatus(target).getModificationTime() / 1000 < lease:
            return None
        turn += 1
    return f"{folder}/{turn}"


def put_once(spark: SparkSession, table: str, key: str, make: Callable[[], DataFrame], lease: float = LEASE) -> tuple[Row, bool]:
    """The one-row entry of ``key`` in ``table``, and whether this call made it.

    Of several calls at once, also from other sessions, one takes a claim file, runs ``make`` -- whatever must happen
    once, and the row to record -- and writes the row to a folder of its own, so writers never share a commit.  The
    others wait for that row.  If ``make`` fails, the claim is given back; if its maker died, the next caller takes over
    after ``lease`` seconds.  ``make`` must therefore be repeatable, and take less time than that.  Readers see the
    table's rows with a column ``entry``.
    """
    name = "e" + hashlib.sha256(key.encode()).hexdigest()
    folder = f"{table}/entry={name}"

    def known() -> Row | None:
        found = table_or_none(spark, folder) if exists(spark, folder) else None
        return None if found is None else found.first()

    while True:
        row = known()
        if row is not None:
            return row, False
        claim = _claimed(spark, f"{table}/_claims/{name}", lease)
        if claim is not None:
            row = known()  # recorded since the look above
            if row is not None:
                return row, False
            try:
                make().coalesce(1).write.mode("overwrite").parquet(folder)
            except BaseException:
                remove(spark, claim)
                raise
            return known(), True
        time.sleep(0.5)


# --- Loads -------------------------------------------------------------------------------------


def _row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row with its column names, in the order of the names, and with its NULLs."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return F.xxhash64(row), F.xxhash64(F.lit("second"), row)


def _fingerprint(names: Sequence[str], rows: int, xor: int, one, two) -> str:
    """Content fingerprint that depends on neither row nor column order: the column names, the row count, and
    exclusive-or and sums of two hashes per row."""
    listed = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return ":".join([listed, str(rows), str(xor), str(int(one)), str(int(two))])


def _publish(spark: SparkSession, incoming: str, flows_path: str, load_id: str) -> None:
    """Move the stored rows of a load into the table: one rename, so readers see all of its days or none.

    Rows of the same load that an earlier attempt left are replaced; they are the same.
    """
    target, system = located(spark, incoming)
    if not system.exists(target):
        return
    for folder in system.listStatus(target):
        source = folder.getPath()
        if not source.getName().startswith("traffic_source_id="):
            continue
        own = f"{flows_path}/{source.getName()}"
        system.mkdirs(located(spark, own)[0])
        remove(spark, f"{own}/load_id={load_id}")
        if not system.rename(source, located(spark, f"{own}/load_id={load_id}")[0]):
            raise OSError(f"could not move a load into {own}")


def load_flows(raw: DataFrame, source: str, flows_path: str, manifest_path: str, loaded_at, lease: float = LEASE) -> dict:
    """Load one raw table into ``flows_path`` and record it; a completed identical load is skipped.

    A repeated load would double every count.  The input is read once: its rows are parsed and stored beside the
    table while the fingerprint is taken, and move into the table only if no load of the same content is recorded.
    Of two identical loads at once one is kept (``put_once``).  Rows carry the load id, so a load that died half-way
    is replaced, not repeated.  Tables without rows are recorded too.
    """
    from flowcast.operators.normalize import parse_flows

    spark = raw.sparkSession
    one, two = _row_hashes(raw)
    hashes = ["_content_one", "_content_two"]
    tagged = raw.withColumns({hashes[0]: one, hashes[1]: two, "traffic_source_id": F.lit(source)})
    total = lambda name: F.sum(F.col(name).cast("decimal(38,0)"))  # noqa: E731  a decimal cannot overflow on any realistic row count
    seen = Observation()
    parsed = parse_flows(tagged, ["traffic_source_id", *hashes]).observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if(F.size("problems") == 0).alias("accepted"),
        F.bit_xor(hashes[0]).alias("xor"), total(hashes[0]).alias("one"), total(hashes[1]).alias("two"))
    flows = parsed.filter(F.size("problems") == 0).drop("problems", *hashes).withColumns(
        {"flow_date": F.to_date("observed_at"), "extra": F.to_json("extra")})
    incoming = f"{flows_path}/_incoming/{uuid.uuid4().hex}"
    try:
        flows.write.partitionBy("traffic_source_id", "flow_date").parquet(incoming)
        found = seen.get
        rows, accepted = found.get("total") or 0, found.get("accepted") or 0
        content = _fingerprint(raw.columns, rows, found.get("xor") or 0, found.get("one") or 0, found.get("two") or 0)
        load_id = hashlib.sha256(f"{source}|{content}".encode()).hexdigest()
        entry = {
            "traffic_source_id": source, "load_id": load_id, "content_hash": content, "total_rows": rows,
            "accepted_rows": accepted, "skipped_rows": rows - accepted, "status": "completed", "loaded_at": loaded_at,
        }

        def make() -> DataFrame:
            _publish(spark, incoming, flows_path, load_id)
            schema = "traffic_source_id string, load_id string, content_hash string, total_rows long, accepted_rows long, skipped_rows long, status string, loaded_at timestamp"
            return spark.createDataFrame([tuple(entry.values())], schema)

        row, new = put_once(spark, manifest_path, load_id, make, lease)
    finally:
        remove(spark, incoming)
    return {**row.asDict(), "duplicate": not new}


def register_model(spark: SparkSession, registry_path: str, name: str, version: str, schema_version: str, metrics: str, created_at) -> bool:
    """Insert a model version once; True if it was new.  Of several calls at once one is True."""
    schema = "name string, version string, feature_schema_version string, metrics string, created_at timestamp"
    make = lambda: spark.createDataFrame([(name, version, schema_version, metrics, created_at)], schema)
    return put_once(spark, registry_path, f"{name}\n{version}", make)[1]
