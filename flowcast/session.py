"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowcast", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; partition counts are left to the cluster's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A checkpoint's files go with the last reference to it.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Building large column expressions is several times faster without call-site capture.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Times are UTC everywhere; a session with another zone would shift zone-less input."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a session that runs in one process gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="flowcast-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def located(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    target, system = located(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = located(spark, path)
    return system.exists(target)


class Staging:
    """Tables of one step in the shared folder, deleted when the step is done.

    ``put`` writes rows once and reads them back: made once, and of a size that Spark knows when it plans the next step.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_folder(spark)}/step-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *failure) -> None:
        remove(self.spark, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def staged(df: DataFrame, stage: Staging | None = None) -> DataFrame:
    """The same rows from a written table: made once, and of a size that Spark knows when it plans the next step.

    ``stage`` owns the table and deletes it; without one it lives as long as the session's process.
    """
    if stage is not None:
        return stage.put(df)
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = located(df.sparkSession, path)
    system.deleteOnExit(target)
    return df.sparkSession.read.parquet(path)
