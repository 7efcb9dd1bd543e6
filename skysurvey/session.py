"""Session helpers: the settings this library relies on, and table access."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skysurvey", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE and Arrow.

    Sizes (shuffle partitions, scan splits, broadcast threshold) are left to the
    cluster's own configuration unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_skysurvey_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="skysurvey-")) / "skysurvey.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._skysurvey_shipped = True


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8_000_000) -> None:
    """Bound what a Python worker holds of long texts, by rows and bytes, unless the session has its own batch size."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(rows))
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if setting not in spark.conf.getAll:
        spark.conf.set(setting, str(size))


_LOCAL: dict[str, str] = {}


def local_folder(spark: SparkSession) -> str:
    """A folder of our own for a session in local mode; elsewhere executors would not see it."""
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='skysurvey-')}")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or local_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
