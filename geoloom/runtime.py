"""Code shipping, so that Python workers find the package where it is not installed, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for work on ``rows``: at least the session's parallelism. Given to ``repartition`` as a number, so that adaptive
    execution does not put small rows with much work into one task."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def dealt(df: DataFrame, rows_per_task: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into tasks of about ``rows_per_task`` rows where that asks for more tasks than the session runs at
    once, else as it is: what a task sorts or holds does not grow with the input then. The windows, groupings and joins
    by the same keys that follow keep the partitions. ``df`` should be cheap to count, as a table of files is."""
    spark = df.sparkSession
    tasks = tasks_for(spark, df.count(), rows_per_task)
    return df.repartition(tasks, *keys) if tasks > spark.sparkContext.defaultParallelism else df


def run_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``, as a URI that driver and executors can both reach.

    Where the setting is missing, a local session gets a temporary folder; on a cluster each executor would write to a
    disk of its own and rows would be lost, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='geoloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/geoloom-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below the application's."""
    return f"{run_dir(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, uri: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_run(spark: SparkSession) -> None:
    """Delete all intermediate tables that this application wrote. Results not yet written elsewhere go with them."""
    delete(spark, run_dir(spark))


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once, lineage ends here, and a lost executor
    costs no rows."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the folders of materialised tables that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_folder", None):
            delete(df.sparkSession, path)
