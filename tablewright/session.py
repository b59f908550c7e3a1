"""Session defaults, and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

SPREAD_ROWS = 500_000
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("tablewright")
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.files.openCostInBytes", "262144")  # spread small files too
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g"))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster; a temporary one only for a local master."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tablewright-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage in a form that outlives any executor, and pins what a rerun could
    otherwise change (sampled range bounds, generated ids).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tablewright-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows written once, dealt over all cores: files of one row group are read by a single task."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return written(df.repartition(tasks))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that functions sent there can be loaded."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        home = os.path.dirname(os.path.abspath(__file__))
        zipped = os.path.join(tempfile.mkdtemp(prefix="tablewright-"), "tablewright")
        context.addPyFile(shutil.make_archive(zipped, "zip", os.path.dirname(home), os.path.basename(home)))
