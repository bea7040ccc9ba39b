"""Session helpers: local sessions for tests, shipping of this package to executors, table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per context, so that Python workers import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._quarry_shipped = True


#: Rows and bytes of an Arrow batch; with long texts the default of 10,000 rows takes too much memory in a worker and its executor.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bound Arrow batches, unless the session already asks for smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.match(r"(\d+)b?$", str(spark.conf.get(key)))
        if not now or int(now[1]) == 0 or int(now[1]) > most:
            spark.conf.set(key, str(most))


#: Rows of a task of spread().
SPREAD_ROWS = 20_000


def spread(rows: DataFrame, *by: str, most: int = SPREAD_ROWS) -> DataFrame:
    """rows of a table, dealt out by hash of the columns by, most or fewer to a task on average.

    For work that takes far longer than reading, or makes much more than it reads: a table of few bytes is else read in one task.
    """
    spark = rows.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least, -(-rows.count() // most)), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_quarry_scratch", None) or "file://" + tempfile.mkdtemp(prefix="quarry-scratch-")
        spark.sparkContext._quarry_scratch = found
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as Parquet in the shared folder, read back: for what is read more than once and takes far longer to make than to read."""
    path = f"{shared_folder(rows.sparkSession)}/quarry/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: For writes into many folders: tasks move their files to where they stay, at once, instead of the driver, one by one, at the end.
#: A write that fails then leaves files behind, without _SUCCESS.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
