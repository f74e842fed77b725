"""Session helpers: a local builder, table reading, shared work folders and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of an Arrow batch that goes to a Python worker: rows of long texts make small batches.
ARROW_BYTES = 8 << 20
#: Bytes of files up to which an input's rows are dealt to all cores by a shuffle.
SMALL_INPUT = 128 << 20


def local_session(cores: int | str = "*", app: str = "millrace", **conf: str) -> SparkSession:
    """A session on this machine, with settings fit for tests and the bench."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt to all cores: a file of one row group is read by one task, however small it is cut. Large inputs have many."""
    spark = df.sparkSession
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_INPUT
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers import it wherever they run; bound their batches."""
    sc = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")
    if getattr(sc, "_millrace_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, here)))
    sc.addPyFile(archive)
    sc._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one where it names none and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{LOCAL_CHECKPOINTS}"
        os.makedirs(LOCAL_CHECKPOINTS, exist_ok=True)
    return base.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has written in the shared folder. Results that were not written elsewhere go with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
