"""Spark session settings and the shared folder used to cut lineage."""

import os
import tempfile

from pyspark.sql import SparkSession

_RUN_FOLDERS = set()


def build_session(app_name="barsight", master=None, **conf):
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # very long texts make small batches
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.ui.enabled": "false",
        # call-site capture makes building large column lists several times slower
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Shared folder of the cluster; a temporary one only for a local test session."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="barsight-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def run_folder(spark):
    """This application's own subfolder of the shared folder; the file system removes it when the driver ends."""
    context = spark.sparkContext
    folder = os.path.join(shared_dir(spark), "sinks", context.applicationId)
    if folder not in _RUN_FOLDERS:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUN_FOLDERS.add(folder)
    return folder


def new_path(spark, name):
    """A fresh path in the run's folder for a sink."""
    return os.path.join(run_folder(spark), f"{name}-{os.urandom(6).hex()}")


def cut_lineage(df):
    """Write once to the shared folder and read back.

    Later steps re-read columns from files, so a lost executor costs no recomputation, and
    the row sizes are known when joins are planned.
    """
    spark = df.sparkSession
    path = new_path(spark, "lineage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
