"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings of a stand-alone run; a cluster's own settings win because they come with its session.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests, benches and small runs."""
    builder = SparkSession.builder.master(master).appName("quillon")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its scan has fewer tasks than that, for costly expressions on a table in one file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for functions that run in Python workers."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="quillon-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(path)
    context._quillon_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, in spark.checkpoint.dir or, where that is unset and all run on one machine, a temporary one; deleted when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex[:12]}-{name}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch() folder and read back, for what is read more than once: no memory stays taken, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
