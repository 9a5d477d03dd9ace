"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where the session names none and runs in one process (local tests) a
    temporary one is set; on a cluster that would be a folder of each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isEmpty():
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-"))
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
    return option.get()


def is_local(spark: SparkSession) -> bool:
    """Whether the session runs in one process."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def cut(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written to the shared folder as a table and read back.

    The plan behind it runs once, later reads prune columns, and the loss of an
    executor costs nothing. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*keys) if keys else df).write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:
        pass


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors of a cluster."""
    import os
    import shutil

    sc = spark.sparkContext
    if is_local(spark) or getattr(sc, "_quernstone", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "quernstone"), "zip", root, "quernstone")
    sc.addPyFile(made)
    sc._quernstone = True
