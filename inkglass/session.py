"""Session and table access shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", app: str = "inkglass") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "inkglass-tables"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named Parquet table, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_SWEPT: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables of this application, removed when it ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "inkglass-tables")
    folder = f"{named.rstrip('/')}/tables-{sc.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, spark, folder)
    return folder


def _sweep(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the engine has ended before
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset in a local session a temporary folder is used; on a
    cluster it is an error.
    What is read does not depend on executors, is compressed, and its plan is
    one scan, however it was made.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Keep a result that several branches read, spilling to disk; a lost
    executor only means that its part is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
