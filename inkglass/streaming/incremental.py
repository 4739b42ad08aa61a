"""New files joined to what is known, batch after batch (an extension: the
reference re-runs by hand)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import upsert


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the files that appear below ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def maintain(stream: DataFrame, to_entries: Callable[[DataFrame], DataFrame], catalog: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch becomes entries that replace those of the same path.  A new
    version of the catalog is written beside the old and only then named as
    current, so a batch that runs again gives the same catalog."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = to_entries(batch)
        before = current(spark, catalog, number)
        (new if before is None else upsert(before, new)).write.mode("overwrite").parquet(f"{catalog}/v={number:012d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, catalog: str, before: int | None = None) -> DataFrame | None:
    """The last whole version of the catalog (before a batch), or None."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(catalog)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = sorted(n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{catalog}/{n}/_SUCCESS")) and (before is None or int(n[2:]) < before))
    return spark.read.parquet(f"{catalog}/{done[-1]}") if done else None
