"""The catalog of organized files: kept as a table, searched, rolled up by folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field_escape, field_unescape

FIELDS = ("path", "original_path", "kind", "date", "size", "description", "preview", "note", "search_text", "run_id")
#: Results of a search.
LIMIT = 300


def load(spark: SparkSession, path: str) -> DataFrame:
    """The catalog in tab-separated lines: short lines are dropped, odd sizes 0, the last line of a path counts."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("seq")).where(F.size("f") >= len(FIELDS))
    rows = lines.select("seq", *[field_unescape(F.col("f")[i]).alias(n) for i, n in enumerate(FIELDS)]).withColumn("size", F.coalesce(F.expr("try_cast(size as bigint)"), F.lit(0).cast("long")))
    return last_of(rows, "seq")


def last_of(rows: DataFrame, seq: str) -> DataFrame:
    """The last row of each path, in any case of letters."""
    return rows.groupBy(F.lower("path").alias("_key")).agg(F.max_by(F.struct(*FIELDS), seq).alias("e")).select("e.*")


def save(catalog: DataFrame, path: str) -> None:
    catalog.select(F.concat_ws("\t", *[field_escape(F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in FIELDS]).alias("value")).write.mode("overwrite").text(path)


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    key = F.lower("path")
    keys = new.select(key.alias("_key")).distinct()
    return catalog.join(keys, F.lower(catalog["path"]) == keys["_key"], "left_anti").unionByName(new)


def without_run(catalog: DataFrame, run: str) -> DataFrame:
    """The catalog as if a run had never been."""
    return catalog.where(~F.col("run_id").eqNullSafe(F.lit(run)))


def remove(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    keys = paths.select(F.lower("path").alias("_key")).distinct()
    return catalog.join(keys, F.lower(catalog["path"]) == keys["_key"], "left_anti")


def prune(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file (column ``path``) is still there."""
    keys = files.select(F.col("path").alias("_path")).distinct()
    return catalog.join(keys, catalog["path"] == keys["_path"], "left_semi")


def untracked(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Files that the catalog does not have."""
    keys = catalog.select(F.lower("path").alias("_key")).distinct()
    return files.join(keys, F.lower(files["path"]) == keys["_key"], "left_anti")


def score(query: str, levels: list[tuple[Column, int]]) -> Column:
    """Sum over the query's words of the points of the first level that has the
    word; null if a word is in none, and for a blank query."""
    terms = query.lower().split()
    total = None
    for t in terms:
        points = F.lit(None).cast("int")
        for text, n in reversed(levels):
            points = F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(t)), n).otherwise(points)
        total = points if total is None else total + points
    return F.lit(None).cast("int") if total is None else total


def search(catalog: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Entries with every word of the query, best first, then newest, then by path."""
    name = F.substring_index("path", "/", -1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    about = F.concat_ws(" ", "description", "preview", "note")
    points = score(query, [(name, 10), (folder, 6), (about, 4), (F.col("search_text"), 2), (F.col("original_path"), 1)])
    return catalog.withColumn("score", points).where("score is not null").orderBy(F.desc("score"), F.desc("date"), "path").limit(limit)


def search_all(catalog: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """Ranked entries, then files that are in no catalog and have every word in their path."""
    ranked = search(catalog, query).select("path", "score", F.lit(1).alias("tier"))
    terms = query.lower().split()
    loose = untracked(catalog, files).select("path", F.lit(None).cast("int").alias("score"), F.lit(2).alias("tier"))
    for t in terms:
        loose = loose.where(F.contains(F.lower("path"), F.lit(t)))
    return ranked.unionByName(loose if terms else loose.limit(0))


def ancestors(path: Column) -> Column:
    """All folders above a path, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def roll_up(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """(folder, files, bytes) of every folder with all that is under it, by one
    aggregation with partial sums; the root, which every file is under, too."""
    each = files.select(F.explode(ancestors(F.col(path))).alias("folder"), F.col(size).alias("_s"))
    return each.groupBy("folder").agg(F.count("*").alias("files"), F.coalesce(F.sum("_s"), F.lit(0)).cast("long").alias("bytes"))


def counts_by_top_folder(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(F.substring_index(path, "/", 1).alias("folder")).agg(F.count("*").alias("files"))
