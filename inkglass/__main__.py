"""python -m inkglass ROOT [--dry-run | --undo | --refresh | --search WORDS]: organise a folder."""

from __future__ import annotations

import argparse
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import catalog
from .plans import journal, planner
from .session import local_session
from .sinks import indexes
from .sources import readers


def _replace(rows: DataFrame, table: str) -> None:
    """The table with new rows, which may have been read from it: written beside it and put in its place."""
    rows.write.mode("overwrite").parquet(table + ".new")
    shutil.rmtree(table, ignore_errors=True)
    Path(table + ".new").rename(table)


def _indexes(entries: DataFrame, name: str, output: str) -> None:
    """The index of every folder and the index of everything, line by line."""
    for r in indexes.folder_indexes(entries, name).toLocalIterator():
        Path(output, r.folder).mkdir(parents=True, exist_ok=True)
        Path(output, r.folder, readers.INDEX_NAME + r.folder.split("/")[-1] + ".txt").write_text(r.content, encoding="utf-8")
    with Path(output, journal.MASTER_NAME + ".txt").open("w", encoding="utf-8") as f:
        folder = None
        for r in indexes.master_lines(entries).orderBy(F.lower("folder"), F.lower("name")).toLocalIterator():
            if r.folder != folder:
                f.write(f"\n{r.folder}\n")
                folder = r.folder
            f.write(r.line + "\n")


def main() -> None:
    p = argparse.ArgumentParser(prog="inkglass")
    p.add_argument("root")
    p.add_argument("--output", default="Organized Files")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--undo", action="store_true")
    p.add_argument("--refresh", action="store_true", help="write the indexes anew")
    p.add_argument("--search")
    a = p.parse_args()
    output = str(Path(a.root, a.output))
    spark = local_session()
    table = str(Path(output, journal.DATA, "catalog"))
    if a.undo:
        run = journal.last_run(output)
        print(journal.undo_last(output))
        if run and Path(table).exists():
            _replace(catalog.without_run(spark.read.parquet(table), run), table)
            _indexes(spark.read.parquet(table), a.output, output)
        return
    if a.search:
        loose = readers.scan(spark, a.root, a.output).select(F.col("rel_path").alias("path")).where(~F.startswith("path", F.lit(a.output + "/")))
        catalog.search_all(spark.read.parquet(table), loose, a.search).show(50, False)
        return
    if a.refresh:
        _indexes(spark.read.parquet(table), a.output, output)
        return
    moves = planner.plan(readers.scan(spark, a.root, a.output)).persist()
    planner.counts(moves).show()
    catalog.counts_by_top_folder(moves, "target").orderBy("folder").show(50, False)
    if a.dry_run:
        return
    run, moved, failed = journal.apply(((r.rel_path, r.target) for r in moves.select("rel_path", "target").toLocalIterator()), a.root, output)
    left = spark.createDataFrame([(rel,) for rel, _ in failed], "rel_path string")
    entries = planner.catalog_rows(moves.join(left, "rel_path", "left_anti"), run)
    _replace(catalog.upsert(spark.read.parquet(table), entries) if Path(table).exists() else entries, table)
    _indexes(spark.read.parquet(table), a.output, output)
    print(f"moved {moved}, failed {len(failed)}, run {run}")
    print(moves.where(F.col("renamed")).count(), "renamed")


if __name__ == "__main__":
    main()
