"""Text indexes of folders, made from the catalog by aggregation per folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_size
from ..operators.catalog import roll_up
from ..plans.planner import REVIEW

RULE = "─" * 32
ADVICE = (
    "These are EXTRA COPIES of files that are identical, byte for byte, to a file that was kept.\n"
    "Each numbered folder is one set of copies, named after the copy that was kept.\n"
    "Nothing has been deleted. Delete the copies you don't need, or move one to wherever you like."
)


def _folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _files(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " file").otherwise(" files"))


def file_lines(catalog: DataFrame) -> DataFrame:
    """(folder, name, line) of every file, numbered A to Z by the reader of the lines."""
    name, old = F.substring_index("path", "/", -1), F.substring_index("original_path", "/", -1)
    part = lambda lead, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c))
    came = F.when(old != name, part("\n   Old name: ", F.col("original_path"))).otherwise(F.concat(F.lit("\n   Came from: "), F.coalesce(F.nullif(_folder(F.col("original_path")), F.lit("")), F.lit("the top of your storage"))))
    inside = F.when(F.coalesce("preview", F.lit("")) != "", F.concat(F.lit('\n   Inside: "'), "preview", F.lit('"')))
    line = F.concat_ws("", name, F.concat(F.lit("\n   "), F.substring_index("date", " ", 1), F.lit(" · "), format_size(F.col("size")), F.lit(" · "), "description"), inside, part("\n   ⚠ ", F.col("note")), F.when(F.coalesce("original_path", F.lit("")) != "", came))
    return catalog.select(_folder(F.col("path")).alias("folder"), name.alias("name"), line.alias("line"), "note")


def folder_indexes(catalog: DataFrame, output: str = "Organized Files") -> DataFrame:
    """(folder, content) of the index of every folder: what is below it, its
    folders and its files.  Lists are sorted after their lines are made; a
    folder's list is as long as the folder, like the file it becomes."""
    sums = roll_up(catalog)
    subs = sums.where("folder <> ''").withColumn("parent", _folder(F.col("folder")))
    sub_line = F.concat(F.lit("  📁 "), F.substring_index("folder", "/", -1), F.lit("  ("), _files(F.col("files")), F.lit(", "), format_size(F.col("bytes")), F.lit(")"))
    below = subs.groupBy(F.col("parent").alias("folder")).agg(F.array_sort(F.collect_list(F.struct(F.lower("folder").alias("k"), sub_line.alias("line")))).alias("subs"))
    own = file_lines(catalog).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "line"))).alias("own"), F.max("note").alias("note"))
    rows = sums.join(below, "folder", "left").join(own, "folder", "left")
    where = F.concat(F.lit(f"{output} › "), F.replace(F.col("folder"), F.lit("/"), F.lit(" › ")))
    head = F.concat(F.lit("INDEX OF THIS FOLDER: "), F.substring_index("folder", "/", -1), F.lit("\nWhere: "), where, F.lit("\n"), _files(F.col("files")), F.lit(" · "), format_size(F.col("bytes")), F.lit("\n" + RULE))
    kept = F.concat(F.lit("The files in this folder are exact copies of:\n  "), F.regexp_replace("note", "^Identical copy of: ", ""), F.lit("\nThat copy was kept. You can delete these if you don't need them."))
    advice = F.when(F.col("folder") == REVIEW, F.lit(f"\n{ADVICE}\n{RULE}")).when(F.startswith("folder", F.lit(REVIEW + "/")), F.concat(F.lit("\n"), kept, F.lit("\n" + RULE)))
    folders = F.when(F.size("subs") > 0, F.concat(F.lit("\n\nFOLDERS IN HERE\n"), F.array_join(F.transform("subs", lambda x: x["line"]), "\n")))
    files = F.when(F.size("own") > 0, F.concat(F.lit("\n\nFILES IN HERE (A to Z)\n"), F.array_join(F.transform("own", lambda x, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), x["line"])), "\n")))
    return rows.where("folder <> ''").select("folder", F.concat_ws("", head, advice, folders, files).alias("content"))


def master_lines(catalog: DataFrame) -> DataFrame:
    """(folder, name, line): the lines of the index of everything, to be sorted by folder and name."""
    name = F.substring_index("path", "/", -1)
    old = F.substring_index("original_path", "/", -1)
    bits = F.array_compact(F.array(F.nullif(F.substring_index("date", " ", 1), F.lit("")), F.nullif(F.col("description"), F.lit("")), F.when(F.col("preview") != "", F.concat(F.lit('"'), F.left("preview", F.lit(80)), F.lit('"'))), F.when((F.col("original_path") != "") & (old != name), F.concat(F.lit("was "), old))))
    return catalog.select(_folder(F.col("path")).alias("folder"), name.alias("name"), F.concat(F.lit("• "), name, F.when(F.size(bits) > 0, F.concat(F.lit("  ("), F.array_join(bits, " · "), F.lit(")"))).otherwise("")).alias("line"))
