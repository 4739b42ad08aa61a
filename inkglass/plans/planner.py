"""Where each file should go and what it should be called.

Files are read once: their facts are cut off from how they were made before
names are claimed, which reads them again and again.  Duplicates are settled before contents are read; names that would clash get
numbers within their folder; extra copies go to numbered review folders.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, describe, kinds, names, topics
from ..functions.text import format_duration, preview
from ..operators import duplicates
from ..session import cut
from ..sources import readers

REVIEW = "Duplicates - Review"
# Folders of documents without a topic, and of other kinds.
DOCUMENT_FOLDERS = {"PDF": "PDFs", "WORD": "Word Documents", "TEXT": "Notes & Text Files", "SPREADSHEET": "Spreadsheets", "PRESENTATION": "Presentations", "EMAIL": "Saved Emails", "WEB_PAGE": "Saved Web Pages"}
FOLDERS = {"EBOOK": "eBooks", "CONTACT": "Contacts & Calendar", "CALENDAR": "Contacts & Calendar", "ARCHIVE": "Zip Files", "APP_INSTALLER": "App Installers"}
DATED = {"SCREENSHOT": "Screenshots", "VIDEO": "Videos", "VOICE_RECORDING": "Voice Recordings"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def folder_for() -> Column:
    """From columns kind, topic, author, when (the best date) and rel_path."""
    kind, topic, when = F.col("kind"), F.col("topic"), F.col("when")
    year, ext = F.year(when).cast("string"), F.upper(names.extension(F.col("rel_path")))
    artist = F.nullif(names.sanitize(F.col("author"), 60), F.lit(""))
    return (
        F.when((kind == "PHOTO") & topic.isNotNull(), F.concat(F.lit("Documents/"), topic))
        .when(kind == "PHOTO", F.concat_ws("/", F.lit("Photos"), year, dates.month_folder(when)))
        .when(kind.isin(*DATED), F.concat_ws("/", F.try_element_at(_map(DATED), kind), year))
        .when(kind == "MUSIC", F.concat_ws("/", F.lit("Music"), artist))
        .when(kind.isin(*FOLDERS), F.try_element_at(_map(FOLDERS), kind))
        .when(kind.isin(*DOCUMENT_FOLDERS), F.concat(F.lit("Documents/"), F.coalesce(topic, F.try_element_at(_map(DOCUMENT_FOLDERS), kind))))
        .otherwise(F.when(ext == "", "Other Files/No file type").otherwise(F.concat(F.lit("Other Files/"), ext, F.lit(" files"))))
    )


def built_name() -> Column:
    """The clear name a file's facts give, or null where they give none."""
    kind, when, label = F.col("kind"), F.col("when"), F.col("doc_label")
    day, minute = names.day(when), names.day_and_time(when)
    title = F.nullif(names.sanitize(F.col("title"), 60), F.lit(""))
    dash = lambda c: F.coalesce(F.concat(F.lit(" - "), c), F.lit(""))
    things = F.nullif(F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 2), " & "), F.lit(""))
    length = F.coalesce(F.concat(F.lit(" ("), format_duration(F.col("duration_s")), F.lit(")")), F.lit(""))
    dated = F.concat(F.lit(" ("), day, F.lit(")"))
    lead = (
        F.when(kind == "EMAIL", F.concat(F.lit("Email"), dash(title)))
        .when(kind == "WEB_PAGE", F.concat(F.lit("Web page"), dash(title)))
        .when(label.isNotNull() & title.isNotNull() & ~F.contains(F.lower(title), F.lower(label)), F.concat(label, F.lit(" - "), title))
        .otherwise(F.coalesce(title, label, F.when(kind == "PHOTO", "Scanned document").otherwise(kinds.label_of(kind))))
    )
    return (
        F.when((kind == "PHOTO") & F.col("topic").isNull(), F.concat(minute, F.lit(" "), F.coalesce(title, things, F.lit("Photo")), dash(F.col("place"))))
        .when(kind == "SCREENSHOT", F.concat(minute, F.lit(" Screenshot"), dash(title)))
        .when(kind == "VIDEO", F.concat(minute, F.lit(" "), F.coalesce(F.concat(F.lit("Video of "), things), F.lit("Video")), dash(F.col("place")), length))
        .when(kind == "VOICE_RECORDING", F.concat(minute, F.lit(" "), F.coalesce(title, F.lit("Voice recording")), length))
        .when(kind == "MUSIC", F.coalesce(F.concat(F.col("author"), F.lit(" - "), title), title))
        .when(kind == "EBOOK", F.concat(title, dash(F.col("author"))))
        .when(kind == "CONTACT", F.when(F.endswith(title, F.lit("contacts")), F.concat(title, dated)).otherwise(F.concat(F.lit("Contact - "), title)))
        .when(kind == "CALENDAR", F.concat(F.lit("Event - "), title, dated))
        .when(kind == "APP_INSTALLER", F.concat(F.lit("App installer - "), title))
        .when(kind == "ARCHIVE", F.concat(F.lit("Zip - "), F.coalesce(title, F.lit("files")), dated))
        .when(kind != "OTHER", F.concat(lead, dated))
    )


NUMBERED = r" \(\d+\)(\.[^.]*)?$"


def unique_names(rows: DataFrame, folder: str, name: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``claimed``: the name, or "name (2).ext" and so on where an
    earlier row of the folder, or a name in ``taken``, has it in any case.

    Equal names of a folder are numbered by a window.  Only where a name such as
    "name (2).ext" is there already can a number clash, too; such stems (the
    names without number and extension) are settled one by one.
    """
    stem = F.lower(F.regexp_replace(name, r"( \(\d+\))*(\.[^.]*)?$", ""))
    keyed = rows.withColumn("_id", F.xxhash64(*order, folder, name))
    place = [F.lower(folder).alias("_folder"), stem.alias("_stem"), F.col(name).alias("_name")]
    ask = keyed.select(*place, F.lit(1).alias("_new"), F.struct(*order).alias("_rank"), "_id")
    if taken is not None:
        old = taken.select(*place, F.lit(0).alias("_new"), F.lit(None).cast(ask.schema["_rank"].dataType).alias("_rank"), F.lit(0).cast("long").alias("_id"))
        ask = ask.unionByName(old)
    same = Window.partitionBy("_folder", "_stem", F.lower("_name")).orderBy("_new", "_rank")
    ranked = ask.withColumn("_n", F.row_number().over(same))
    clash = ranked.groupBy("_folder", "_stem").agg(F.max("_n").alias("_most"), F.max(F.col("_name").rlike(NUMBERED)).alias("_numbered"))
    hard = clash.where("_most > 1 and _numbered").select("_folder", "_stem")
    number = F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))
    at = F.length("_name") - F.length(F.regexp_extract("_name", r"(?<=.)(\.[^.]*)$", 1))
    simple = ranked.join(hard, ["_folder", "_stem"], "left_anti").where("_new = 1").select("_id", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat(F.left("_name", at), number, F.expr("substring(_name, length(_name) - length(regexp_extract(_name, '(?<=.)([.][^.]*)$', 1)) + 1)"))).alias("claimed"))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out, tries = {n.lower() for n in pdf.loc[pdf["_new"] == 0, "_name"]}, [], {}
        for n, i in pdf[pdf["_new"] == 1].sort_values("_at")[["_name", "_id"]].itertuples(index=False):
            base, dot, ext = n.rpartition(".")
            base, ext = (base, dot + ext) if dot and base else (n, "")
            k, candidate = tries.get(n.lower(), 1), n
            while candidate.lower() in used:
                k += 1
                candidate = f"{base} ({k}){ext}"
            tries[n.lower()] = k
            used.add(candidate.lower())
            out.append((i, candidate))
        return pd.DataFrame(out, columns=["_id", "claimed"])

    in_order = Window.partitionBy("_folder", "_stem").orderBy("_new", "_rank")
    tangled = ranked.join(hard, ["_folder", "_stem"], "left_semi").withColumn("_at", F.row_number().over(in_order)).select("_folder", "_stem", "_name", "_new", "_at", "_id")
    settled = tangled.groupBy("_folder", "_stem").applyInPandas(go, "_id long, claimed string")
    return keyed.join(simple.unionByName(settled), "_id").drop("_id")


def plan(files: DataFrame, rename: bool = True, find_duplicates: bool = True, extra_facts: DataFrame | None = None) -> DataFrame:
    """(rel_path, target, renamed, duplicate_of, facts...) of every file that moves.

    ``files`` is a scan (see :func:`readers.scan`); ``extra_facts`` can give, by
    rel_path, what only other tools know: tags, place, duration_s, width, height, album.
    """
    rows = files.withColumns({"base": names.base_name(F.col("rel_path")), "reviewed": F.contains("rel_path", F.lit(f"/{REVIEW}/"))})
    fresh = rows.where("not organized")
    if find_duplicates:
        hashes = duplicates.file_hashes(rows, "rel_path", "content", "length")
        known = rows.drop("content").join(hashes.select("rel_path", "hash"), "rel_path")
        order = duplicates.keeper_order(F.col("base"), F.col("modificationTime"), F.col("rel_path"), F.col("organized"), F.col("reviewed"))
        copies = duplicates.extras(known, F.col("rel_path"), F.col("hash"), F.col("length"), order).withColumnRenamed("extra", "rel_path")
    else:
        copies = rows.select("rel_path", F.col("rel_path").alias("kept")).limit(0)
    copies = cut(copies)
    moved_copies = fresh.drop("content").join(copies, "rel_path")
    facts = readers.facts(fresh.join(copies, "rel_path", "left_anti"))
    for c, kind in (("tags", "array<string>"), ("place", "string"), ("duration_s", "bigint"), ("width", "int"), ("height", "int"), ("album", "string")):
        if extra_facts is None or c not in extra_facts.columns:
            facts = facts.withColumn(c, F.lit(None).cast(kind))
    if extra_facts is not None:
        facts = facts.join(extra_facts, "rel_path", "left")
    facts = topics.classify(facts)
    facts = facts.withColumn("_t", topics.by_kind(F.col("kind"), F.col("match"), F.col("text"), F.lit(None).cast("string"))).withColumns({"topic": F.col("_t.topic"), "doc_label": F.col("_t.doc_label")}).drop("_t", "match")
    facts = facts.withColumns({"when": F.coalesce("date", F.col("modificationTime").cast("timestamp_ntz")), "base": names.base_name(F.col("rel_path"))})
    facts = facts.withColumns({"folder": folder_for(), "built": names.sanitize(built_name())})
    new = F.when(F.lit(rename) & ~names.is_meaningful(F.col("base")) & (F.col("built") != "") & (F.lower("built") != F.lower("base")), F.col("built"))
    ext = names.extension(F.col("rel_path"))
    facts = facts.withColumns({"renamed": new.isNotNull(), "name": F.coalesce(F.concat(new, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))), F.substring_index("rel_path", "/", -1))})
    facts = cut(facts)
    there = rows.where("organized").select(F.regexp_replace("rel_path", "^[^/]*/|/[^/]*$", "").alias("folder"), F.substring_index("rel_path", "/", -1).alias("name"))
    named = unique_names(facts, "folder", "name", ["rel_path"], there)
    kept = cut(named.withColumns({"target": F.concat_ws("/", "folder", "claimed"), "duplicate_of": F.lit(None).cast("string")}).drop("claimed", "name", "built"))
    where = moved_copies.join(kept.select(F.col("rel_path").alias("kept"), F.col("target").alias("kept_target")), "kept", "left").withColumn("duplicate_of", F.coalesce("kept_target", "kept"))
    # numbers only rank the groups, one row each; the members are joined to them
    numbers = where.select("duplicate_of").distinct().withColumn("n", F.row_number().over(Window.orderBy("duplicate_of")))
    set_name = names.sanitize(F.concat(F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(" - "), names.base_name(F.col("duplicate_of"))), 80)
    placed = where.join(numbers, "duplicate_of").withColumns({"folder": F.concat_ws("/", F.lit(REVIEW), set_name), "name": F.substring_index("rel_path", "/", -1)})
    review = unique_names(placed, "folder", "name", ["rel_path"], there).withColumns({"target": F.concat_ws("/", "folder", "claimed"), "renamed": F.lit(False), "kind": kinds.kind_of(F.col("rel_path"))})
    return kept.unionByName(review.select("rel_path", "target", "renamed", "duplicate_of", "folder", "kind", "length", "modificationTime"), allowMissingColumns=True)


def counts(moves: DataFrame) -> DataFrame:
    """(moves, renamed, duplicates, wasted) of a plan."""
    copy = F.col("duplicate_of").isNotNull()
    return moves.agg(F.count("*").alias("moves"), F.count_if("renamed").alias("renamed"), F.count_if(copy).alias("duplicates"), F.coalesce(F.sum(F.when(copy, F.col("length"))), F.lit(0)).alias("wasted"))


def catalog_rows(moves: DataFrame, run_id: str) -> DataFrame:
    """Moves as entries of the catalog."""
    copy = F.col("duplicate_of").isNotNull()
    about = describe.describe({c: F.col(c) for c in ("kind", "doc_label", "pages", "duration_s", "width", "height", "author", "album", "tags", "place", "details")})
    search = F.regexp_replace(F.concat_ws(" ", "title", F.left("text", F.lit(1500)), F.array_join("tags", " "), "place", "author"), r"\s+", " ")
    return moves.select(
        F.col("target").alias("path"), F.col("rel_path").alias("original_path"), "kind", names.day_and_time(F.coalesce("when", F.col("modificationTime").cast("timestamp_ntz"))).alias("date"), F.col("length").alias("size"),
        F.when(copy, "Duplicate copy").otherwise(about).alias("description"), F.coalesce(F.when(~copy, preview(F.col("text"))), F.lit("")).alias("preview"),
        F.coalesce(F.concat(F.lit("Identical copy of: "), "duplicate_of"), F.lit("")).alias("note"), F.coalesce(search, F.lit("")).alias("search_text"), F.lit(run_id).alias("run_id"),
    )
