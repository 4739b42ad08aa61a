"""The core queries: name to (spark, folder) -> DataFrame, and SQL that must give the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, describe, detectors, kinds, names, text, titles, topics
from .functions.markup import parse_markup, to_markup
from .operators import catalog, documents, duplicates, pages, timestamps
from .plans import planner
from .session import cut, table
from .sinks import indexes, render

KEYWORD = "reading room"
SEARCH = "pdf notice"


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Files once each; repeated deliveries are equal in every column."""
    return table(spark, d, "file_facts", "file_id", *columns).dropDuplicates(["file_id"])


def p6_found(spark, d):
    return timestamps.to_instants(table(spark, d, "date_offers", "offer_id", "date_text", "device_id"), table(spark, d, "devices", "device_id", "tz_name"))


# ---- duplicates


def _copies(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows, F.col("doc_id"), F.sha2("text", 256), F.length("text").cast("long"), F.col("doc_id")


def dup_groups(spark, d):
    return duplicates.groups(*_copies(spark, d))


def dup_extras(spark, d):
    return duplicates.extras(*_copies(spark, d))


def dup_files(spark, d):
    """Files with equal titles: the copy kept by the clearness of its name, then age and depth."""
    rows = _files(spark, d, "rel_path", "base", "modified", "title").where("title <> ''")
    no = F.lit(False)
    order = duplicates.keeper_order(F.col("base"), F.col("modified"), F.concat_ws("#", "rel_path", F.col("file_id").cast("string")), no, no)
    return duplicates.groups(rows, F.col("file_id"), F.sha2("title", 256), F.length("title").cast("long"), order)


def dup_near_pairs(spark, d):
    """Documents whose whole first lines are equal or nearly so, over the whole table; lines without letters or digits say nothing."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null").distinct()
    return duplicates.near_pairs(rows.select(F.col("doc_id").alias("id"), text.normalize(F.substring_index("text", "\n", 1)).alias("norm")))


# ---- text scalars


def norm_text(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark", "item_id", "text").select("item_id", text.normalize(t).alias("norm"), text.alnum_count(t).alias("alnum"), text.word_count(t).alias("words"))


def document_scalars(spark, d):
    """What norm_text, escapes and sanitized give for the items, for the texts of all documents."""
    t = F.col("text")
    rows = table(spark, d, "documents", "doc_id", "text")
    return rows.select(
        "doc_id", text.normalize(t).alias("norm"), text.alnum_count(t).alias("alnum"), text.word_count(t).alias("words"), text.md_escape(t).alias("md"), text.html_escape(t).alias("html"), text.slug(t, F.col("doc_id")).alias("slug"),
        text.safe_file_name(t, "md").alias("file_name"), text.field_unescape(text.field_escape(t)).alias("back"), names.sanitize(t, 60).alias("name"),
    )


def clean_titles(spark, d):
    return _files(spark, d, "title").where("title is not null").select("file_id", text.clean_text(F.col("title")).alias("clean"))


def previews(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.preview(F.col("text")).alias("preview"), text.truncate(F.col("text"), 70).alias("cut"))


def size_labels(spark, d):
    n = F.col("n_bytes")
    return _files(spark, d, "n_bytes").select("file_id", text.format_size(n).alias("size"), text.format_size(n * 4000).alias("size_4000"), text.format_duration(F.floor(n / 100)).alias("length"))


def escapes(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark", "item_id", "text").select("item_id", text.md_escape(t).alias("md"), text.html_escape(t).alias("html"), text.slug(t, F.col("item_id")).alias("slug"), text.safe_file_name(t, "md").alias("file_name"), text.field_unescape(text.field_escape(t)).alias("back"))


def similar_neighbours(spark, d):
    """Dice of each section title and the next one's, without a cross join."""
    rows = table(spark, d, "sections", "section_id", "title").where("title is not null").distinct()
    a, b = rows.select("section_id", F.left(text.normalize(F.col("title")), F.lit(40)).alias("a")), rows.select((F.col("section_id") - 1).alias("section_id"), F.left(text.normalize(F.col("title")), F.lit(40)).alias("b"))
    return a.join(b, "section_id").select("section_id", F.round(text.similarity(F.col("a"), F.col("b")), 6).alias("dice"))


def similar_whole_titles(spark, d):
    """As :func:`similar_neighbours`, whose SQL compares the first 40 characters, with titles of any length."""
    rows = table(spark, d, "sections", "section_id", "title").where("title is not null").distinct()
    a, b = rows.select("section_id", text.normalize(F.col("title")).alias("a")), rows.select((F.col("section_id") - 1).alias("section_id"), text.normalize(F.col("title")).alias("b"))
    return a.join(b, "section_id").select("section_id", F.round(text.similarity(F.col("a"), F.col("b")), 6).alias("dice"))


def natural_order(spark, d):
    return _files(spark, d, "rel_path").select("file_id", text.natural_key(F.substring_index("rel_path", "/", -1)).alias("sort_key"))


def joined_lines(spark, d):
    """Each recognised line with the next of its page, as one sentence goes on."""
    rows = table(spark, d, "ocr_line", "line_id", "file_id", "page", "line_no", "text").distinct()
    w = Window.partitionBy("file_id", "page").orderBy("line_no", "line_id")
    return rows.withColumn("b", F.lead("text").over(w)).where("b is not null").select("line_id", text.join_lines(F.col("text"), F.col("b")).alias("joined"))


# ---- details


def _entries(spark, d):
    rows = table(spark, d, "blocks", "section_id", "block_no", "text", "block_id").where("text is not null").distinct()
    return rows.select(F.col("section_id").alias("grp"), F.struct("block_no", "block_id").alias("pos"), F.col("block_no").alias("source"), "text")


def _detail(spark, d, key):
    found = detectors.highlights(_entries(spark, d), (key,))
    return found.select(F.col("grp").alias("section_id"), F.lower("value").alias("value"), F.size("sources").alias("sources"))


def emails_found(spark, d):
    return _detail(spark, d, "emails")


def phones_found(spark, d):
    return _detail(spark, d, "phones")


def key_details(spark, d):
    """All five kinds of details of every section, with sources in order."""
    return detectors.highlights(_entries(spark, d)).select(F.col("grp").alias("section_id"), "key", "value", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


def links_minus_email_domains(spark, d):
    rows = table(spark, d, "highlights", "section_id", "hl_key", "hl_value").where("hl_value is not null").select("section_id", F.lower("hl_key").alias("k"), F.lower("hl_value").alias("v")).distinct()
    values = rows.select(F.col("section_id").alias("grp"), F.col("k").alias("key"), F.col("v").alias("low"))
    return detectors.without_mail_links(values).where("key = 'links'").select(F.col("grp").alias("section_id"), F.col("low").alias("link"))


def highlight_values(spark, d):
    rows = table(spark, d, "highlights", "highlight_id", "section_id", "hl_key", "hl_value").where("hl_value <> ''").distinct()
    return rows.groupBy("section_id", F.lower("hl_key").alias("hl_key"), F.lower("hl_value").alias("low")).agg(F.min_by("hl_value", "highlight_id").alias("value"), F.count("*").alias("times"))


def keyword_mentions(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(F.col("text").rlike(text.keyword_pattern(KEYWORD))).select("doc_id")


def keyword_dedup(spark, d):
    """Blocks that mention a word, without those that an earlier one of the section contains."""
    rows = table(spark, d, "blocks", "section_id", "block_no", "text").where("text is not null").distinct()
    hits = rows.where(F.col("text").rlike(text.keyword_pattern("the"))).select("section_id", "block_no", text.normalize(F.col("text")).alias("norm"))
    earlier = hits.select("section_id", F.col("block_no").alias("no"), F.col("norm").alias("whole"))
    return hits.join(earlier, (hits["section_id"] == earlier["section_id"]) & (F.col("no") < F.col("block_no")) & F.contains("whole", F.col("norm")), "left_anti").select("section_id", "block_no")


# ---- names, kinds, titles, topics


def kind_counts(spark, d):
    kind = kinds.kind_of(F.col("rel_path"))
    return _files(spark, d, "rel_path").groupBy(kind.alias("kind"), kinds.label_of(kind).alias("label")).agg(F.count("*").alias("files"))


def name_meaningful(spark, d):
    return _files(spark, d, "title").where("title is not null").select("file_id", names.is_meaningful(F.col("title")).alias("clear"))


def sanitized(spark, d):
    return table(spark, d, "benchmark", "item_id", "text").select("item_id", names.sanitize(F.col("text"), 60).alias("name"))


def first_good_lines(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", titles.first_good_line(F.col("text")).alias("title"))


def topic_classify(spark, d):
    rows = topics.classify(_files(spark, d, "title", "text"))
    return rows.where("match is not null").select("file_id", "match.topic", "match.label", "match.score")


def file_descriptions(spark, d):
    rows = _files(spark, d, "kind", "doc_label", "pages", "width", "height", "place", "tags", "details")
    return rows.select("file_id", describe.describe({c: F.col(c) for c in rows.columns[1:]}).alias("about"))


def best_date(spark, d):
    """The offer from the best source for each file; the first offered among equals."""
    rows = table(spark, d, "date_offers", "offer_id", "file_id", "date_text", "date_source").where("date_text <> ''").distinct()
    return rows.groupBy("file_id").agg(dates.best_offer(F.col("date_text"), F.col("date_source"), F.col("offer_id")).alias("date_text"), F.min("date_source").alias("date_source"))


def file_name_dates(spark, d):
    from .functions.dates import from_file_name

    rows = table(spark, d, "date_offers", "offer_id", "date_text").where("date_text is not null").distinct()
    return rows.select("offer_id", from_file_name(F.col("date_text")).alias("moment")).where("moment is not null")


# ---- folders and catalog


def folder_counts(spark, d):
    return catalog.counts_by_top_folder(_files(spark, d, "rel_path"), "rel_path")


def folder_rollup(spark, d):
    return catalog.roll_up(_files(spark, d, "rel_path", "n_bytes"), "rel_path", "n_bytes")


def _catalog(spark, d):
    rows = _files(spark, d, "rel_path", "kind", "modified", "n_bytes", "title", "text", "doc_label", "topic")
    empty = F.lit("")
    return rows.select(
        F.concat_ws("/", F.coalesce("topic", F.lit("Other")), F.concat(F.col("file_id").cast("string"), F.lit(" "), F.substring_index("rel_path", "/", -1))).alias("path"), F.col("rel_path").alias("original_path"), "kind",
        F.date_format("modified", "yyyy-MM-dd HH.mm").alias("date"), F.col("n_bytes").alias("size"), F.coalesce("doc_label", empty).alias("description"), F.coalesce("title", empty).alias("preview"), empty.alias("note"),
        F.coalesce(F.left("text", F.lit(1500)), empty).alias("search_text"), F.lit("1").alias("run_id"),
    )


def catalog_search(spark, d):
    return catalog.search(_catalog(spark, d), SEARCH).select("path", "score", "date")


def catalog_upsert(spark, d):
    """Entries of files with a title, then all entries of images put over them."""
    whole = _catalog(spark, d)
    new = whole.where("kind in ('PHOTO', 'SCREENSHOT')").withColumn("run_id", F.lit("2"))
    return catalog.upsert(whole.where("preview <> ''"), new).groupBy("run_id").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def catalog_join(spark, d):
    labels = table(spark, d, "labels", "doc_id", "quality", "toxic").distinct()
    return table(spark, d, "documents", "doc_id", "n_chars").join(labels, "doc_id", "left")


def _doc_paths(spark, d):
    return table(spark, d, "documents", "doc_id").withColumn("path", F.col("doc_id").cast("string"))


def _label_paths(spark, d):
    return table(spark, d, "labels", "doc_id").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("path"))


def catalog_prune(spark, d):
    return catalog.prune(_doc_paths(spark, d), _label_paths(spark, d)).select("doc_id")


def catalog_untracked(spark, d):
    return catalog.untracked(_label_paths(spark, d), _doc_paths(spark, d)).select("doc_id")


def index_lines(spark, d):
    return indexes.master_lines(_catalog(spark, d))


def folder_index_texts(spark, d):
    return indexes.folder_indexes(_catalog(spark, d))


def unique_names(spark, d):
    """Names of files in their folders, numbered where they clash."""
    rows = _files(spark, d, "rel_path").select("file_id", F.regexp_replace("rel_path", "/[^/]*$", "").alias("folder"), F.substring_index("rel_path", "/", -1).alias("name"))
    return planner.unique_names(rows, "folder", "name", ["file_id"]).select("file_id", "folder", "claimed")


# ---- lines and pages


def line_gaps(spark, d):
    rows = table(spark, d, "ocr_line", "line_id", "file_id", "page", "line_no", "bbox").distinct().select("line_id", "file_id", "page", "line_no", "bbox.y0", "bbox.y1")
    gaps = pages.line_gaps(rows, ["file_id", "page"], "line_no")
    return gaps.where("gap >= 0").groupBy("file_id").agg(F.percentile("gap", 0.5).alias("typical"), F.count("*").alias("gaps"))


def weighted_body_size(spark, d):
    rows = table(spark, d, "ocr_line", "line_id", "file_id", "text", "bbox").distinct()
    return rows.groupBy("file_id").agg(pages.body_size((F.col("bbox.y1") - F.col("bbox.y0")) * 0.72, F.col("text")).alias("body"))


def line_classes(spark, d):
    """How lines of blocks begin."""
    rows = table(spark, d, "blocks", "block_id", "text").where("text is not null").distinct().select("block_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("block_id", pages.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"))


# Beginnings of lines, without lookaround.
CHECK = r"^(?:\[(?: |x|X|✓|✔)?\]|\[[1lI|]\s|LJ\s|☐|□|☑|☒|✅|✓|✔)\s*\S"
ORDERED = r"^\d{1,2}[.)]\s+\S"
BULLET = r"^[•●○◦▪▫■◆◇►▸‣⁃∙·\-–—*+>]\s+\S"
MISREAD_BULLET = r"^[«»©®oe¢c]\s+[A-Z0-9\"'(]"
FIELD = r"^[A-Z][A-Za-z0-9 '&/#().-]{0,28}:\s+\S"


def reading_order(spark, d):
    """The text of each page, blocks read in bands of 40 from the top and from the left."""
    rows = table(spark, d, "ocr_line", "line_id", "file_id", "page", "text", "bbox").distinct()
    key = F.struct(F.floor(F.col("bbox.y0") / 40).alias("band"), F.col("bbox.x0").alias("x"), "line_id", "text")
    return rows.groupBy("file_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["text"]), "\n").alias("page_text"))


def block_runs(spark, d):
    """Neighbouring blocks of one type in a section: gaps and islands."""
    rows = table(spark, d, "blocks", "block_id", "section_id", "block_no", "block_type").distinct()
    w = Window.partitionBy("section_id").orderBy("block_no", "block_id")
    new = F.when(F.col("block_type").eqNullSafe(F.lag("block_type").over(w)), 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("section_id", "run", "block_type").agg(F.count("*").alias("blocks"), F.min("block_no").alias("first_no"))


def section_stats(spark, d):
    rows = table(spark, d, "sections", "section_id", "text", "confidence", "source_files", "removed_lines").dropDuplicates(["section_id"])
    files = F.coalesce(F.size("source_files"), F.lit(0))
    return rows.select("section_id", text.word_count(F.col("text")).alias("words"), F.coalesce(F.floor(F.col("confidence") + 0.5).cast("int"), F.lit(0)).alias("confidence"), F.coalesce(F.col("confidence") < 70, F.lit(False)).alias("unsure"), F.when(F.col("source_files").isNull(), 0).otherwise(files).alias("files"))


def section_sources(spark, d):
    """Sections of each file, a file named twice in a section counting once."""
    rows = table(spark, d, "sections", "section_id", "source_files").dropDuplicates(["section_id"]).select("section_id", F.explode(F.array_distinct("source_files")).alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("sections"), F.min("section_id").alias("first_section"))


def page_overlay_words(spark, d):
    """The band join of overlay_words over the recognised lines of all files, a line being one word."""
    return pages.overlay_words(cut(pages.words_of(_as_pages(spark, d))))


def section_components(spark, d):
    """Sections that common source files lead to each other over any number of steps, by the least of them."""
    rows = table(spark, d, "sections", "section_id", "source_files").dropDuplicates(["section_id"])
    named = rows.select("section_id", F.explode("source_files").alias("file")).distinct()
    first = named.groupBy("file").agg(F.min("section_id").alias("i"))
    links = named.join(first, "file").where("section_id <> i").select("i", F.col("section_id").alias("j")).distinct()
    return pages.link_components(rows.select(F.col("section_id").alias("node")), links)


def _as_pages(spark, d):
    """Recognised lines of all pages of every file, a file being one document."""
    rows = table(spark, d, "ocr_line", "line_id", "file_id", "page", "block", "para", "line_no", "text", "confidence", "bbox", "img_w", "img_h")
    line = F.struct(F.coalesce("line_no", F.lit(0)).alias("no"), F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("para", F.lit(0)).alias("para"), "text", "confidence", "bbox", "line_id")
    out = rows.groupBy("file_id", "page").agg(F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"), F.array_sort(F.collect_list(line)).alias("sorted"))
    # lines that were delivered again stand side by side
    out = out.withColumn("lines", F.filter("sorted", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("sorted", i - 1))))
    word = lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox"), F.array().cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>").alias("symbols"))
    whole = lambda x: F.struct(x["block"].alias("block"), x["para"].alias("para"), x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox"), F.array(word(x)).alias("words"))
    return out.select(F.col("file_id").cast("string").alias("doc"), "page", F.concat(F.lit("page "), F.col("page").cast("string")).alias("file_name"), "img_w", "img_h", F.transform("lines", whole).alias("lines"))


def organized_documents(spark, d):
    return documents.organize(_as_pages(spark, d))


def rendered_markdown(spark, d):
    return render.rendered(documents.organize(_as_pages(spark, d)), "md")


def section_bubbles(spark, d):
    """Neighbouring blocks of one type in a section, their texts joined like messages of one speaker."""
    rows = table(spark, d, "blocks", "block_id", "section_id", "block_no", "block_type", "text").dropDuplicates(["block_id"])
    said = pages.speaker_runs(rows, ["section_id"], ["block_no", "block_id"], "block_type", "text")
    return said.select("section_id", F.col("run").alias("bubble"), F.col("who").alias("block_type"), "said")


def catalog_upsert_rows(spark, d):
    """As :func:`catalog_upsert`, entry by entry."""
    whole = _catalog(spark, d)
    new = whole.where("kind in ('PHOTO', 'SCREENSHOT')").withColumn("run_id", F.lit("2"))
    return catalog.upsert(whole.where("preview <> ''"), new).select("path", "run_id", "size", "date")


def markup_roundtrip(spark, d):
    """Blocks parsed from the texts of sections and written again give the same markup."""

    @F.arrow_udf("boolean")
    def same(t: pa.Array) -> pa.Array:
        once = [to_markup(parse_markup(x)) for x in t.to_pylist()]
        return pa.array([to_markup(parse_markup(x)) == x for x in once], pa.bool_())

    rows = table(spark, d, "sections", "section_id", "text").where("text is not null").distinct()
    return rows.select("section_id", same("text").alias("same"))



def queries() -> dict:
    skip = {"queries", "oracle_sql", "table", "cut"}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_" and k not in skip}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
