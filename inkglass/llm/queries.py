"""The queries of this subpackage: name to (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encodings, leaks, lookalikes, personal, scans, spans, subjects, tokens


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """The titles and texts of files, each delivered row once."""
    files = table(spark, d, "file_facts", "file_id", "title", "text")
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("title", "text")])).alias("f")
    return files.select(F.col("file_id").alias("id"), one).select("id", "f.field", "f.text").where("text <> ''")


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_tokens(_fields(spark, d), table(spark, d, "documents", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select(F.col("id").alias("file_id"), "field").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restore(_fields(spark, d), _garbled(spark, d)).withColumnRenamed("id", "file_id")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sections", "section_id", "text", "source_files")
    return rows.withColumnsRenamed({"section_id": "id", "source_files": "sources"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_stretches(_sections(spark, d)).withColumnRenamed("id", "section_id")


def p2_shared_share(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d)
    return spans.shared_share(rows, spans.shared_stretches(rows)).withColumnRenamed("id", "section_id")


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "ocr_line", "line_id", "file_id", "page", "para", "line_no", "text"), table(spark, d, "blocks", "block_id", "section_id", "block_no", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(*_scans(spark, d))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(*_scans(spark, d))


def _personal_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = (("file", "file_facts", "file_id", "text"), ("block", "blocks", "block_id", "text"), ("highlight", "highlights", "highlight_id", "hl_value"))
    rows = [table(spark, d, t).select(F.lit(src).alias("src"), F.col(i).alias("rec_id"), F.col(c).alias("text")) for src, t, i, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.mentions(_personal_texts(spark, d)).drop("end_at")


def p4_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return personal.sanitised(_personal_texts(spark, d))


def _alike_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("text").alias("src"), F.col("doc_id").alias("id"), "text")
    titles = table(spark, d, "file_facts").select(F.lit("title").alias("src"), F.col("file_id").alias("id"), F.col("title").alias("text"))
    return docs.unionByName(titles)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _alike_texts(spark, d)
    return lookalikes.alike_pairs_of(texts, lookalikes.rewrites(lookalikes.count_members(texts)))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    texts = _alike_texts(spark, d)
    return lookalikes.canonical(texts, lookalikes.rewrites(lookalikes.count_members(texts))).distinct()


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    texts = _alike_texts(spark, d)
    return lookalikes.classes(texts, lookalikes.rewrites(lookalikes.count_members(texts)))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _fold_table(docs: DataFrame, items: DataFrame) -> dict[str, str]:
    return lookalikes.rewrites(lookalikes.count_members(docs.select("text").unionByName(items.select("text"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")
    return leaks.leaked(docs, items, _fold_table(docs, items))


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")
    return leaks.reparameterised(docs, items, _fold_table(docs, items))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    names = [r.subject for r in table(spark, d, "subjects", "subject").orderBy("subject").collect()]  # a list of subjects, not data
    return subjects.assign(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "labels", "doc_id", "subject"), names)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p7_round_trip": "SELECT doc_id, TRUE AS same FROM documents"}
