"""One line about a file, for indexes and searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import label_of
from .text import format_duration


def describe(facts: dict[str, Column]) -> Column:
    """From columns kind, doc_label, pages, duration_s, width, height, author,
    album, tags, place and details, whichever are given; nulls are left out."""
    c = lambda name, kind="string": facts.get(name, F.lit(None).cast(kind))
    pages = c("pages", "int")
    parts = F.array(
        F.coalesce(c("doc_label"), label_of(c("kind"))),
        F.when(pages == 1, "1 page").when(pages.isNotNull(), F.concat(pages.cast("string"), F.lit(" pages"))),
        format_duration(c("duration_s", "bigint")),
        F.concat(c("width", "int").cast("string"), F.lit("×"), c("height", "int").cast("string")),
        F.concat(F.lit("by "), c("author")),
        F.concat(F.lit("album: "), c("album")),
        F.when(F.size(F.coalesce(c("tags", "array<string>"), F.array().cast("array<string>"))) > 0, F.concat(F.lit("shows: "), F.array_join(c("tags", "array<string>"), ", "))),
        F.concat(F.lit("taken in "), c("place")),
    )
    return F.array_join(F.array_compact(F.concat(parts, F.coalesce(c("details", "array<string>"), F.array().cast("array<string>")))), " · ")
