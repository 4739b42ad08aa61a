"""Titles out of texts and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import tidy_case, words

JUNK_TITLE = (
    r"(?i)^(microsoft (word|excel|powerpoint)( -.*)?|untitled.*|document\d*|doc\d*|book\d*|presentation\d*|slide \d+|powerpoint presentation|title|page \d+( of \d+)?"
    r"|sheet\d*|new document|click to edit.*|\d+|[a-z]:\\.*|.*\.(docx?|pdf|xlsx?|pptx?|txt))$"
)
JUNK_LINE = (
    r"(?i)^(page \d+( of \d+)?|\d+ ?/ ?\d+|confidential|draft|www\..*|https?://.*|.*@.*\..*|tel[:.].*|phone[:.].*|fax[:.].*|[0-9 ()+\-./:,$€£%]+|©.*|copyright.*"
    r"|all rights reserved.*|\W+|[0-9: ]+\s*(am|pm)|mon|tue|wed|thu|fri|sat|sun)$"
)
NO_PERSON = r"(?i)(user|owner|admin|microsoft|office|windows|unknown|author|pc|computer|hp|dell|lenovo)"
#: Lines of a text that are looked at, and words that a title keeps.
LINES, WORDS = 60, 9


def is_useful_title(c: Column) -> Column:
    t = F.btrim(c)
    return F.length(t).between(3, 120) & ~t.rlike(JUNK_TITLE) & t.rlike(r"\p{L}")


def is_person_name(c: Column) -> Column:
    t = F.btrim(c)
    return F.length(t).between(3, 60) & ~t.rlike(NO_PERSON) & t.rlike(r"\p{L}")


def _tidy_line(raw: Column) -> Column:
    return F.btrim(F.btrim(F.btrim(F.regexp_replace(raw, r"[\t ]+", " ")), F.lit("•*-#|\"“”:=_")))


def _good(line: Column) -> Column:
    found = words(line)
    lettered = F.size(F.filter(found, lambda w: F.regexp_count(w, F.lit(r"\p{L}")) >= 2))
    first = F.length(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")))
    odd = F.length(F.regexp_replace(line, r"[\p{L}\p{N} .,'&\-()/:!?$€£%+#]", ""))
    return (F.length(line) >= 3) & ~line.rlike(JUNK_LINE) & (lettered > 0) & ~((lettered == 1) & ((first < 4) | (F.length(line) < 4))) & (odd * 4 <= F.length(line))


def first_good_line(text: Column) -> Column:
    """The first line that reads like a title, cut to nine words; null if there is none."""
    lines = F.transform(F.slice(F.split(text, "\r\n|\n|\r"), 1, LINES), _tidy_line)
    line = F.try_element_at(F.filter(lines, _good), F.lit(1))
    short = lambda x: F.when(F.size(words(x)) > WORDS, F.rtrim(F.array_join(F.slice(F.split(x, " "), 1, WORDS), " "), F.lit(",;:-"))).otherwise(x)
    return F.transform(F.array(line), lambda x: tidy_case(F.rtrim(short(x), F.lit(".,;:"))))[0]
