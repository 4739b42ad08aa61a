"""Text scalars as column expressions: cleaning, comparing, shortening, formatting.

Null in, null out, unless a docstring says otherwise.  Empty texts are texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as the reference's two halves know them: of ASCII only, or of any kind.
ASCII_SPACE = r"\s+"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trim_any(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def clean_text(c: Column) -> Column:
    """Zero-width characters out, quotes straight, runs of quotes and of blanks to one, ends trimmed."""
    c = F.regexp_replace(c, "[​-‍﻿]", "")
    c = F.translate(c, "“”‘’", "\"\"''")
    return trim_any(F.regexp_replace(F.regexp_replace(c, "'{2,}", "'"), SPACE, " "))


def normalize(c: Column) -> Column:
    """Small ASCII letters and digits only, for comparing lines."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def alnum_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]"))


def word_count(c: Column) -> Column:
    """Words between blanks; null counts 0."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != ""))


def bigrams(c: Column) -> Column:
    """All neighbouring pairs of characters, with repeats; none for fewer than two."""
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Dice coefficient over the bags of bigrams: 1 for equal strings, 0 if either has fewer than two characters."""
    ga, gb = bigrams(a), bigrams(b)
    count = lambda bag, g: F.size(F.filter(bag, lambda x: x == g))
    shared = F.aggregate(F.array_distinct(ga), F.lit(0), lambda s, g: s + F.least(count(ga, g), count(gb, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b) - 2))


def preview(c: Column, size: int = 160) -> Column:
    """The first words on one line, at most ``size`` characters and a mark; null for texts of blanks."""
    t = trim_any(F.regexp_replace(c, ASCII_SPACE, " "))
    return F.when(t == "", None).when(F.length(t) <= size, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(size)), " [^ ]*$", ""), F.lit("…")))


def truncate(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(trim_any(F.left(c, F.lit(size - 1))), F.lit("…"))).otherwise(c)


def format_size(n: Column) -> Column:
    """Bytes for people: B, KB rounded, MB with one and GB with two decimals."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.floor((n + 512) / 1024).cast("string"), F.lit(" KB")))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1048576.0))
        .otherwise(F.when(n.isNotNull(), F.format_string("%.2f GB", n / 1073741824.0)))
    )


def format_duration(s: Column) -> Column:
    whole = lambda x: F.floor(x).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" sec")))
        .when(s < 3600, F.concat(whole((s + 30) / 60), F.lit(" min")))
        .otherwise(F.concat(whole(s / 3600), F.lit(" hr "), whole(s % 3600 / 60), F.lit(" min")))
    )


def slug(c: Column, index: Column) -> Column:
    """Anchor of the section with this index (from 0)."""
    body = F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(40))
    return F.concat(F.lit("sec-"), (index + 1).cast("string"), F.lit("-"), body)


def safe_file_name(title: Column, ext: str) -> Column:
    base = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|…]+', "")
    base = F.btrim(F.regexp_replace(F.regexp_replace(base, "[^ -~ -ɏ]", ""), SPACE, " "))
    base = F.regexp_replace(F.left(base, F.lit(80)), r"[.\s]+$", "")
    return F.concat(F.when(base == "", "screenshot-notes").otherwise(base), F.lit("." + ext))


def md_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]<>|])", r"\\$1")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def field_escape(c: Column) -> Column:
    """One field of the catalog's tab-separated lines."""
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def field_unescape(c: Column) -> Column:
    """Inverse of :func:`field_escape`.  An escaped backslash is set aside as a
    private character, so that each sign is read once."""
    c = F.replace(c, F.lit("\\\\"), F.lit(""))
    c = F.replace(F.replace(c, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
    return F.replace(F.regexp_replace(c, r"\\(.)", "$1"), F.lit(""), F.lit("\\"))


def fix_url_spacing(c: Column) -> Column:
    """Blanks that recognition puts into web addresses, out again."""
    c = F.regexp_replace(c, r"(?i)\b(https?)\s*:\s*/\s*/", "$1://")
    c = F.regexp_replace(c, r"(?i)\bwww\s*\.\s*", "www.")
    return F.regexp_replace(c, r"(?i)([a-z0-9])\s*\.\s*(com|org|net|gov|edu|io|co|us|app|dev|ai|info|biz|me|tv)\b", "$1.$2")


def settings_list(c: Column) -> Column:
    """Items of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.btrim(x)), lambda x: x != "")


def natural_key(c: Column) -> Column:
    """Sorts names with numbers by their values: numbers padded to 12 digits."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def keyword_pattern(keyword: str) -> str:
    """A pattern that finds the words of ``keyword`` with any blanks between them, in either case."""
    import re

    return "(?i)" + r"\s+".join(re.escape(w) for w in keyword.split())


def join_lines(a: Column, b: Column) -> Column:
    """Two lines of one sentence: a hyphen at the end of a word stays and takes no blank."""
    return F.when(a.rlike(r"[\p{L}\d]-$") & b.rlike(r"^[\p{L}\d]"), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
