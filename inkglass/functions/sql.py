"""Text functions for SQL: temporary functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "ink_normalize(t STRING) RETURNS STRING": "regexp_replace(lower(t), '[^a-z0-9]', '')",
    "ink_alnum_count(t STRING) RETURNS INT": r"regexp_count(t, r'[\p{L}\p{N}]')",
    "ink_word_count(t STRING) RETURNS INT": r"size(filter(split(coalesce(t, ''), r'\s+'), w -> w <> ''))",
    "ink_format_size(n BIGINT) RETURNS STRING": "CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat((n + 512) DIV 1024, ' KB') WHEN n < 1073741824 THEN format_string('%.1f MB', n / 1048576.0D) ELSE format_string('%.2f GB', n / 1073741824.0D) END",
    "ink_bigrams(t STRING) RETURNS ARRAY<STRING>": "CASE WHEN length(t) >= 2 THEN transform(sequence(1, length(t) - 1), i -> substring(t, i, 2)) ELSE array() END",
    "ink_md_escape(t STRING) RETURNS STRING": r"regexp_replace(t, r'([\\`*_{}\[\]<>|])', r'\\$1')",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql``; the names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
