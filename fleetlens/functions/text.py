"""Text preprocessing and log payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Python's str.split() takes for white space: Unicode's, and four separator controls.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
# Where log text is found in a reply, in order.
PAYLOAD_KEYS = ("logs", "contents", "content")


def lowered(text: Column) -> Column:
    """Lower-case text; a null reads as the word ``none``."""
    return F.lower(F.coalesce(text.cast("string"), F.lit("None")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def preprocess_text(df: DataFrame) -> DataFrame:
    """Add processed_text, tokens and token_count; unchanged without a text column."""
    if "text" not in df.columns:
        return df
    return (
        df.withColumn("processed_text", lowered(F.col("text")))
        .withColumn("tokens", words(F.col("processed_text")))
        .withColumn("token_count", F.size("tokens"))
    )


def prompts_to_items(df: DataFrame, text: str, model: str, max_tokens: int = 256) -> DataFrame:
    """One batch item per non-blank line, numbered after the blank lines are dropped."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(r"(?U)[^\s\x{FEFF}]"))
    return df.select("*", F.posexplode(lines).alias("__pos", "prompt")).select(
        *[c for c in df.columns if c != text],
        (F.col("__pos") + 1).alias("item_no"),
        F.concat(F.lit("q"), F.col("__pos") + 1).alias("custom_id"),
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
    )


def log_payload_text(raw: Column) -> Column:
    """Log text of a reply: plain text as is, else the first text field of the JSON."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    parsed = F.try_parse_json(text)

    def text_at(path: str) -> Column:
        value = F.try_variant_get(parsed, path, "variant")
        return F.when(
            F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, path, "string")
        )

    found = [text_at(p) for key in PAYLOAD_KEYS for p in (f"$.data.{key}", f"$.{key}")]
    plain = ~F.startswith(text, F.lit("{")) | parsed.isNull()
    return F.when(plain, text).otherwise(F.coalesce(*found, F.lit("")))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    stripped = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(stripped)) / len(needle)).cast("long")
