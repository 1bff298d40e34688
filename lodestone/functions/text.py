"""Functions of text, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import col

_EDGES = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, without blanks at their ends; empty ones are left out."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n", -1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, _EDGES, "")), lambda p: p != "")


def split_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, paragraph)."""
    return docs.select(col(id_col), F.posexplode(paragraphs(col(text_col))).alias("position", "paragraph"))


def approximate_tokens(text: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long")


def line_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def content_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")
