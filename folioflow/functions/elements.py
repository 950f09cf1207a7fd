"""Paragraphs of pages as typed elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import trim

CATEGORIES = ("Table", "Title", "ListItem", "Header", "NarrativeText", "FigureCaption", "UncategorizedText", "Footer")


def category(p: Column) -> Column:
    upper = (F.upper(p) == p) & (F.lower(p) != p)
    return (
        F.when(p.startswith("|") & F.substring(p, 2, 1 << 30).contains("|"), "Table")
        .when(p.rlike(r"^#{1,6}\s") | ((F.length(p) < 120) & upper), "Title")
        .when(p.rlike(r"^(?:[-*•]|\d+\.)\s"), "ListItem")
        .when((F.length(p) < 80) & ~p.endswith("."), "Header")
        .otherwise("NarrativeText")
    )


def by_warnings(warnings: Column, own: Column) -> Column:
    """What a page's warnings make of its elements: recognised text is a caption, doubtful text has no category."""
    has = lambda words: F.exists(warnings, lambda w: F.lower(w).rlike(words))
    return F.when(has("ocr"), "FigureCaption").when(has("encrypted|open_failed|garbled|legacy"), "UncategorizedText").otherwise(own)


def elements(pages: DataFrame, split: bool = True) -> DataFrame:
    """Pages (path, page_index, content, warnings) to (path, page_index, element_index, text, category, filename, page_number, file_directory)."""
    parts = F.filter(F.transform(F.split("content", r"\n\s*\n"), trim), lambda p: p != "")
    whole = F.filter(F.array(trim(F.col("content"))), lambda p: p != "")
    rows = pages.select("path", "page_index", "warnings", F.posexplode(parts if split else whole).alias("element_index", "text"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return rows.select(
        "path",
        "page_index",
        "element_index",
        "text",
        by_warnings(F.coalesce("warnings", F.array().cast("array<string>")), category(F.col("text"))).alias("category"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        (F.col("page_index") + 1).alias("page_number"),
        F.when(folder == "", ".").otherwise(folder).alias("file_directory"),
    )
