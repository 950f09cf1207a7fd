"""Parsers that need no Python: expressions from raw text or bytes to page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.sources.formats import PLAIN

#: Extensions whose whole reading is one expression.
NATIVE = PLAIN | {"csv", "htm", "html", "xml"}
LEGACY_TEXT = "Legacy binary document: convert it to the current format to extract its text."


def ndjson_line(line: Column) -> Column:
    """A JSON object as ``k: v`` pairs in the order of keys, nested values as JSON."""
    entries = F.array_sort(F.map_entries(F.from_json(line, "map<string,string>")))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), " | ")


def native_text(ext: Column, content: Column) -> Column:
    """Text by kind of file; null for kinds that aren't native."""
    raw = text.utf8_text(content)
    return (
        F.when(ext.isin("html", "htm"), text.html_text(raw))
        .when(ext == "csv", text.csv_text(raw))
        .when(ext == "xml", text.xml_text(raw))
        .when(ext.isin(*sorted(PLAIN)), raw)
    )


def native_error(ext: Column, content: Column) -> Column:
    """Markup that isn't UTF-8 is an error; plain text that isn't is an empty page."""
    return F.when(ext.isin("html", "htm", "csv", "xml") & ~F.is_valid_utf8(content.cast("string")), F.concat(F.upper(ext), F.lit(": content is not UTF-8")))
