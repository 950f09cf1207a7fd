"""Sinks: text lists, JSON, Markdown, and documents for retrieval frameworks, all as projections of pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

JSON_COLUMNS = ("path", "page_index", "content", "chunks", "child_chunks", "metadata", "form_fields", "error", "extraction_confidence", "ocr_used", "text_density", "warnings", "language")


def ordered(pages: DataFrame) -> DataFrame:
    return pages.orderBy("path", "page_index")


def iterate(pages: DataFrame) -> Iterator[Row]:
    """Pages one partition at a time, for callers that pull."""
    return pages.toLocalIterator(prefetchPartitions=True)


def texts(pages: DataFrame) -> DataFrame:
    return ordered(pages).select("content")


def write_json(pages: DataFrame, path: str) -> None:
    pages.select(*JSON_COLUMNS).write.json(path)


def write_json_array(pages: DataFrame, path: str) -> int:
    """One JSON array in one local file, streamed row by row; returns the number of pages."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in ordered(pages).select(F.to_json(F.struct(*JSON_COLUMNS)).alias("j")).toLocalIterator():
            f.write((",\n" if n else "\n") + r["j"])
            n += 1
        f.write("\n]\n")
    return n


def markdown(pages: DataFrame) -> DataFrame:
    head = F.concat(F.lit("# Document: "), "path", F.lit(" - Page "), (F.col("page_index") + 1).cast("string"))
    return ordered(pages).select(F.concat(head, F.lit("\n\n"), "content", F.lit("\n")).alias("value"))


def _over(base: Column, *later: Column) -> Column:
    """Maps merged, later ones winning."""
    for m in later:
        base = F.map_concat(_without(base, m), m)
    return base


def _without(base: Column, m: Column) -> Column:
    return F.map_filter(base, lambda k, v: ~F.map_contains_key(m, k))


def chunk_documents(pages: DataFrame, form_fields_last: bool = True) -> DataFrame:
    """A row by chunk (id, text, metadata): page metadata, then the source, then chunk_index; form fields win last or before it.

    Ids hold the page, so they are unique.
    """
    rows = pages.select("path", "page_index", "metadata", "form_fields", F.posexplode("chunks").alias("k", "text"))
    source = F.create_map(F.lit("source"), F.col("path"), F.lit("page_index"), F.col("page_index").cast("string"))
    index = F.create_map(F.lit("chunk_index"), F.col("k").cast("string"))
    last = (index, F.col("form_fields")) if form_fields_last else (F.col("form_fields"), index)
    name = F.concat("path", F.lit("_p"), F.col("page_index").cast("string"), F.lit("_chunk_"), F.col("k").cast("string"))
    return rows.select(name.alias("id"), "text", _over(F.col("metadata"), source, *last).alias("metadata"))


def to_langchain(pages: DataFrame) -> Iterator:
    from langchain_core.documents import Document

    return (Document(page_content=r["text"], metadata=dict(r["metadata"])) for r in chunk_documents(pages).toLocalIterator())


def to_llamaindex(pages: DataFrame) -> Iterator:
    from llama_index.core import Document

    return (Document(id_=r["id"], text=r["text"], metadata=dict(r["metadata"])) for r in chunk_documents(pages, False).toLocalIterator())
