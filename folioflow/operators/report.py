"""Run reports over pages. All are aggregates with partial sums; a file of many pages is no hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import extension, trim


def _failed():
    return F.col("error").isNotNull() | ((trim(F.col("content")) == "") & (F.col("extraction_confidence") < 0.2))


def _repaired():
    m = F.col("metadata")
    return m["xref_repaired"].isNotNull() | m["repair_method"].isNotNull() | F.coalesce(m["pdf_open"].contains("repair"), F.lit(False))


def ingest_report(pages: DataFrame) -> DataFrame:
    """One row: files by outcome, pages, mean confidence, repairs and pages by extension. No pages: a row of zeros."""
    by_file = pages.groupBy("path").agg(
        F.bool_and(~_failed()).alias("ok"),
        F.count(F.lit(1)).alias("pages"),
        F.count_if("ocr_used").alias("ocr"),
        F.sum(F.col("extraction_confidence").cast("double")).alias("confidence"),
        F.count_if(_repaired()).alias("repairs"),
    )
    by_ext = by_file.groupBy(extension(F.col("path")).alias("ext")).agg(
        F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("files"), F.sum("pages").alias("pages"), F.sum("ocr").alias("ocr"), F.sum("confidence").alias("confidence"), F.sum("repairs").alias("repairs")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    n = zero("pages")
    return by_ext.agg(
        zero("ok").alias("files_ok"),
        (zero("files") - zero("ok")).alias("files_failed"),
        n.alias("pages_total"),
        zero("ocr").alias("pages_ocr"),
        (F.coalesce(F.sum("confidence"), F.lit(0.0)) / F.greatest(n, F.lit(1))).cast("float").alias("avg_confidence"),
        zero("repairs").alias("repair_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "pages")))).alias("by_extension"),
    )


def doctor(pages: DataFrame) -> DataFrame:
    """By extension: files, files that failed, pages with fewer than five characters."""
    rows = pages.select("path", extension(F.col("path")).alias("extension"), _failed().alias("bad"), (F.length(trim(F.col("content"))) < 5).alias("sparse"))
    files = rows.groupBy("extension", "path").agg(F.bool_or("bad").alias("bad"), F.count_if("sparse").alias("sparse"))
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.count_if("bad").alias("broken_files"), F.sum("sparse").alias("sparse_pages"))


def chars_by_file(pages: DataFrame) -> DataFrame:
    return pages.groupBy("path").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("content")).alias("chars"))


def totals(pages: DataFrame) -> DataFrame:
    """Pages, chunks and hits of personal data of a run."""
    hits = F.coalesce(F.try_element_at("metadata", F.lit("pii_redacted")).cast("long"), F.lit(0))
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(hits), F.lit(0)).alias("pii_hits"))
