"""Assembly of page rows: personal data, sizes, density, confidence, language and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import pii, text

_STRINGS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())
_CHILDREN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("parent_index", T.IntegerType())]))

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("page_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("chunks", _STRINGS),
        T.StructField("child_chunks", _CHILDREN),
        T.StructField("metadata", _MAP),
        T.StructField("form_fields", _MAP),
        T.StructField("num_chunks", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("extraction_confidence", T.FloatType()),
        T.StructField("ocr_used", T.BooleanType()),
        T.StructField("text_density", T.FloatType()),
        T.StructField("warnings", _STRINGS),
        T.StructField("language", T.StringType()),
    ]
)
PAGE_COLUMNS = tuple(PAGE_SCHEMA.names)


def _defaults() -> dict[str, Column]:
    return {
        "chunks": F.array().cast(_STRINGS),
        "child_chunks": F.array().cast(_CHILDREN),
        "metadata": F.create_map().cast(_MAP),
        "form_fields": F.create_map().cast(_MAP),
        "error": F.lit(None).cast("string"),
        "ocr_used": F.lit(False),
        "warnings": F.array().cast(_STRINGS),
        "width": F.lit(0),
        "height": F.lit(0),
    }


def _put(m: Column, **entries: Column) -> Column:
    """The map with entries that aren't null; a later value of a key wins."""
    for key, value in entries.items():
        m = F.when(value.isNotNull(), F.map_concat(_without(m, key), F.create_map(F.lit(key), value.cast("string")))).otherwise(m)
    return m


def _without(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def finish(pages: DataFrame, pii_mode: str = "off") -> DataFrame:
    """Pages (path, page_index, content and any of the optional columns) with every column of the page schema.

    The mode rewrites content, chunks and child chunks; hits are counted in the content. Columns beyond the schema are
    kept behind it.
    """
    extra = [c for c in pages.columns if c not in PAGE_COLUMNS and c not in ("width", "height")]
    for name, value in _defaults().items():
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    pages = pages.withColumn("content", F.coalesce("content", F.lit("")))
    mode = pii.mode_of(pii_mode)
    if mode != "off":
        pages = pii.sanitize(pages, "content", mode, "__pii")
        hit = F.when(F.col("__pii.n") > 0, F.col("__pii.n").cast("string"))
        pages = pages.withColumns(
            {
                "content": F.col("__pii.text"),
                "chunks": F.transform("chunks", lambda c: pii.sanitized(c, mode)),
                "child_chunks": F.transform("child_chunks", lambda c: F.struct(pii.sanitized(c["text"], mode).alias("text"), c["parent_index"].alias("parent_index"))),
                "metadata": _put(F.col("metadata"), pii_redacted=hit, pii_types=F.when(hit.isNotNull(), F.array_join("__pii.types", ","))),
            }
        ).drop("__pii")
    n = F.octet_length("content")
    pages = pages.withColumns({"text_density": text.text_density(n, F.col("width"), F.col("height")), "num_chunks": F.size("chunks")})
    pages = pages.withColumns(
        {
            "extraction_confidence": text.confidence(n, F.col("text_density"), F.col("ocr_used"), F.col("error").isNotNull()),
            "language": text.language_hint(F.col("content")),
            "metadata": _put(F.col("metadata"), ocr_used=F.when(F.col("ocr_used"), F.lit("true")), page_error=F.col("error")),
        }
    )
    return pages.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAGE_SCHEMA], *extra)


def error_pages(files: DataFrame, message: Column, warning: str = "pdf_open_failed") -> DataFrame:
    """One empty page for each file that failed."""
    return files.select("path", F.lit(0).alias("page_index"), F.lit("").alias("content"), message.alias("error"), F.array(F.lit(warning)).alias("warnings"))


def label_metadata(ext: Column, label: Column) -> Column:
    """The source type and, by kind of file, the sheet, slide or chapter that a page's label names."""
    base = F.create_map(F.lit("source_type"), ext)
    key = F.when(ext.isin("xlsx", "xls", "ods"), "sheet").when(ext.isin("pptx", "odp"), "slide").when(ext == "epub", "chapter")
    return F.when(key.isNotNull() & label.isNotNull(), F.map_concat(base, F.create_map(F.coalesce(key, F.lit("-")), F.coalesce(label, F.lit(""))))).otherwise(base)
