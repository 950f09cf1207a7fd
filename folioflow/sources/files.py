"""Files to pages: listing, archive expansion, and one plan of native and Python branches.

Names are listed before contents are read: filters on path and size pick the files, and their contents are loaded by a
second scan of the picked paths, so the bytes of rejected files are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import extension
from folioflow.operators import pages as page_ops
from folioflow.sources import native
from folioflow.sources.formats import IMAGES, LEGACY, SUPPORTED
from folioflow.sources.parsers import PARSERS, expand_zip, parse

#: Larger files become error pages; a row of content can't exceed 2 GB.
MOST_BYTES = 1 << 30
#: Paths that are handed to a scan by name; beyond it the whole directory is scanned and joined.
MOST_PATHS = 100_000


def listing(spark: SparkSession, directory: str, pattern: str | None = None, archives: bool = False) -> DataFrame:
    """(path, length, modificationTime, ext) of supported files below a directory; ``pattern`` is searched in their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "length", "modificationTime")
    files = files.withColumn("ext", extension(F.col("path")))
    wanted = SUPPORTED if archives else SUPPORTED - {"zip"}
    files = files.where(F.col("ext").isin(*sorted(wanted)))
    if pattern:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return files


def empty_files(spark: SparkSession, directory: str) -> DataFrame:
    """Files without a byte, which scans leave out: those that the scan's own index lists and its rows lack."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    listed = [re.sub("^file:/+", "file:/", unquote(p)) for p in scan.inputFiles()]
    rows = spark.createDataFrame([(p,) for p in listed], "path string").join(scan.select("path"), "path", "left_anti") if len(listed) > scan.select("path").count() else scan.select("path").where("false")
    return rows.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"), extension(F.col("path")).alias("ext"))


def load(spark: SparkSession, directory: str, pattern: str | None = None, archives: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files with ``content``, files that are too large)."""
    wanted = F.col("ext").isin(*sorted(SUPPORTED if archives else SUPPORTED - {"zip"}))
    if pattern:
        wanted = wanted & F.element_at(F.split("path", "/"), -1).rlike(pattern)
    files = listing(spark, directory, pattern, archives)
    large = files.where(F.col("length") > MOST_BYTES)
    raw, picked = spark.read.format("binaryFile").option("recursiveFileLookup", "true"), directory
    if pattern:
        names = [r["path"] for r in files.where(F.col("length") <= MOST_BYTES).select("path").limit(MOST_PATHS + 1).collect()]
        if names and len(names) <= MOST_PATHS:
            raw, picked = spark.read.format("binaryFile"), names
    found = raw.load(picked).where(F.col("length") <= MOST_BYTES).withColumn("ext", extension(F.col("path")))
    return found.unionByName(empty_files(spark, directory)).where(wanted), large


def expand(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with archive members in place of archives, archives or members that failed with ``error``).

    Members keep their path inside the archive, so equal names don't collide; they are spread over the tasks again, as
    one large archive would else be one task's work.
    """
    schema = "path string, length long, modificationTime timestamp, content binary, ext string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    members = expand_zip(bytes(r.content)) or [("", None, "archive holds nothing supported")]
                except Exception as e:
                    members = [("", None, f"ZIP: {type(e).__name__}: {e}")]
                for name, data, error in members:
                    path = f"{r.path}!/{name}" if name else r.path
                    ext = name.rpartition(".")[2].lower() if name else "zip"
                    yield pd.DataFrame([(path, len(data or b""), r.modificationTime, data, ext, error)], columns=["path", "length", "modificationTime", "content", "ext", "error"])

    columns = ["path", "length", "modificationTime", "content", "ext"]
    zipped = files.where("ext = 'zip'").select(*columns).mapInPandas(run, schema)
    members = zipped.where("error is null").select(*columns).repartition(F.col("path"))
    return files.where("ext <> 'zip'").select(*columns).unionByName(members), zipped.where("error is not null").select("path", "error")


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples(index=False):
            pages, error = parse(r.ext, bytes(r.content))
            rows = [(r.path, i, text, label, None) for i, (label, text) in enumerate(pages)] or [(r.path, 0, "", None, error)]
            yield pd.DataFrame(rows, columns=["path", "page_index", "content", "label", "error"]).astype({"page_index": "int32"})


def raw_pages(files: DataFrame, pdf=None, pdf_options: dict | None = None, ocr=None, image=None) -> DataFrame:
    """Files (path, content, ext) to pages before assembly: path, page_index, content, metadata, form_fields, error, warnings, ocr_used, width, height."""
    e, c = F.col("ext"), F.col("content")
    own = files.where(e.isin(*sorted(native.NATIVE)))
    failed = native.native_error(e, c)
    simple = own.select("path", F.lit(0).alias("page_index"), F.when(failed.isNull(), native.native_text(e, c)).otherwise("").alias("content"), F.lit(None).cast("string").alias("label"), failed.alias("error"), e.alias("ext"))
    parsed = files.where(e.isin(*sorted(PARSERS))).select("path", "content", "ext").mapInPandas(_parsed, "path string, page_index int, content string, label string, error string").withColumn("ext", extension(F.col("path")))
    old = files.where(e.isin(*sorted(LEGACY))).select("path", F.lit(0).alias("page_index"), F.lit(native.LEGACY_TEXT).alias("content"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("error"), e.alias("ext"))
    office = simple.unionByName(parsed).unionByName(old)
    warnings = F.array_compact(F.array(F.when(F.col("error").isNotNull(), "pdf_open_failed"), F.when(F.col("ext").isin(*sorted(LEGACY)), "legacy_office_deferred")))
    office = office.withColumns({"metadata": page_ops.label_metadata(F.col("ext"), F.col("label")), "warnings": warnings})
    office = office.withColumns({"form_fields": F.create_map().cast("map<string,string>"), "ocr_used": F.lit(False), "width": F.lit(0), "height": F.lit(0)}).drop("label", "ext")
    return office.unionByName(pdf_pages(files.where("ext = 'pdf'"), pdf, **(pdf_options or {}))).unionByName(image_pages(files.where(e.isin(*sorted(IMAGES))), ocr, image))


_OUT = "path string, page_index int, content string, metadata map<string,string>, form_fields map<string,string>, error string, warnings array<string>, ocr_used boolean, width int, height int"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def pdf_pages(files: DataFrame, backend=None, password: str | None = None, max_pages: int | None = None, repair: bool = False, level: str = "normal", multi_column: bool = False, recognition: dict | None = None, tables=None) -> DataFrame:
    """Pages of PDFs by the backend; a file that can't be opened is one error page.

    Pages whose glyphs overlap are of a complex layout: with a table detector they get its tables. ``recognition`` holds the
    options of ``recognise``; without it no page is read by its image, though garbled pages are still told.
    """
    from folioflow.operators.recognition import IMAGE, recognise
    from folioflow.sources.backends import open_pdf, pdf_backend

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from folioflow.operators.layout import detected_tables, is_complex, page_text

        engine = backend or pdf_backend()
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                doc, how = open_pdf(bytes(content), engine, password, max_pages, repair, level)
                if doc is None or not doc.pages:
                    error = how.get("pdf_error", "no text could be read")
                    yield pd.DataFrame([(path, 0, "", how, {}, error, ["pdf_open_failed"], False, 0, 0, False, None, "")], columns=names)
                    continue
                rows = []
                for i, p in enumerate(doc.pages):
                    glyphs = pd.DataFrame(p.glyphs, columns=["c", "left", "right", "top", "bottom"])
                    t = page_text(glyphs) if multi_column and p.glyphs else p.text
                    crowded = is_complex([g[1:] for g in p.glyphs])
                    found = detected_tables(tables, p.image, glyphs) if tables is not None and crowded and p.image is not None else ""
                    image = None if p.image is None or not recognition else {"rgb": np.ascontiguousarray(p.image, np.uint8).tobytes(), "height": p.image.shape[0], "width": p.image.shape[1]}
                    rows.append((path, i, t, {"source_type": "pdf", **how, **doc.metadata}, doc.form_fields, None, [], False, p.width, p.height, crowded, image, found))
                yield pd.DataFrame(rows, columns=names)

    extra = f"layout_complex boolean, image {IMAGE}, tables string"
    names = [*_NAMES, "layout_complex", "image", "tables"]
    raw = files.select("path", "content").mapInPandas(run, f"{_OUT}, {extra}")
    read = recognise(raw, **(recognition or {"use_ocr": False}))
    whole = F.when(F.col("tables") != "", F.concat("content", F.lit("\n\n### VLM Extracted:\n"), "tables", F.lit("\n\n"))).otherwise(F.col("content"))
    return read.withColumn("content", whole).select(*_NAMES)


def image_pages(files: DataFrame, ocr=None, decode=None) -> DataFrame:
    """A page by image: recognised text if there is a recogniser and a decoder, else an empty page that says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                text, error, notes, size = "", None, ["image_without_ocr"], (0, 0)
                if ocr is not None and decode is not None:
                    try:
                        rgb = decode(bytes(content))
                        text, notes, size = ocr.read(rgb), [], (int(rgb.shape[1]), int(rgb.shape[0]))
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(path, 0, text, {"source_type": "image"}, {}, error, notes, bool(text), *size)], columns=_NAMES)

    return files.select("path", "content").mapInPandas(run, _OUT)
