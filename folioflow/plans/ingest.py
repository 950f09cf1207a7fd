"""The public plan: a directory of files to pages, texts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import chunking, pii, vectors
from folioflow.operators import cache as caching
from folioflow.operators import pages as page_ops
from folioflow.operators import report
from folioflow.plans.options import Options
from folioflow.sources import files as sources
from folioflow.sources.backends import Embedder, HashingEmbedder, pdf_backend


def _chunked(pages: DataFrame, o: Options, embedder: Embedder | None) -> DataFrame:
    if not o.chunk_pages:
        whole = F.when(F.col("content") != "", F.array("content")).otherwise(F.array().cast("array<string>"))
        pages = pages.withColumn("chunks", whole)
    elif o.doc_chunking:
        dealt = chunking.document_chunks(pages.select("path", "page_index", "content"), o.chunk_size)
        pages = pages.join(dealt, ["path", "page_index"])
    elif o.use_embeddings:
        pages = _semantic(pages, o, embedder or HashingEmbedder())
    elif o.fast_chunk:
        pages = chunking.fast_chunks(pages, "content", o.chunk_size)
    else:
        pages = pages.withColumn("chunks", chunking.structural(F.col("content"), o.chunk_size))
    if o.child_chunk_size:
        pages = chunking.child_chunks(pages, o.child_chunk_size, bool(o.fast_chunk))
    return pages


def _semantic(pages: DataFrame, o: Options, embedder: Embedder) -> DataFrame:
    """Tables stay whole; runs of sentences are cut where neighbours differ."""
    from folioflow.functions.text import fenced
    from folioflow.sources.backends import similarities

    key = ["path", "page_index"]
    parts = chunking.units(pages.select(*key, "content"), "content", key)
    by = W.partitionBy(*key).orderBy("unit_index")
    block = F.sum(F.when(F.col("is_table") | F.coalesce(F.lag("is_table").over(by), F.lit(False)), 1).otherwise(0)).over(by)
    parts = parts.withColumn("block", block)
    runs = parts.where(~F.col("is_table")).groupBy(*key, "block").agg(F.sort_array(F.collect_list(F.struct("unit_index", "unit"))).alias("u"))
    runs = fenced(runs.withColumn("sentence", F.transform("u", lambda x: x["unit"])), "sentence")
    runs = fenced(runs.withColumn("sim", similarities(F.col("sentence"), embedder)), "sim")
    cut = runs.select(*key, "block", vectors.cut_chunks(F.arrays_zip("sentence", "sim"), o.chunk_size).alias("chunks"))
    cut = cut.unionByName(parts.where("is_table").select(*key, "block", F.array("unit").alias("chunks")))
    whole = cut.groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "chunks"))), lambda x: x["chunks"])).alias("chunks"))
    return pages.join(whole, key, "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def pages_of(spark: SparkSession, files: DataFrame, large: DataFrame | None, o: Options, pdf=None, ocr=None, decode=None, embedder: Embedder | None = None, tables=None) -> DataFrame:
    """Files (path, length, modificationTime, content, ext) to finished pages."""
    broken = None
    if o.ingest_archives:
        files, broken = sources.expand(files)
    pdf_options = {"password": o.pdf_password, "max_pages": o.max_pages, "repair": o.repair_pdf, "level": o.repair_level, "multi_column": o.layout_mode == "multi_column"}
    if o.use_ocr:
        pdf_options["recognition"] = {"use_ocr": True, "mode": o.ocr_mode, "strategy_ocr": o.strategy == "ocr", "ocr": ocr, "scale": o.ocr_render_scale}
    if o.use_vlm:
        pdf_options["tables"] = tables
    engine = pdf or pdf_backend(o.backend)
    raw = sources.raw_pages(files, engine, pdf_options, ocr if o.use_ocr else None, decode)
    bad = None if large is None else page_ops.error_pages(large, F.lit("file is too large"))
    if broken is not None:
        failed = page_ops.error_pages(broken, F.col("error"))
        bad = failed if bad is None else bad.unionByName(failed)
    pages = _chunked(raw, o, embedder)
    if bad is not None:
        pages = pages.unionByName(bad, allowMissingColumns=True)
        for name, empty in (("chunks", "array<string>"), ("metadata", "map<string,string>"), ("form_fields", "map<string,string>")):
            value = F.create_map().cast(empty) if empty.startswith("map") else F.array().cast(empty)
            pages = pages.withColumn(name, F.coalesce(name, value))
        if "child_chunks" in pages.columns:
            pages = pages.withColumn("child_chunks", F.coalesce("child_chunks", F.array().cast("array<struct<text:string,parent_index:int>>")))
        pages = pages.withColumns({"ocr_used": F.coalesce("ocr_used", F.lit(False)), "width": F.coalesce("width", F.lit(0)), "height": F.coalesce("height", F.lit(0))})
    return page_ops.finish(pages, o.pii_mode)


def ingest(spark: SparkSession, directory: str, cache_dir: str | None = None, pdf=None, ocr=None, decode=None, embedder: Embedder | None = None, tables=None, **options) -> DataFrame:
    """Pages of all supported files below ``directory``, lazily; see Options for what can be set."""
    o = Options.of(**options)
    files, large = sources.load(spark, directory, o.pattern, o.ingest_archives)
    if not o.use_cache or cache_dir is None:
        return pages_of(spark, files, large, o, pdf, ocr, decode, embedder, tables)
    return _with_cache(spark, files, large, o, cache_dir, pdf, ocr, decode, embedder, tables)


def _with_cache(spark, files, large, o: Options, cache_dir: str, pdf, ocr, decode, embedder, tables) -> DataFrame:
    """Files whose path and content were read before with the same options come from the table at ``cache_dir``."""
    keyed = caching.with_key(files.withColumn("__pc", F.concat(F.col("path").cast("binary"), F.lit(b"\x00"), "content")), "__pc", o.result_options()).drop("__pc")
    stored = None
    try:
        stored = spark.read.parquet(cache_dir)
        stored.schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    missing = keyed if stored is None else keyed.join(stored.select("cache_key").distinct(), "cache_key", "left_anti")
    fresh = pages_of(spark, missing.drop("cache_key"), None, o, pdf, ocr, decode, embedder, tables)
    if not o.ingest_archives:
        fresh = fresh.join(missing.select("path", "cache_key"), "path")
    else:
        fresh = fresh.withColumn("__p", F.substring_index("path", "!/", 1)).join(missing.select(F.col("path").alias("__p"), "cache_key"), "__p").drop("__p")
    fresh.write.mode("append").parquet(cache_dir)
    got = spark.read.parquet(cache_dir).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
    # a run that was tried again, or ran beside another, may have stored the same pages twice
    got = got.dropDuplicates(["cache_key", "path", "page_index"]).drop("cache_key")
    bad = page_ops.finish(page_ops.error_pages(large, F.lit("file is too large")))
    return got.unionByName(bad)


def ingest_text(spark: SparkSession, directory: str, pii_mode: str = "off", **options) -> DataFrame:
    """The texts alone, in the order of path and page; nothing else is computed."""
    pages = ingest(spark, directory, pii_mode=pii_mode, chunk_pages=False, **options)
    return pages.orderBy("path", "page_index").select("content")


def sanitize_pii(spark: SparkSession, text: str, mode: str = "redact") -> tuple[str, int, list[str]]:
    """(text, hits, kinds) of one text."""
    r = pii.sanitize(spark.createDataFrame([(text,)], "t string"), "t", mode).first()["pii"]
    return r["text"], r["n"], list(r["types"])


def build_ingest_report(pages: DataFrame) -> dict:
    return report.ingest_report(pages).first().asDict(recursive=True)


def register_functions(spark: SparkSession) -> None:
    """Makes the text functions that SQL users want: structural_chunks(text), flatten_json(text), redact_pii(text)."""
    import json

    from folioflow.sources.parsers import flatten

    def flat(t: str | None) -> str | None:
        try:
            return None if t is None else flatten(json.loads(t))
        except ValueError:
            return None

    spark.udf.register("structural_chunks", chunking.structural_udf())
    spark.udf.register("flatten_json", F.pandas_udf(lambda s: s.map(flat), "string", functionType=F.PandasUDFType.SCALAR))
    body = "t"
    for i, (k, _, _) in enumerate(pii.KINDS):
        p = pii.pattern(k).replace("'", "''")
        # a lambda's variable, as the text so far is named twice
        body = f"transform(array({body}), x{i} -> CASE WHEN rlike(t, r'{p}') THEN regexp_replace(x{i}, r'{p}', '[{k}_REDACTED]') ELSE x{i} END)[0]"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION redact_pii(t STRING) RETURNS STRING RETURN {body}")
