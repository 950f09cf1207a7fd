"""Continuous ingestion: the batch plan on a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.text import extension
from folioflow.operators import report
from folioflow.plans.ingest import pages_of
from folioflow.plans.options import Options
from folioflow.sources.files import MOST_BYTES
from folioflow.sources.formats import SUPPORTED

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, directory: str, archives: bool = False, files_by_batch: int = 1000) -> DataFrame:
    """New supported files below a directory. Files without a byte make no rows here."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_by_batch).load(directory)
    wanted = SUPPORTED if archives else SUPPORTED - {"zip"}
    return raw.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*sorted(wanted)))


def ingest_stream(spark: SparkSession, directory: str, out_dir: str, checkpoint: str, once: bool = True, embedder=None, **options) -> StreamingQuery:
    """Appends the pages of new files to Parquet at ``out_dir``.

    Each batch writes to a folder of its own number, so a batch that is done again after a failure replaces what it
    had written.
    """
    o = Options.of(**options)

    def write(batch: DataFrame, number: int) -> None:
        pages = pages_of(spark, batch.where(F.col("length") <= MOST_BYTES), batch.where(F.col("length") > MOST_BYTES), o, embedder=embedder)
        pages.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    stream = file_stream(spark, directory, o.ingest_archives).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()


def report_stream(files: DataFrame, watermark: str = "1 hour", window: str = "10 minutes", time: str = "modificationTime") -> DataFrame:
    """The files of a ``file_stream`` by window of time and extension, with late rows up to the watermark."""
    rows = files.withWatermark(time, watermark)
    return rows.groupBy(F.window(time, window), extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def report_of(spark: SparkSession, out_dir: str) -> DataFrame:
    """The run report over all that a stream has written."""
    return report.ingest_report(spark.read.parquet(out_dir))
