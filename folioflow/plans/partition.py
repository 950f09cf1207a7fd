"""Directories and single documents as typed elements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from folioflow.functions.elements import elements
from folioflow.plans.ingest import ingest


def partition(spark: SparkSession, directory: str, strategy: str = "fast", pattern: str | None = None, split: bool = True, **options) -> DataFrame:
    """The elements of all files below a directory; nothing is cached unless ``use_cache`` asks for it."""
    return elements(ingest(spark, directory, strategy=strategy, pattern=pattern, chunk_pages=False, **options), split)


def partition_pdf(spark: SparkSession, filename: str, strategy: str = "fast", **options) -> DataFrame:
    """The elements of one file."""
    folder, _, name = filename.rpartition("/")
    return partition(spark, folder or ".", strategy, f"^{re.escape(name)}$", **options)
