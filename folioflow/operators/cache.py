"""Reuse of earlier results: a Parquet table keyed by content and options, looked up by equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(options: dict) -> str:
    """All options that change a result, in one order."""
    return ";".join(f"{k}={options[k]}" for k in sorted(options))


def with_key(df: DataFrame, content: str, options: dict, out: str = "cache_key") -> DataFrame:
    """Adds the key: SHA-256 of the options and the content, so a run with other options misses."""
    return df.withColumn(out, F.sha2(F.concat(F.lit(fingerprint(options) + "\x1f").cast("binary"), F.col(content).cast("binary")), 256))


def reuse(df: DataFrame, cache: DataFrame, compute, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(all results, new ones to append): hits come from the cache, ``compute`` runs on the misses alone.

    Both sides carry the key; the cache holds results only. The same content twice is computed once.
    """
    missing = df.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    fresh = compute(missing)
    results = cache.unionByName(fresh, allowMissingColumns=True)
    return df.select(key, *[c for c in df.columns if c != key and c not in results.columns]).join(results, key), fresh


def sentence_vectors(sentences: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sentences with cached vectors, those without): by hash and, against collisions, by the stored sentence."""
    keyed = sentences.withColumn("sentence_hash", F.xxhash64("sentence"))
    on = (F.col("s.sentence_hash") == F.col("c.sentence_hash")) & (F.col("s.sentence") == F.col("c.sentence"))
    hit = keyed.alias("s").join(cache.alias("c"), on).select("s.*", "c.embedding")
    return hit, keyed.alias("s").join(cache.alias("c"), on, "left_anti")
