"""The corpus pipeline: documents through quality, near-duplicates, decontamination, personal data and mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``docs``. Stages are
written as Parquet in the shared folder and reread, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, mixing, near_dup, pii, quality_model
from folioflow.llm.common import drop_dir, own_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    params = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.classify(docs, params, out="__quality").where("__quality.predicted = 1").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), out="__leaks").where(F.size("__leaks") == 0).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks; n_chars follows the text."""
    found = pii.detect(docs, out="__pii")
    new = {"text": F.col("__pii.redacted"), "n_chars": F.length("__pii.redacted").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words, repeats counted."""
    return mixing.mix(docs, out="__mix").select(*docs.columns, "__mix.*").where("taken > 0")


STAGES = [("quality", quality), ("near_dup", dedup), ("decontamination", decontamination), ("pii", private), ("mixing", mixture)]

#: The trained and iterative stages can't be said in SQL; tests/llm/test_pipeline.py has a plain version of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at, before = table(spark, sf_dir, "documents"), own_dir(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        # what a written stage was made from isn't needed any more
        if before:
            drop_dir(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
