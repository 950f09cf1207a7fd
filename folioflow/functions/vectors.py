"""Vectors: cosine similarity and chunking where neighbours differ, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIMILAR = 0.65


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))


def adjacent(df: DataFrame, order: str, vector: str, key: list[str], out: str = "similarity") -> DataFrame:
    """Each row's similarity to the one before it with the same key; null at the first. Keys spread the work, so there is no form without."""
    before = F.lag(vector).over(W.partitionBy(*key).orderBy(order))
    df = df.withColumn("__before", before)
    return df.withColumn(out, F.when(F.col("__before").isNotNull(), cosine(F.col("__before"), F.col(vector)))).drop("__before")


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors of one length."""
    n = F.size(vectors)
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda acc, v: F.zip_with(acc, v, lambda a, x: a + x.cast("double")))
    return F.transform(total, lambda x: x / n)


def mean_by(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """(key, i, x): the mean vector of each key by element. Sums are partial, so no group is gathered."""
    return df.select(*key, F.posexplode(vector).alias("i", "x")).groupBy(*key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))


def semantic_chunks(sentences: DataFrame, key: list[str], size: int, threshold: float = SIMILAR) -> DataFrame:
    """Rows (key, i, sentence, embedding) to (key, chunks): a chunk ends where neighbours differ or it would exceed ``size``.

    The size resets at each cut, so the fold is sequential within a document; documents are independent.
    """
    rows = adjacent(sentences, "i", "embedding", key, "sim")
    docs = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "sentence", "sim"))).alias("s"))
    return docs.select(*key, cut_chunks(F.col("s"), size, threshold).alias("chunks"))


def cut_chunks(parts: Column, size: int, threshold: float = SIMILAR) -> Column:
    """Chunks of an array of structs (sentence, sim), sim being a sentence's similarity to the one before it."""
    mark = "﷐"

    def step(acc: Column, x: Column) -> Column:
        n = F.octet_length(acc["now"]) + F.octet_length(x["sentence"]) + 1
        cut = (acc["now"] != "") & ((F.coalesce(x["sim"], F.lit(0.0)) < threshold) | (n > size))
        done = F.when(cut, F.concat(acc["done"], acc["now"], F.lit(mark))).otherwise(acc["done"])
        now = F.when(cut | (acc["now"] == ""), x["sentence"]).otherwise(F.concat(acc["now"], F.lit(" "), x["sentence"]))
        return F.struct(done.alias("done"), now.alias("now"))

    whole = F.aggregate(parts, F.struct(F.lit("").alias("done"), F.lit("").alias("now")), step, lambda acc: F.concat(acc["done"], acc["now"]))
    return F.filter(F.split(whole, mark), lambda c: c != "")
