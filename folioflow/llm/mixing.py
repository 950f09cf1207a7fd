"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the mix by weight; a target stops at ``max_epochs`` times the source's size and what it
can't use goes to the others by weight. A source is taken whole as often as its target holds it (complete epochs);
the rest comes from an order without replacement in which a document of weight w has the key -ln(u)/w, u being a
hash of its id: the smallest keys whose running size fits the rest. The document on the boundary is taken if that
brings the source nearer to its target.

Plan: one aggregate by source (partial sums, so a hot source is no hot task), the targets over the source rows,
and a running sum in two levels: every source is cut into key ranges of equal width on the scale of the keys' logarithm, where a
common factor of all weights only shifts them, so that a hot source is summed by many tasks; only the ranges' totals are summed
by source. There are more ranges the more rows there are: one holds about ``BIN_ROWS`` at most. Where the text isn't passed on,
sizes and keys are stored and every text is split once. No user functions.

Defined results. Null text: size 0, takes 0. Null source: a source of its own, last in the order of weights.
Ties: equal keys are ordered by id, then size; rows equal in all of them share their order, whichever comes first
(the multiset of results is the same). Weights may be any positive numbers on any scale; null ones and such as aren't
positive and finite count as 1. Empty table: empty result. Columns of the input with any names are passed on; the operator's own sit in the struct ``out``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, cut, table, words

SHARE = 1.5
MAX_EPOCHS = 2
WEIGHTS = (5, 2, 1)
#: Key ranges for each unit of the keys' logarithm at least, and the rows of one range beyond which there are more of them.
BINS, BIN_ROWS = 128, 1_000_000
#: Rows of (source, key range) up to which they are broadcast; about 100 bytes each.
BROADCAST_ROWS = 100_000
SEED = "mix-1"


def _uniform(key: Column) -> Column:
    """In (0, 1), from the first 13 hex digits of a digest."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (h.cast("long") + F.lit(0.5)) / F.lit(float(16**13))


def targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to the same and ``target``: one row per source, so these windows are small.

    Sources that stop at their limit are a prefix in the order of limit by weight; the first prefix after which the
    next source stays under its limit is the answer of resharing the excess until none is above.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    s = sizes.withColumn("w", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    s = s.withColumn("cap", F.lit(max_epochs).cast("long") * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    s = s.withColumn("left_w", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
    everything = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (F.lit(share) * everything - F.col("capped")) / F.col("left_w"))
    # the level at the first source that isn't above its limit; none: all stop
    open_ = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c"), F.col("level").alias("level")))
    s = s.withColumn("final", F.min(open_).over(W.partitionBy())["level"])
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def lexical_weight(ws: Column) -> Column:
    """A quality weight in [1, 4] by the share of distinct words; texts without words weigh 1."""
    n = F.size(ws)
    return F.when(n > 0, 1.0 + 3.0 * F.size(F.array_distinct(ws)) / n).otherwise(F.lit(1.0))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
    out: str = "mix",
    bins: int | None = None,
    keep: list[str] | None = None,
    **how,
) -> DataFrame:
    """All columns of ``docs``, or those to ``keep``, and a struct ``out`` of size, source_size, target and taken (words, repeats counted).

    ``weight`` names a column of quality weights; without one, ``lexical_weight`` of the text is used.
    """
    names = {c: f"__in{i}" for i, c in enumerate(docs.columns)}
    keep = docs.columns if keep is None else keep
    # at most 4 in 1000 rows of a source have keys within a 1/BINS of the scale
    bins = bins or max(BINS, math.ceil(BINS * 0.004 * docs.count() / BIN_ROWS))
    ws = words(F.col(names[text]))
    rows = docs.toDF(*names.values())
    rows = rows.withColumn("__words", ws)
    w = lexical_weight(F.col("__words"))
    if weight:
        given = F.col(names[weight]).cast("double")
        w = F.when((given > 0) & (given < float("inf")), given).otherwise(1.0)
    rows = rows.withColumns({"size": F.size("__words").cast("long"), "key": -F.log(_uniform(F.col(names[id_col]))) / w}).drop("__words")
    rows = rows.withColumns({"__s": F.col(names[source]).cast("string"), "__b": F.floor(F.log("key") * bins).cast("long")})
    if text not in keep:
        rows = cut(rows.select(*{names[c]: None for c in [*keep, id_col]}, "size", "key", "__s", "__b"))

    # one pass over the texts: sizes by source and key range, in reliable storage as both later steps read them
    fine = cut(rows.groupBy("__s", "__b").agg(F.sum("size").alias("bin_size")))
    sized = fine.groupBy(F.col("__s").alias("source")).agg(F.sum("bin_size").alias("source_size"))
    t = targets(sized, **how)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = W.partitionBy("__s").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0).cast("long")))
    fine = fine.join(t, F.col("__s").eqNullSafe(F.col("source"))).select(
        F.col("__s").alias("__fs"), F.col("__b").alias("__fb"), "before", "source_size", "target", "epochs", "rest"
    )
    fine = cut(fine)
    small = fine.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(fine) if small else fine, F.col("__s").eqNullSafe(F.col("__fs")) & (F.col("__b") == F.col("__fb")))

    inside = W.partitionBy("__s", "__b").orderBy("key", names[id_col], "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.col("before") + F.sum("size").over(inside))
    over, under = F.col("end") - F.col("rest"), F.col("rest") - (F.col("end") - F.col("size"))
    picked = (over <= 0) | (over < under)
    taken = F.col("size") * (F.col("epochs") + F.when(picked, 1).otherwise(0))
    digest = F.struct("size", "source_size", "target", taken.cast("long").alias("taken"))
    return rows.select(*[F.col(names[c]).alias(c) for c in keep], digest.alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"]).select("doc_id", "mix.*")


#: Continues a common table expression ``docs`` (doc_id, text, source).
MIX_SQL = rf"""
r AS (SELECT doc_id, source, coalesce(regexp_extract_all(text, '{WORD}'), []) AS ws FROM docs),
k AS (SELECT doc_id, source, len(ws)::BIGINT AS size,
    CASE WHEN len(ws) > 0 THEN 1.0::DOUBLE + 3.0::DOUBLE * len(list_distinct(ws)) / len(ws) ELSE 1.0::DOUBLE END AS w,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / {16**13}::DOUBLE AS u FROM r),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS sw, {MAX_EPOCHS} * source_size AS cap FROM s0),
s2 AS (SELECT *, cap::DOUBLE / sw AS lim,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / sw, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    (sum(sw) OVER (ORDER BY cap::DOUBLE / sw, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_w,
    (sum(source_size) OVER ())::BIGINT AS everything FROM s1),
s3 AS (SELECT *, ({SHARE}::DOUBLE * everything - capped) / left_w AS level FROM s2),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE level * sw <= cap ORDER BY lim, encode(source) NULLS LAST LIMIT 1) AS final FROM s3),
s5 AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, final * sw), cap::DOUBLE) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s5),
e AS (SELECT k.doc_id, k.size, s6.source_size, s6.target, s6.epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY -ln(u) / w, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
    FROM k JOIN s6 ON k.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN e <= rest OR e - rest < rest - (e - size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""
SQL = f"WITH docs AS (SELECT doc_id, text, source FROM documents),{MIX_SQL}"
