"""Near-duplicate removal: BagMinHash signatures, banding, verified multiset overlap, connected groups.

Two texts are near copies if the weighted Jaccard similarity of their five-word shingle multisets is at least
``THRESHOLD``. Equal texts are one node from the start (the first 16 bytes of the SHA-256 of the text, then a dense number
given once and stored), so copies are never expanded. 24 bands of 6 rows let a pair at 0.8 slip with a probability of 7e-4, one
at 0.85 with 6e-6.

A bucket is never expanded into its pairs, capped or gathered in a task. In each round it has leaders, 1, then 16, 256 and
so on, and only members of another group than a leader's are compared with it; a leader then leaves the bucket, all its
links there being known. Links join groups, and a bucket is done when its members are of one group. So a bucket of near copies
costs about one comparison a member, and texts that share a bucket and are linked end in one group always. The first leader
is the least node, an aggregate with partial results; later ones are ranked behind a limit that Spark applies before it
shuffles; joins on a hot bucket are split by adaptive execution, for which both sides are stored tables and no aggregates. A bucket of texts that are *not* linked
does cost one comparison of 64-byte sketches for each two of them, in the rounds' portions; of those only pairs that may
match are ever stored.

A comparison first takes the sketches, one bit for each of 512 BagMinHash places, which settle pairs that are far apart
(five standard deviations under the threshold), then the shingle arrays of the two texts.
The arrays hold 32 bits of each shingle's hash: two texts of a thousand words take one shingle for another with
a probability of about 2e-4, which moves their similarity by 0.001 at most. Groups are found by spreading the least node over
the links with pointer jumping. What is reused lies in reliable checkpoints. Only tables whose rows were counted first are broadcast.

Defined results. A text of one to four words is one shingle; null texts and texts without words are never duplicates,
each row is its own class. Ids may be null or repeated: classes are of texts, a class takes its least id (null only if
it has no other), and of the texts with that id the least node is kept; ``deduplicate`` keeps one row of a class. Empty tables give empty results. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bagminhash as bag
from folioflow.llm.common import WORD, bounded_batches, cut, table

THRESHOLD = 0.8
#: Texts, and characters, that are worked on at once; a longer text is one batch.
BATCH_DOCS, BATCH_CHARS = 128, 1 << 20
BROADCAST_ROWS = 200_000
#: Places of a sketch, and five standard deviations of the similarity it tells at the threshold.
BITS = 512
DOUBT = 5 * 2 * (0.9 * 0.1 / BITS) ** 0.5


def _batches(texts: pd.Series) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t)
        if len(held) == BATCH_DOCS or chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _node(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The bucket keys of each text; none for texts without words."""
    for b in batches:
        out = []
        for part in _batches(b):
            sets = bag.shingle_sets(part)
            full = [s for s in sets if len(s)]
            keys = iter(bag.bands(bag.signatures(full)) if full else ())
            out += [next(keys) if len(s) else np.empty(0, np.int64) for s in sets]
        yield pd.Series(out, dtype="object")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What comparisons need of a text: the number of its shingles, their hashes and its sketch."""
    for b in batches:
        at = 0
        for part in _batches(b["text"]):
            sets = bag.shingle_sets(part)
            bits = np.packbits((bag.mix(bag.signatures(sets, BITS)) & np.uint64(1)).astype(bool), axis=1)
            yield pd.DataFrame({
                "num": b["num"].iloc[at : at + len(part)], "n": [len(s) for s in sets], "sketch": [x.tobytes() for x in bits],
                "grams": [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets],
            })
            at += len(part)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bag.similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """The similarity that two sketches tell: bits agree in all common places and in half of the others."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, BITS // 8) for c in (a, b))
    return pd.Series(1 - 2 * np.bitwise_count(x ^ y).sum(1) / BITS)


def _few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table for broadcast if its rows, counted now, are few."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _release(df: DataFrame) -> None:
    """Lets Spark's cleaner drop the shuffles and checkpoints that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _verify(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are linked. Both sides are joined by number; a text of very many pairs is split by adaptive execution."""
    left, right = grams.select(F.col("num").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("num").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(right, "b").join(left, "a").where(_similarity("ga", "gb") >= threshold)


def labels(members: DataFrame, grams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(num, label) of all linked texts that share a bucket; members are rows (bucket, num, first), first being the bucket's least."""
    known = grams.select("num", F.col("num").alias("label"), "n", "sketch")
    active, leaders_n, found = cut(members.join(known, "num")), 1, None
    while not active.isEmpty():
        lead = None
        if leaders_n == 1:
            leaders, others = active.where("num = first"), active.where("num <> first")
        else:
            counts = active.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
            # the largest group of a bucket leads nothing: the others are compared with it
            largest = counts.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("most")).select("bucket", F.col("most.label").alias("main"))
            largest = cut(largest)
            rank = F.row_number().over(W.partitionBy("bucket").orderBy("num"))
            leaders = cut(active.join(largest, "bucket").where("label <> main").withColumn("k", rank).where(F.col("k") <= leaders_n))
            lead = leaders.select("bucket", "num", F.lit(True).alias("leads"))
            others = active.join(lead, ["bucket", "num"], "left")
        leaders = leaders.select("bucket", F.col("num").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        both = others.join(leaders, "bucket").where("label <> la")
        if lead is not None:
            both = both.where("leads is null or a < num")
        # similarity is at most the ratio of the sizes
        near = both.where(F.least("n", "na") >= F.lit(threshold) * F.greatest("n", "na")).where(_estimate("sketch", "sa") >= threshold - DOUBT)
        ends = F.array_sort(F.array(F.struct(F.col("a").alias("x"), F.col("la").alias("l")), F.struct(F.col("num").alias("x"), F.col("label").alias("l"))))
        near = near.select(ends.alias("e")).select(F.col("e")[0]["x"].alias("a"), F.col("e")[1]["x"].alias("b"), F.col("e")[0]["l"].alias("la"), F.col("e")[1]["l"].alias("lb"))
        links = cut(_verify(near.distinct(), grams, threshold).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        joined = components(links)
        rest = others if lead is None else others.where("leads is null").drop("leads")
        if joined is not None:
            step = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
            rest = rest.join(step, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
            # a label is a number of its group, so the groups so far are relabelled and the new ones added
            found = joined if found is None else found.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(joined.join(found.select("node"), "node", "left_anti"))
            found = cut(found)
        open_ = rest.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
        open_ = cut(open_)
        active = cut(rest.join(open_, "bucket", "left_semi").select(active.columns))
        leaders_n *= 16
        # the round's shuffle files can go; they do once the driver has collected what stood for them
        del leaders, lead, others, both, near, links, joined, rest, open_
        _release(active)
    return found


def components(edges: DataFrame) -> DataFrame | None:
    """(node, label): the least node of each connected group, for the nodes of (a, b); None without edges."""
    if edges.isEmpty():
        return None
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        new = labels.join(spread, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(new.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
        # a step takes seconds, too short for the driver to drop by itself what the steps before it left
        del spread, jump
        _release(new)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(node, least_id, keeps) of every text that shares its class; one text of a class, the least by id and node, keeps."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    rows = rows.withColumn("node", _node(F.col("text")))
    sketched = rows.select("id", "node", F.pandas_udf(_bands, "array<long>")("text").alias("bands"))
    reps = sketched.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")).where(F.size("bands") > 0)
    reps = cut(reps.withColumn("num", F.monotonically_increasing_id()))
    members = reps.select("num", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("num").alias("first"), F.max("num").alias("last")).where("first < last").select("bucket", "first")
    members = cut(members.join(cut(shared), "bucket"))
    asked = cut(reps.join(members.select("num").distinct(), "num", "left_semi").select("num", F.col("node").alias("asked"), F.col("id").alias("rep")))
    few = _few(asked)
    texts = rows.join(few, (F.col("node") == F.col("asked")) & F.col("id").eqNullSafe(F.col("rep")))
    # an id may have its text more than once
    grams = cut(texts.select("num", "text").mapInPandas(_grams, "num long, n long, sketch binary, grams binary").dropDuplicates(["num"]))
    del few, shared, texts
    _release(grams)
    found = labels(members, grams, threshold)
    multi = reps.where("copies > 1").select("num", "node", F.col("id").alias("least_id"), F.lit(True).alias("keeps"))
    if found is None:
        return cut(multi.drop("num"))
    ids = found.withColumnRenamed("node", "num").join(reps.select("num", "node", "id"), "num")
    # null ids last; ids may repeat among the texts of a class, nodes don't
    group = ids.groupBy("label").agg(F.min(F.struct(F.isnull("id").alias("no"), "id", "node")).alias("least")).select("label", F.col("least.id").alias("least_id"), F.col("least.node").alias("keeper"))
    linked = ids.join(group, "label").select("num", "node", "least_id", (F.col("node") == F.col("keeper")).alias("keeps"))
    linked = cut(linked)
    return cut(multi.join(linked.select("num"), "num", "left_anti").unionByName(linked).drop("num"))


def mark(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "dup", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` of class_id and kept (the row has its class' id and the text that is kept)."""
    shared = _few(classes(docs, id_col, text, threshold)).select(F.col("node").alias("__n"), F.col("least_id").alias("__least"), F.col("keeps").alias("__keeps"))
    own = F.col(f"`{id_col}`")
    rows = docs.withColumn("__node", _node(F.col(f"`{text}`"))).join(shared, F.col("__node") == F.col("__n"), "left")
    found = F.col("__n").isNotNull()
    verdict = F.struct(F.when(found, F.col("__least")).otherwise(own).alias("class_id"), (~found | (own.eqNullSafe(F.col("__least")) & F.col("__keeps"))).alias("kept"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias(out))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class; the columns of ``docs``."""
    kept = mark(docs, id_col, text, "__dup", threshold).where("__dup.kept").drop("__dup")
    # rows that repeat an id and a text are settled apart, so that all others need no shuffle
    key = [F.col(f"`{id_col}`").alias("__i"), _node(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__t")]
    spaces = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(WORD)
    again = docs.where(spaces).select(*key).groupBy("__i", "__t").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    again = cut(again)
    if again.isEmpty():
        return kept
    keyed = kept.withColumns({"__i": key[0], "__t": key[1]})
    on = F.col("__i").eqNullSafe(F.col("__ri")) & (F.col("__t") == F.col("__rt"))
    few = _few(again.toDF("__ri", "__rt"))
    once = keyed.join(few, on, "left_semi").dropDuplicates(["__i", "__t"])
    return keyed.join(few, on, "left_anti").unionByName(once).drop("__i", "__t")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "dup.*")
