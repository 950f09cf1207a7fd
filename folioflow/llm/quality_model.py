"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by the filters' width, so that every byte of the
whole document is seen. Each byte has a learned embedding, learned filters slide over each chunk, the maximum of each
filter over the chunk is kept, and the chunks' maxima, averaged and maximised over the document, go through one hidden
layer into one probability. Training is plain Adam with seeded draws; as a maximum passes its gradient to one place,
the backward pass touches one window by chunk and filter.

The training sample is bounded: ``max_train`` labelled rows of at most ``MAX_BYTES`` bytes each, those of the smallest
hash of the id; each is learned from whole. Scoring covers every row and every byte.

Defined results. Null and empty texts are one chunk of padding and score like any other. Rows without labels aren't
learned from; conflicting labels of an id count by their mean, rounded up at a half. With no labels at all, or one
class only, every score is that class' smoothed share. Repeated rows score alike. Empty tables give empty results.
Columns of the input pass through; the operator adds one struct of the caller's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, table

CHUNK, WIDTH, STEP = 512, 8, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Labelled rows that are learned from, and the longest text among them: 250 MB at the very most, some 13 MB as a rule.
MAX_TRAIN, MAX_BYTES = 4_000, 1 << 16
#: Steps are as many at any size.
STEPS, BATCH, RATE, DECAY = 800, 32, 0.004, 1e-4
THRESHOLD = 0.7
#: Chunks whose windows are laid out at once: about 4 MB.
BLOCK = 64
SEED = 7

Params = dict[str, np.ndarray]


def chunk_starts(n: int) -> np.ndarray:
    last = max(0, n - CHUNK)
    starts = np.arange(0, last + 1, CHUNK - WIDTH)
    return starts if n <= CHUNK or starts[-1] == last else np.append(starts, last)


def chunks_of(data: bytes, starts: np.ndarray | None = None) -> np.ndarray:
    """(chunks, CHUNK) bytes; a text shorter than a chunk is padded with 0."""
    a = np.frombuffer(data, np.uint8)
    if len(a) < CHUNK:
        a = np.concatenate([a, np.zeros(CHUNK - len(a), np.uint8)])
    return a[(chunk_starts(len(a)) if starts is None else starts)[:, None] + np.arange(CHUNK)]


def _windows(emb: np.ndarray) -> np.ndarray:
    b, places = emb.shape[0], (CHUNK - WIDTH) // STEP + 1
    s = emb.strides
    return np.lib.stride_tricks.as_strided(emb, (b, places, WIDTH * EMBED), (s[0], s[1] * STEP, s[2])).reshape(b * places, WIDTH * EMBED)


def pool(p: Params, chunks: np.ndarray, where: bool = False):
    """Maxima (chunks, FILTERS) after the bias and rectifier, and the places of the maxima if asked for."""
    most = np.empty((len(chunks), FILTERS), np.float32)
    places = np.empty((len(chunks), FILTERS), np.int64) if where else None
    for i in range(0, len(chunks), BLOCK):
        part = chunks[i : i + BLOCK]
        out = (_windows(p["embed"][part]) @ p["filters"]).reshape(len(part), -1, FILTERS)
        if where:
            places[i : i + BLOCK] = out.argmax(1)
        most[i : i + BLOCK] = out.max(1)
    most += p["filter_bias"]
    np.maximum(most, 0, out=most)
    return (most, places) if where else most


def combine(p: Params, most: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document features (averages, maxima), hidden layer and logits from the chunks' maxima."""
    counts = np.diff(np.append(first, len(most)))[:, None]
    x = np.hstack([np.add.reduceat(most, first) / counts, np.maximum.reduceat(most, first)]).astype(np.float32)
    h = np.maximum(x @ p["w1"] + p["b1"], 0)
    return x, h, h @ p["w2"] + p["b2"]


def score(p: Params, texts: list[str | None]) -> np.ndarray:
    if "constant" in p:
        return np.full(len(texts), float(p["constant"]))
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        starts = chunk_starts(max(len(data), CHUNK))
        # a very long text is pooled in parts: its maxima are small, its windows are not
        most = np.vstack([pool(p, chunks_of(data, starts[k : k + 4096])) for k in range(0, len(starts), 4096)])
        out[i] = combine(p, most, np.array([0]))[2][0]
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(texts: list[str | bytes], labels: np.ndarray, weights: np.ndarray | None = None, steps: int = STEPS) -> Params:
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": np.array((y.sum() + 1) / (len(y) + 2))}
    w = np.ones_like(y) if weights is None else np.asarray(weights, np.float32) / np.mean(weights)
    rng = np.random.default_rng(SEED)
    draw = lambda *shape, fan: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
    p: Params = {
        "embed": draw(256, EMBED, fan=1), "filters": draw(WIDTH * EMBED, FILTERS, fan=WIDTH * EMBED), "filter_bias": np.zeros(FILTERS, np.float32),
        "w1": draw(2 * FILTERS, HIDDEN, fan=2 * FILTERS), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(HIDDEN, fan=HIDDEN), "b2": np.zeros(1, np.float32),
    }
    data = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    while step < steps:
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH)[: steps - step]:
            ids = order[at : at + BATCH]
            parts = [chunks_of(data[i]) for i in ids]
            counts = np.array([len(x) for x in parts])
            first, chunks = np.append(0, counts.cumsum()[:-1]), np.vstack(parts)
            most, places = pool(p, chunks, where=True)
            x, h, logit = combine(p, most, first)
            g = {}
            d = ((1 / (1 + np.exp(-logit)) - y[ids]) * w[ids] / len(ids)).astype(np.float32)
            g["w2"], g["b2"] = h.T @ d, d.sum(keepdims=True)
            dh = d[:, None] * p["w2"] * (h > 0)
            g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
            dx = dh @ p["w1"].T
            doc = np.repeat(np.arange(len(ids)), counts)
            is_top = most == x[doc, FILTERS:]
            dm = (dx[doc, :FILTERS] / counts[doc][:, None] + dx[doc, FILTERS:] * is_top) * (most > 0)
            g["filter_bias"] = dm.sum(0)
            taps = np.take_along_axis(chunks, (places[:, :, None] * STEP + np.arange(WIDTH)).reshape(len(chunks), -1), 1).reshape(len(chunks), FILTERS, WIDTH)
            seen = p["embed"][taps].reshape(len(chunks), FILTERS, WIDTH * EMBED)
            g["filters"] = np.einsum("cf,cfw->wf", dm, seen, optimize=True)
            back = (dm[:, :, None] * p["filters"].T[None]).reshape(-1, EMBED)
            g["embed"] = np.stack([np.bincount(taps.ravel(), back[:, k], 256) for k in range(EMBED)], 1)
            step += 1
            rate = RATE * min(1, step / 50) * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, v in p.items():
                gk = g[k].astype(np.float32) + (DECAY * v if v.ndim > 1 else 0)
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.99 * m2[k] + 0.01 * gk * gk
                v -= (rate * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def _held_out(id_col: Column) -> Column:
    """A null id isn't held out, and never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Params:
    """Learns from labelled rows outside the held-out quarter. Only ids and labels are looked at to choose them."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.floor(F.avg(F.col(label).cast("double")) + 0.5).cast("int").alias("y"))
    order = F.xxhash64(F.col("__id").cast("string"))
    chosen = known.withColumn("seed", order).orderBy("seed", "__id").limit(max_train)
    # at most max_train rows of an id and two numbers: a broadcast of proven size
    rows = docs.select(F.col(f"`{id_col}`").alias("__did"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), F.col("__did") == F.col("__id"))
    short = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= MAX_BYTES)
    found = short.select("seed", F.coalesce("text", F.lit("")).alias("text"), "y").orderBy("seed", "text").limit(max_train).collect()
    return train([r["text"] for r in found], np.array([r["y"] for r in found], np.float32))


def scorer(params: Params):
    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(score(params, list(part)), dtype="float64")

    # not deterministic to the planner alone: a filter on the score must not run it a second time
    return F.pandas_udf(quality, "double").asNondeterministic()


def classify(docs: DataFrame, params: Params, text: str = "text", out: str = "quality") -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` of score and predicted."""
    bounded_batches(docs.sparkSession)
    rows = docs.withColumn("__score", scorer(params)(F.col(f"`{text}`")))
    s = F.col("__score")
    verdict = F.struct(s.alias("score"), F.when(s >= THRESHOLD, 1).otherwise(0).alias("predicted"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    params = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, params).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "quality.*")
