"""Benchmark decontamination: a BM25 index of the test items, queried with every passage by block-max WAND.

Each test item is a document of the index; impacts are BM25 divided by what the item scores against itself, so scores
lie in [0, 1] and one threshold fits all items. Items are indexed by length class; the passages that query a class are
windows of twice its length at half steps, so every item that occurs lies wholly inside some passage. A passage
first meets the bound of block-max WAND at the level of ranges of items (the sum of each distinct term's highest
impact in the range), computed for all windows of a document at once; the ranges that may reach the threshold are
searched with the postings' block maxima, which returns all items at or above it. A hit counts if the passage then holds enough of
the item's question (shares of its five-word shingles) and of its answer (its last sentence, shares of its words).

The index holds about ``BLOCK_BYTES`` of item text; more items make more blocks, each an index of its own that all
passages query. Blocks are scanned one after another, the documents with their hits so far being stored in between, so
that one block's broadcast is held at a time and no item is left out. Document frequencies are those of a block.

Defined results. Null, empty and wordless documents and items match nothing. Items of fewer than ``LEAST`` words are too
short for scores and shares: a document holds one if it has its words in a row, with the score 1. Repeated documents are judged
alike, repeated items all reported, items with a null id under a null id. Texts are
read whole. Empty tables give empty results or no hits. Other columns pass through.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, cut, table

K1, B = 1.2, 0.75
THRESHOLD = 0.7
OVERLAP = 0.6
SHINGLE = 5
LEAST = 6
POSTINGS_BLOCK = 32
BLOCK_BYTES = 16 << 20
#: Items of one range of the window bounds, and how many ranges there may be before they grow.
RANGE, MOST_RANGES = 4, 64
#: Windows of a document whose bounds are computed at once.
WINDOWS = 4096

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+\s*")


def terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def parts(text: str) -> tuple[list[str], list[str]]:
    """(question, answer): the answer is the last sentence, or as many as it takes for four words."""
    pieces = [p for p in (terms(s) for s in _SENTENCE.split(text)) if p]
    cut = len(pieces) - 1
    while cut > 1 and sum(map(len, pieces[cut:])) < 4:
        cut -= 1
    if len(pieces) < 2:
        whole = terms(text)
        return whole[: -len(whole) // 4], whole[-len(whole) // 4 :]
    return [w for p in pieces[:cut] for w in p], [w for p in pieces[cut:] for w in p]


def _shingles(ws: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


class Index:
    """Postings of one length class with block maxima. ``ids`` are the caller's; inside, items are 0, 1, ..."""

    def __init__(self, items: list[tuple[int, str]], length: int):
        self.window = 2 * length
        self.ids = [i for i, _ in items]
        self.items = [terms(t) for _, t in items]
        self.parts = [parts(t) for _, t in items]
        n, mean = len(items), sum(map(len, self.items)) / len(items)
        df = Counter(t for ws in self.items for t in set(ws))
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, ws in enumerate(self.items):
            norm = K1 * (1 - B + B * len(ws) / mean)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(ws).items()}
            own = sum(raw.values())
            for t, x in raw.items():
                postings[t].append((i, x / own))
        self.term = {t: k for k, t in enumerate(postings)}
        self.at = [[i for i, _ in p] for p in postings.values()]
        self.impact = [[x for _, x in p] for p in postings.values()]
        # by block of postings: its last item and its highest impact
        size = POSTINGS_BLOCK
        self.last = [[a[min(k + size, len(a)) - 1] for k in range(0, len(a), size)] for a in self.at]
        self.block = [[max(x[k : k + size]) for k in range(0, len(x), size)] for x in self.impact]
        self.most = [max(x) for x in self.impact]
        # the highest impact of each term within each range of ``span`` items
        self.span = max(RANGE, -(-n // MOST_RANGES))
        self.range_most = np.zeros((len(self.at), -(-n // self.span)), np.float32)
        for t, (a, x) in enumerate(zip(self.at, self.impact)):
            np.maximum.at(self.range_most[t], np.array(a) // self.span, x)

    def search(self, query: set[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """Items from low to high whose score reaches the threshold, with it: WAND on terms', then on blocks' maxima."""
        end, eps, found = len(self.items) if high is None else high, 1e-9, []
        cursor = {t: bisect_left(self.at[t], low) for t in query}
        live = sorted((self.at[t][k], t) for t, k in cursor.items() if k < len(self.at[t]) and self.at[t][k] < end)
        while live:
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(live):
                bound += self.most[t]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            near, until = 0.0, end
            for at, t in live[: pivot + 1]:
                b = bisect_left(self.last[t], item)
                if b < len(self.last[t]):
                    near += self.block[t][b]
                    until = min(until, self.last[t][b] + 1)
            if near < threshold - eps:
                # no item before the first of these blocks ends, or before the next list begins, can reach it
                goal = max(item + 1, min(until, live[pivot + 1][0] if pivot + 1 < len(live) else end))
            else:
                goal = item + 1
                score = 0.0
                for _, t in live[: pivot + 1]:
                    k = bisect_left(self.at[t], item, cursor[t])
                    if k < len(self.at[t]) and self.at[t][k] == item:
                        score += self.impact[t][k]
                if score >= threshold - eps:
                    found.append((item, score))
            moved = []
            for at, t in live[: pivot + 1]:
                cursor[t] = k = bisect_left(self.at[t], goal, cursor[t])
                if k < len(self.at[t]) and self.at[t][k] < end:
                    moved.append((self.at[t][k], t))
            live = sorted(moved + live[pivot + 1 :])
        return found

    def overlap(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words that the passage holds."""
        question, answer = self.parts[item]
        asked, said = _shingles(question), Counter(answer)
        held = _shingles(passage) if len(question) >= SHINGLE else {tuple(passage[i : i + len(question)]) for i in range(len(passage))}
        return len(asked & held) / max(1, len(asked)), sum((said & Counter(passage)).values()) / max(1, len(answer))

    def hits(self, words: list[str], threshold: float, least: float) -> dict[int, float]:
        """Items found in a document: the item's place and its best score."""
        get = self.term.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(ids >= 0)
        found: dict[int, float] = {}
        if not len(at):
            return found
        v, step = ids[at], self.window // 2
        half, halves = at // step, -(-len(ids) // step)
        # a term counts at its first place in a window of two halves: it tells whether it was in this half or the one before
        order = np.argsort(v, kind="stable")
        same = v[order[1:]] == v[order[:-1]]
        before = np.full(len(v), -2)
        before[order[1:][same]] = half[order[:-1][same]]
        for first in range(0, max(1, halves - 1), WINDOWS):
            top = min(halves, first + WINDOWS + 1)
            lo, hi = np.searchsorted(half, (first, top))
            if lo == hi:
                continue
            most = self.range_most[v[lo:hi]]
            here, starts = np.unique(half[lo:hi], return_index=True)
            sums = np.zeros((2, top - first + 1, most.shape[1]), np.float32)
            for k in range(2):
                sums[k, here - first] = np.add.reduceat(most * (before[lo:hi] < half[lo:hi] - k)[:, None], starts)
            bound = sums[0, :-1] + sums[1, 1:]
            windows, ranges = np.nonzero(bound[: max(1, top - first - 1)] >= threshold - 1e-5)
            for w, r in zip(windows.tolist(), ranges.tolist()):
                start = (first + w) * step
                a, b = np.searchsorted(at, (start, start + self.window))
                for item, score in self.search(set(v[a:b].tolist()), threshold, r * self.span, min(len(self.items), (r + 1) * self.span)):
                    if score > found.get(item, 0.0):
                        asked, said = self.overlap(item, words[start : start + self.window])
                        if asked >= least and said >= least:
                            found[item] = score
        return found


class Runs:
    """Items of fewer than ``LEAST`` words, found as runs of words."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.runs: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for k, (_, t) in enumerate(items):
            self.runs[tuple(terms(t))].append(k)
        self.lengths: dict[str, set[int]] = defaultdict(set)
        for run in self.runs:
            self.lengths[run[0]].add(len(run))

    def hits(self, words: list[str], threshold: float, least: float) -> dict[int, float]:
        first = self.lengths.keys() & set(words)
        return {k: 1.0 for at, w in enumerate(words) if w in first for n in self.lengths[w] for k in self.runs.get(tuple(words[at : at + n]), ())} if first else {}


def build(items: list[tuple[int | None, str | None]]) -> list[Index | Runs]:
    """One index by length class (32, 64, 128, ... words), and one of short items."""
    by: dict[int, list[tuple[int | None, str]]] = defaultdict(list)
    for i, t in items:
        if n := len(terms(t)):
            by[max(32, 1 << (n - 1).bit_length()) if n >= LEAST else 0].append((i, t))
    return [Index(x, length) if length else Runs(x) for length, x in sorted(by.items())]


def find(indexes: list[Index | Runs], text: str | None, threshold: float = THRESHOLD, least: float = OVERLAP) -> list[tuple[int | None, float]]:
    """(item id, score) of all items the text holds, by id, null last."""
    ws = terms(text)
    if not ws:
        return []
    return sorted({(x.ids[i], round(s, 6)) for x in indexes for i, s in x.hits(ws, threshold, least).items()}, key=lambda h: (h[0] is None, h))


_HITS = "array<struct<item_id: long, score: double>>"


def scan(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """All columns of ``docs`` and an array ``out`` of the items each document holds, with their scores."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))

    def matcher(block: int):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(build([(r["i"], r["t"]) for r in rows]))

        def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([[{"item_id": i, "score": s} for i, s in find(shared.value, t, threshold, least)] for t in b], dtype="object")

        # not deterministic to the planner alone: a filter on the result must not run it a second time
        return F.pandas_udf(match, _HITS).asNondeterministic(), shared

    named = [F.col(f"`{c}`") for c in docs.columns]
    found, last = matcher(0)
    done = docs.select(*named, found(F.col(f"`{text}`")).alias(out))
    for block in range(1, blocks):
        # one block is broadcast at a time: what came before is stored
        done = cut(done)
        last.destroy()
        found, last = matcher(block)
        order = "(a, b) -> case when a.item_id is not distinct from b.item_id then 0 when a.item_id is null then 1 when b.item_id is null or a.item_id < b.item_id then -1 else 1 end"
        both = F.concat(F.col(f"`{out}`"), found(F.col(f"`{text}`")))
        done = done.select(*named, both.alias("__both")).select(*named, F.array_distinct(F.expr(f"array_sort(__both, {order})")).alias(out))
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"))
