"""Token counts by a two-tier lookup on the map side, with no shuffle of pre-tokens.

Tier 1 is a broadcast table of the lengths of frequent pre-tokens, chosen on the driver from a bounded sample of texts;
tier 2 is a cache in each Python worker, filled by encoding misses. The tiers decide speed alone: a count never
depends on what they hold, so the sample may be any, and every text is counted whole.

Texts whose characters all lie in U+0000..U+024F, where normalisation is the identity but for case and white space, are
split by a regular expression equal to the tokenizer's own; a white-space-delimited piece with any other character
is handed to the tokenizer whole. Special strings in a text count as one token, as the library does by default.

Defined results. Null and empty texts: 0 bytes, 0 tokens. Very long texts are worked through in slices cut at white
space. Repeated rows are counted each; empty tables give empty results. Other columns are passed on untouched.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of the broadcast table; texts, and bytes of each, that are looked at to choose them (8 MB at most).
FREQUENT = 32_768
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 4_096
#: Entries a worker's cache holds before it starts afresh, and the longest pre-token it keeps.
CACHE = 400_000
KEEP_CHARS = 64
SLICE = 1 << 20

_PLAIN_END = 0x250
_chars = [chr(i) for i in range(_PLAIN_END) if i != 0x130]


def _class(test) -> str:
    return "".join(re.escape(c) for c in _chars if test(unicodedata.category(c)))


_L, _N = _class(lambda k: k[0] == "L"), _class(lambda k: k[0] == "N")
_S = "\\t-\\r \x85\xa0"
#: What the fast path can't take: other characters, and anything that might belong to a special string.
_OTHER = re.compile(f"[^\x00-įı-{chr(_PLAIN_END - 1)}]|<\\|")
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Pieces between the tokenizer's own white space; str.split() also takes U+001C..U+001F for it, which are tokens.
_PIECE = re.compile(f"[^{_S}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SPACE = re.compile(f"[{_S}]")


def slices(text: str) -> Iterator[str]:
    """Parts of at most about SLICE characters, cut at white space; a longer run without any stays whole."""
    at = 0
    while len(text) - at > SLICE:
        cut = _SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def pre_tokens(part: str) -> tuple[list[str], list[str]]:
    """(pre-tokens of the plain pieces, pieces for the tokenizer)."""
    low = part.lower()
    if not _OTHER.search(part):
        return _PRE.findall(low), []
    plain, odd = [], []
    for piece in _PIECE.findall(part):
        (odd if _OTHER.search(piece) else plain).append(piece)
    return _PRE.findall(" ".join(plain).lower()), odd


class Lengths:
    """Pre-token to its number of tokens: ``known`` starts as the broadcast table and grows as the worker's cache."""

    def __init__(self, path: str, table: dict[str, int]):
        # a thread pool for a handful of misses costs far more than they do; tasks are the parallelism here
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.table, self.known, self.tokenizer = table, dict(table), Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str | None) -> int:
        n = 0
        for part in slices(text) if text else ():
            tokens, odd = pre_tokens(part)
            # a plain dict: for any other kind, difference() would walk through all of it
            missing = list(set(tokens).difference(self.known))
            if missing:
                if len(self.known) + len(missing) > CACHE:
                    self.known = dict(self.table)
                    missing = list(set(tokens).difference(self.known))
                self.known.update(zip(missing, self.encode(missing)))
            n += sum(map(self.known.__getitem__, tokens))
            for x in missing:
                if len(x) > KEEP_CHARS:
                    del self.known[x]
            if odd:
                n += sum(self.encode(odd))
        return n


_worker: dict[tuple, Lengths] = {}


def _lengths(path: str, shared) -> Lengths:
    """One cache by worker process and broadcast; an older one is dropped."""
    key = (path, shared.value["id"])
    if key not in _worker:
        _worker.clear()
        _worker[key] = Lengths(path, shared.value["lengths"])
    return _worker[key]


def frequent(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of ``SAMPLE_ROWS`` texts of at most ``SAMPLE_BYTES``, at most FREQUENT of them.

    Spark reads as few partitions as that takes; no pre-token is shuffled.
    """
    t = F.col(f"`{text}`")
    seen: Counter = Counter()
    for row in docs.where(F.octet_length(t) <= SAMPLE_BYTES).select(t.alias("text")).limit(SAMPLE_ROWS).collect():
        seen.update(pre_tokens(row["text"])[0])
    return [k for k, _ in seen.most_common(FREQUENT) if len(k) <= KEEP_CHARS]


def token_counter(spark: SparkSession, docs: DataFrame, path: str, text: str = "text"):
    """A function from a text column to its number of tokens, with the broadcast table made for ``docs``."""
    bounded_batches(spark)
    entries = frequent(docs, text)
    lengths = dict(zip(map(sys.intern, entries), Lengths(path, {}).encode(entries))) if entries else {}
    shared = spark.sparkContext.broadcast({"id": id(lengths), "lengths": lengths})

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _lengths(path, shared)
        for part in parts:
            yield pd.Series([known.count(x) for x in part], dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, out: str = "tokens") -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` of n_bytes, n_tokens and over_limit."""
    t: Column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    count = token_counter(docs.sparkSession, docs, path, text)
    rows = docs.withColumn("__n_tokens", count(t))
    n = F.col("__n_tokens")
    digest = F.struct(F.octet_length(t).cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], digest.alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "tokens.*")
