"""Chunkers: paragraphs and sentences as Catalyst expressions, the recursive structural splitter as an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import BLANKS, fenced, held, trim

CHUNK_SIZE = 1000
#: Tried in turn: headings from the largest, blank line, line, sentence, word.
SEPARATORS = tuple(s.encode() for s in ("\n# ", "\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", " "))
TABLE_MARKS = ("### VLM Extracted:", "**Tableau Extrait")
_CHUNKS = T.ArrayType(T.StringType())
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 128


# ---- structural ----------------------------------------------------------------------------------------------------


def _char_end(data: bytes, start: int, size: int) -> int:
    """Where a cut of at most ``size`` bytes falls between characters; one that is larger by itself stays whole."""
    end = start + size
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    if end <= start:
        end = start + 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
    return min(end, len(data))


def slices(data: bytes, size: int) -> list[tuple[int, int]]:
    """Spans that tile ``data``: split at the first separator that occurs, pieces merged again up to ``size`` bytes."""
    out: list[tuple[int, int]] = []
    # spans to do, last first; depth is the first separator to try; a merge run is closed by its sentinel
    def split(start: int, end: int, depth: int) -> list[tuple[int, int]]:
        if end - start <= size:
            return [(start, end)] if end > start else []
        while depth < len(SEPARATORS) and data.find(SEPARATORS[depth], start, end) < 0:
            depth += 1
        if depth == len(SEPARATORS):
            cuts = []
            while start < end:
                stop = min(end, _char_end(data, start, size))
                cuts.append((start, stop))
                start = stop
            return cuts
        sep, parts, at = SEPARATORS[depth], [], start
        hit = data.find(sep, start, end)
        while hit >= 0:
            if hit > at:
                parts.append((at, hit))
            at, hit = hit, data.find(sep, hit + len(sep), end)
        parts.append((at, end))
        merged: list[tuple[int, int]] = []
        now = None
        for a, b in parts:
            for x, y in [(a, b)] if b - a <= size else split(a, b, depth + 1):
                if now is not None and y - now[0] > size:
                    merged.append(now)
                    now = (x, y)
                else:
                    now = (x, y) if now is None else (now[0], y)
        if now is not None:
            merged.append(now)
        return merged

    out.extend(split(0, len(data), 0))
    return out


def structural_list(text: str | None, size: int, keep_empty: bool = False) -> list[str]:
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    parts = (data[a:b].decode("utf-8", "surrogatepass").strip(BLANKS) for a, b in slices(data, max(1, size)))
    return [p for p in parts if p or keep_empty]


def _by_few(make: Callable, kind: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``make`` on each value, by a few rows at a time: of a batch that may hold many megabytes only those become objects."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            if not len(b):
                yield pa.array([], kind)
            for k in range(0, len(b), ROWS):
                yield pa.array([make(x) for x in b.slice(k, ROWS).to_pylist()], kind)

    return run


def structural(text: Column, size: int = CHUNK_SIZE, keep_empty: bool = False) -> Column:
    """Recursive structural chunks of at most ``size`` bytes, trimmed."""
    return structural_udf(size, keep_empty)(text)


def structural_udf(size: int = CHUNK_SIZE, keep_empty: bool = False):
    return F.arrow_udf(_by_few(lambda t: structural_list(t, size, keep_empty), pa.list_(pa.string())), _CHUNKS)


# ---- paragraphs ----------------------------------------------------------------------------------------------------


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), trim), lambda p: p != "")


def packed(parts: Column, size: int, glue: str = "\n\n") -> Column:
    """Parts joined in order until the next would exceed ``size`` bytes; a longer part stays whole.

    The fold keeps the finished chunks as one string between marks that text can't hold, so that a step costs no
    copy of an array of them.
    """
    mark = "﷐"
    n = lambda c: F.octet_length(c)
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("now"))

    def closed(v: Column) -> Column:
        full = n(v["now"]) >= size
        return F.struct(F.when(full, F.concat(v["done"], v["now"], F.lit(mark))).otherwise(v["done"]).alias("done"), F.when(full, F.lit("")).otherwise(v["now"]).alias("now"))

    def step(acc: Column, p: Column) -> Column:
        flush = (acc["now"] != "") & (n(acc["now"]) + n(p) + len(glue) > size)
        done = F.when(flush, F.concat(acc["done"], acc["now"], F.lit(mark))).otherwise(acc["done"])
        now = F.when(flush | (acc["now"] == ""), p).otherwise(F.concat(acc["now"], F.lit(glue), p))
        return held(F.struct(done.alias("done"), now.alias("now")), closed)

    whole = F.aggregate(parts, empty, step, lambda acc: F.concat(acc["done"], acc["now"]))
    return F.filter(F.split(whole, mark), lambda c: c != "")


def paragraph_chunks(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Paragraphs packed up to ``size`` bytes."""
    return packed(paragraphs(text), size)


def needs_structure(text: Column) -> Column:
    return text.contains("|") | text.contains(TABLE_MARKS[0]) | text.contains(TABLE_MARKS[1])


def fast_chunks(df: DataFrame, text: str = "content", size: int = CHUNK_SIZE, out: str = "chunks") -> DataFrame:
    """Paragraph chunks; texts with tables go to the structural splitter, and only they reach Python."""
    t, table = F.col(text), F.col("__table")
    df = fenced(fenced(df, text).withColumn("__table", F.when(needs_structure(t), t)), "__table")
    return df.withColumn(out, F.when(table.isNotNull(), structural(table, size)).otherwise(paragraph_chunks(t, size))).drop("__table")


def child_chunks(df: DataFrame, size: int, fast: bool = True, chunks: str = "chunks", out: str = "child_chunks") -> DataFrame:
    """array<struct<text, parent_index>>: each chunk split again."""
    if fast:
        whole = F.exists(chunks, needs_structure)
        native = F.flatten(F.transform(chunks, lambda c, i: F.transform(paragraph_chunks(c, size), lambda x: F.struct(x.alias("text"), i.alias("parent_index")))))
    else:
        whole, native = F.lit(True), None

    def kids(cs: list[str] | None) -> list[dict]:
        return [{"text": x, "parent_index": i} for i, c in enumerate(cs or []) for x in (fast_list(c, size) if fast else structural_list(c, size))]

    run = _by_few(kids, pa.list_(pa.struct({"text": pa.string(), "parent_index": pa.int32()})))
    df = fenced(fenced(df, chunks).withColumn("__whole", F.when(whole, F.col(chunks))), "__whole")
    made = F.arrow_udf(run, "array<struct<text: string, parent_index: int>>")("__whole")
    return df.withColumn(out, made if native is None else F.when(F.col("__whole").isNotNull(), made).otherwise(native)).drop("__whole")


def fast_list(text: str, size: int) -> list[str]:
    """The paragraph packer in Python, for texts that are there already."""
    if "|" in text or any(m in text for m in TABLE_MARKS):
        return structural_list(text, size)
    out, now = [], ""
    for p in (p.strip(BLANKS) for p in text.split("\n\n")):
        if not p:
            continue
        if now and len(now.encode()) + len(p.encode()) + 2 > size:
            out.append(now)
            now = ""
        now = f"{now}\n\n{p}" if now else p
        if len(now.encode()) >= size:
            out.append(now)
            now = ""
    return out + [now] if now else out


# ---- sentences, units, document chunks -----------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Cut after . ! ? or a line end if ASCII white space follows; trimmed, blanks dropped."""
    parts = F.split(text, r"(?<=[.!?\n])(?=[ \t\n\f\r])")
    return F.filter(F.transform(parts, trim), lambda s: s != "")


_TABLE_LINE = "^(?:\\||" + "|".join(re.escape(m) for m in TABLE_MARKS) + ")"


def units(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """(key, unit_index, unit, is_table): runs of table lines stay whole, other runs give their sentences.

    Lines are numbered where they are; runs are islands of equal kind, found by a window over the key.
    """
    from pyspark.sql import Window as W

    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "\\r\\n", "\n"), "\\n$", ""), "\n")
    rows = df.select(*key, F.posexplode(lines).alias("i", "line")).withColumn("is_table", trim(F.col("line")).rlike(_TABLE_LINE))
    by = W.partitionBy(*key).orderBy("i")
    rows = rows.withColumn("island", F.sum(F.when(F.lag("is_table").over(by) == F.col("is_table"), 0).otherwise(1)).over(by))
    blocks = rows.groupBy(*key, "island", "is_table").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    block = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    # blank lines at the head of a run of text vanish
    block = F.when(F.col("is_table"), block).otherwise(F.regexp_replace(block, "^\\n+", ""))
    cut = blocks.select(*key, "island", "is_table", F.posexplode(F.when(F.col("is_table"), F.array(block)).otherwise(sentences(block))).alias("j", "unit"))
    order = W.partitionBy(*key).orderBy("island", "j")
    return cut.select(*key, (F.row_number().over(order) - 1).alias("unit_index"), "unit", "is_table")


def assign(page_bytes: Column, n_chunks: Column) -> Column:
    """array<struct<start, end>> of each page's share of the document's chunks: in proportion, at least one while any is left."""
    total = F.aggregate(page_bytes, F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(1)).cast("long"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        share = F.round(n_chunks.cast("double") * F.greatest(x, F.lit(1)).cast("double") / total.cast("double")).cast("int")
        end = (acc["at"] + F.least(F.greatest(share, F.lit(1)), n_chunks - acc["at"])).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("spans"))

    return F.aggregate(page_bytes, start, step, lambda acc: acc["spans"])


def document_chunks(pages: DataFrame, size: int = CHUNK_SIZE, path: str = "path", index: str = "page_index", text: str = "content") -> DataFrame:
    """(path, page_index, chunks): the document is chunked as a whole and its chunks are dealt to its pages.

    A page that gets none holds its own text; what is left goes to the last page. One row holds a document, as chunks
    run across pages.
    """
    docs = pages.groupBy(path).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("ps"))
    docs = docs.withColumn("__full", F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n"))
    docs = fast_chunks(docs, "__full", size, "__all").withColumn("__bytes", F.transform("ps", lambda p: F.octet_length(p["t"])))
    docs = docs.withColumn("__spans", assign(F.col("__bytes"), F.size("__all")))
    rows = docs.select(path, "__all", F.size("ps").alias("n"), "__spans", F.posexplode("ps").alias("k", "p"))
    span = F.get(F.col("__spans"), F.col("k"))
    end = F.when(F.col("k") == F.col("n") - 1, F.size("__all")).otherwise(span["end"])
    got = F.slice("__all", span["start"] + 1, end - span["start"])
    return rows.select(path, F.col("p.i").alias(index), F.when(F.size(got) > 0, got).otherwise(F.array(F.col("p.t"))).alias("chunks"))
