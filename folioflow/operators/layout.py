"""Page geometry: interval merging, reading order by recursive cuts, glyphs to lines, cells and text.

What recurses within a page runs in numpy, boxes for many pages at once and glyphs page by page; the rest are windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by_start(key: list[str], start: str, end: str) -> W:
    return W.partitionBy(*key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))


def _reached(df: DataFrame, key: list[str], start: str, end: str, out: str = "__before") -> DataFrame:
    """How far the intervals before each one reach; null at the first."""
    return df.withColumn(out, F.max(end).over(_by_start(key, start, end).rowsBetween(W.unboundedPreceding, -1)))


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, start, end): overlapping or touching intervals become one."""
    new = F.when(F.col("__before").isNull() | (F.col(start) > F.col("__before")), 1).otherwise(0)
    rows = _reached(df, key, start, end).withColumn("__new", new)
    rows = rows.withColumn("__island", F.sum("__new").over(_by_start(key, start, end).rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def largest_gap(df: DataFrame, key: list[str], start: str, end: str, least: float) -> DataFrame:
    """(key, cut): the middle of the widest gap between merged intervals, the first of equals, if it is wide enough.

    A gap ends at each start that nothing before reaches, so one sorted pass finds them all and no interval is merged.
    """
    rows = _reached(df.select(*key, start, end), key, start, end)
    gap = F.col(start) - F.col("__before")
    gaps = rows.where(F.col(start) > F.col("__before")).select(*key, F.struct(gap.alias("gap"), (-F.col(start)).alias("s"), (F.col("__before") + gap / 2).alias("cut")).alias("__g"))
    best = gaps.groupBy(*key).agg(F.max("__g").alias("b"))
    return best.where(F.col("b.gap") >= least).select(*key, F.col("b.cut").alias("cut"))


# ---- recursive cuts ------------------------------------------------------------------------------------------------


def _cut(low: np.ndarray, high: np.ndarray, least: float) -> float | None:
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])[:-1]
    gaps = low[order][1:] - reach
    if not len(gaps) or (k := int(np.argmax(gaps))) < 0 or gaps[k] <= 0 or gaps[k] < least:
        return None
    return float((reach[k] + low[order][k + 1]) * 0.5)


def xy_order(boxes: np.ndarray, width: float, height: float, y_down: bool = False) -> list[int]:
    """Reading order of boxes (x0, y0, x1, y1): split at the widest vertical gap, else horizontal, else sort by rows."""
    if not len(boxes):
        return []
    b = np.asarray(boxes, np.float64)
    centre = np.stack([b[:, 0] + b[:, 2], b[:, 1] + b[:, 3]], 1) / 2
    least = (max(0.02 * width, 8.0), max(0.015 * height, 6.0))
    out: list[int] = []
    todo = [np.arange(len(b))]
    while todo:
        ids = todo.pop()
        parts = None
        for axis in (0, 1) if len(ids) > 1 else ():
            at = _cut(b[ids, axis], b[ids, axis + 2], least[axis])
            if at is None:
                continue
            low = centre[ids, axis] < at
            if low.any() and not low.all():
                parts = [ids[low], ids[~low]]
                if axis and not y_down:
                    parts.reverse()
                break
        if parts:
            todo += reversed(parts)
        else:
            y = centre[ids, 1] if y_down else -centre[ids, 1]
            out += ids[np.lexsort((b[ids, 0], y))].tolist()
    return out


def _cuts(low: np.ndarray, high: np.ndarray, first: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """``_cut`` of many parts, which begin at ``first``; not a number where there is none."""
    part = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((low, part))
    low, reach = low[order], high[order]
    at = np.arange(len(low)) - np.repeat(first, size)
    step = 1
    while step < size.max():
        reach[step:] = np.where(at[step:] >= step, np.maximum(reach[step:], reach[:-step]), reach[step:])
        step *= 2
    gap = np.full(len(low), -np.inf)
    gap[1:] = low[1:] - reach[:-1]
    gap[first] = -np.inf
    widest = np.maximum.reduceat(gap, first)
    hit = np.flatnonzero(gap == np.repeat(widest, size))
    hit = hit[np.diff(part[hit], prepend=-1) > 0]
    return np.where((widest > 0) & (widest >= least), (reach[hit - 1] + low[hit]) * 0.5, np.nan)


def xy_ranks(boxes: np.ndarray, first: np.ndarray, width: float, height: float, y_down: bool = False) -> np.ndarray:
    """Each box's place in ``xy_order`` of its page, for many pages, which begin at ``first``: all are cut at once, level by level."""
    n = len(boxes)
    size = np.diff(first, append=n)
    page = np.repeat(np.arange(len(first)), size)
    odd = np.zeros(len(first), bool)
    odd[page[~np.isfinite(boxes).all(1)]] = True
    centre = np.stack([boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]], 1) / 2
    least = (max(0.02 * width, 8.0), max(0.015 * height, 6.0))
    # where a box's part begins in the order; a part is cut until neither axis has a gap
    start = np.repeat(first, size)
    ids = np.flatnonzero(~odd[page])
    while len(ids):
        cut = []
        for axis in (0, 1):
            head = np.flatnonzero(np.diff(start[ids], prepend=-1) != 0)
            many = np.diff(head, append=len(ids))
            ids = ids[np.repeat(many > 1, many)]
            many = many[many > 1]
            if not len(ids):
                break
            head = np.cumsum(many) - many
            at = _cuts(boxes[ids, axis], boxes[ids, axis + 2], head, many, least[axis])
            low = centre[ids, axis] < np.repeat(at, many)
            if axis and not y_down:
                low = ~low
            ahead = np.add.reduceat(low, head, dtype=np.int64)
            split = ~np.isnan(at) & (ahead > 0) & (ahead < many)
            mine = np.repeat(split, many)
            start[ids] += np.where(mine & ~low, np.repeat(ahead, many), 0)
            cut.append(ids[mine])
            ids = ids[~mine]
        ids = np.concatenate(cut) if cut else ids[:0]
        ids = ids[np.argsort(start[ids], kind="stable")]
    order = np.lexsort((boxes[:, 0], centre[:, 1] if y_down else -centre[:, 1], start))
    out = np.empty(n, np.int32)
    out[order] = np.arange(n)
    out -= np.repeat(first, size).astype(np.int32)
    for p in np.flatnonzero(odd):
        out[first[p] + np.array(xy_order(boxes[first[p] : first[p] + size[p]], width, height, y_down))] = np.arange(size[p])
    return out


def reading_order(boxes: DataFrame, width: float, height: float, y_down: bool = False, key: str = "page_id") -> DataFrame:
    """Boxes (page, idx, x0, y0, x1, y1) with ``reading_index`` within their page.

    Pages lie sorted in their partitions, so a batch holds many and they are cut together; the last waits for the next
    batch, as a page is what has to be looked at as a whole.
    """
    others = [c for c in boxes.columns if c != key]
    rows = boxes.select(key, *others)
    schema = T.StructType([*rows.schema.fields, T.StructField("reading_index", T.IntegerType())])

    def ranked(b: pa.Table, first: np.ndarray) -> list[pa.RecordBatch]:
        sides = np.stack([pc.cast(b[c], pa.float64()).to_numpy() for c in ("x0", "y0", "x1", "y1")], 1)
        return b.append_column("reading_index", pa.array(xy_ranks(sides, first, width, height, y_down))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # the last row that waits tells whether the page goes on
            keys = pa.chunked_array([*(k.column(0).slice(k.num_rows - 1) for k in kept[-1:]), b.column(0)]).combine_chunks()
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(code)) + (0 if kept else 1)
            if not len(first):
                kept.append(b)
                continue
            last, waited = int(first[-1]), sum(k.num_rows for k in kept)
            done = pa.Table.from_batches([*kept, b.slice(0, last)])
            yield from ranked(done, np.concatenate([[0], first[:-1] + waited]))
            kept = [b.slice(last)]
        if kept:
            yield from ranked(pa.Table.from_batches(kept), np.zeros(1, np.int64))

    sorted_ = rows.repartition(F.col(key)).sortWithinPartitions(key, "idx", *[c for c in others if c != "idx"])
    return sorted_.mapInArrow(run, schema)


# ---- glyphs --------------------------------------------------------------------------------------------------------


def is_complex(glyphs: list[tuple[float, float, float, float]], most: int = 1000, ahead: int = 9) -> bool:
    """Whether more than a twentieth of the first glyphs (left, right, top, bottom) touch one of the next ones."""
    g = glyphs[:most]
    touching = 0
    for i, (l, r, t, b) in enumerate(g):
        touching += sum(l <= r2 and l2 <= r and b <= t2 and b2 <= t for l2, r2, t2, b2 in g[i + 1 : i + 1 + ahead])
    return touching > len(g) // 20


def page_text(glyphs: pd.DataFrame) -> str:
    """Text of a page of glyphs (c, left, right, top, bottom; y grows upwards): lines, cells at wide gaps, reading order."""
    if not len(glyphs):
        return ""
    g = glyphs.assign(cy=(glyphs["top"] + glyphs["bottom"]) / 2, h=glyphs["top"] - glyphs["bottom"])
    width = float(g["right"].max() - g["left"].min())
    g = g.sort_values("cy", ascending=False, kind="stable")
    lines: dict[int, list] = {}
    for row in g.itertuples(index=False):
        own = round(row.cy / max(row.h * 0.45, 4.0))
        for step in (0, -1, 1, -2, 2):
            first = lines.get(own + step, [None])[0]
            if first is not None and abs(row.cy - first.cy) < max(max(row.h, first.h) * 0.45, 4.0):
                own += step
                break
        lines.setdefault(own, []).append(row)
    cells: list[tuple[float, float, float, float, str]] = []
    for _, line in sorted(lines.items()):
        line.sort(key=lambda r: r.left)
        text, run = line[0].c, [line[0]]
        for prev, now in zip(line, line[1:]):
            h, gap = max(prev.h, now.h), now.left - prev.right
            if gap > max(h * 1.5, 12.0):
                cells.append((*_bounds(run), text.strip()))
                text, run = "", []
            elif gap > max(h * 0.25, 2.0):
                text += " "
            text += now.c
            run.append(now)
        cells.append((*_bounds(run), text.strip()))
    cells = [c for c in cells if c[4]]
    if not cells:
        return ""
    boxes = np.array([c[:4] for c in cells])
    height = max(float(boxes[:, 3].max() - boxes[:, 1].min()), 1.0)
    out = []
    for i in xy_order(boxes, width, height):
        x0, _, x1, _, t = cells[i]
        letters = [c for c in t if c.isalpha()]
        heading = x1 - x0 > 0.6 * width and 2 < len(t.encode()) < 80 and not t.endswith(".") and all(c.isupper() for c in letters)
        out.append(f"\n# {t}\n\n" if heading else f"{t}\n")
    return "".join(out)


def _bounds(run: list) -> tuple[float, float, float, float]:
    return run[0].left, min(r.bottom for r in run), run[-1].right, max(r.top for r in run)


def glyph_text(glyphs: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, content, layout_complex) from glyphs (page, idx, c, left, right, top, bottom)."""
    kind = dict(glyphs.dtypes)[key]

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("idx")
        sides = list(page[["left", "right", "top", "bottom"]].itertuples(index=False, name=None))
        return pd.DataFrame({key: [page[key].iloc[0]], "content": [page_text(page)], "layout_complex": [is_complex(sides)]})

    return glyphs.groupBy(key).applyInPandas(run, f"`{key}` {kind}, content string, layout_complex boolean")


# ---- tables --------------------------------------------------------------------------------------------------------


def non_max_suppression(boxes: np.ndarray, scores: np.ndarray, least: float = 0.25, overlap: float = 0.45) -> list[int]:
    """Boxes kept by falling score, without those that overlap a kept one too much."""
    order = [i for i in np.argsort(-scores, kind="stable") if scores[i] >= least]
    kept: list[int] = []
    for i in order:
        a = boxes[i]
        for k in kept:
            b = boxes[k]
            inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
            if union > 0 and inter / union > overlap:
                break
        else:
            kept.append(int(i))
    return kept


def table_markdown(glyphs: pd.DataFrame, box: tuple[float, float, float, float]) -> str:
    """Markdown of the glyphs whose centres lie in a box (x0, y0, x1, y1): rows within 5 units, cells at gaps over 15."""
    cx, cy = (glyphs["left"] + glyphs["right"]) / 2, (glyphs["top"] + glyphs["bottom"]) / 2
    g = glyphs.assign(cy=cy)[(cx >= box[0]) & (cx <= box[2]) & (cy >= box[1]) & (cy <= box[3])].sort_values("cy", ascending=False, kind="stable")
    if not len(g):
        return ""
    rows: list[list] = []
    for r in g.itertuples(index=False):
        if rows and abs(rows[-1][0].cy - r.cy) <= 5:
            rows[-1].append(r)
        else:
            rows.append([r])
    lines = []
    for row in rows:
        row.sort(key=lambda r: r.left)
        cells = [row[0].c]
        for prev, now in zip(row, row[1:]):
            if now.left - prev.right > 15:
                cells.append(now.c)
            else:
                cells[-1] += now.c
        lines.append("| " + " | ".join(c.strip() for c in cells) + " |")
    n = max(x.count("|") for x in lines) - 1
    return "\n".join([lines[0], "|" + "---|" * n, *lines[1:]])


def detected_tables(detector, image: np.ndarray, glyphs: pd.DataFrame) -> str:
    """Markdown of the tables that a detector (image to boxes and scores, in the glyphs' units) finds on a page."""
    boxes, scores = detector.detect(image)
    boxes = np.asarray(boxes, np.float64).reshape(-1, 4)
    found = (table_markdown(glyphs, tuple(boxes[i])) for i in non_max_suppression(boxes, np.asarray(scores, np.float64)))
    return "\n\n".join(t for t in found if t)
