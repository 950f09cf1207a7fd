"""Recognition of page images: when it runs, on which candidates, and how its text joins the page's own.

The gate is an expression, so only pages that need it carry their image to Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.sources.backends import OcrBackend, best_candidate, scaled_width, stretch, vision_scales

#: An image is its RGB bytes with its height and width.
IMAGE = "struct<rgb: binary, height: int, width: int>"


def resized(rgb: np.ndarray, width: int) -> np.ndarray:
    """The image at another width, by nearest pixels."""
    h, w = rgb.shape[:2]
    width = max(1, width)
    height = max(1, round(h * width / max(w, 1)))
    return rgb[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def read_image(ocr: OcrBackend, rgb: np.ndarray, mode: str, base: float = 1.0) -> tuple[str, list[str]]:
    """(text, scales tried): vision takes the best of several scales, other modes the image as it is."""
    if mode != "vision":
        return ocr.read(stretch(rgb, "fast" if mode == "fast" else "quality")), []
    tried = [(s, ocr.read(resized(stretch(rgb), scaled_width(rgb.shape[1], s)))) for s in vision_scales(base)]
    return best_candidate(tried), [f"{s:.2f}" for s, _ in tried]


def _reader(ocr: OcrBackend, base: float):
    def run(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for images, modes in parts:
            out = []
            for rgb, h, w, mode in zip(images["rgb"], images["height"], images["width"], modes):
                try:
                    out.append((None, []) if rgb is None else read_image(ocr, np.frombuffer(rgb, np.uint8).reshape(int(h), int(w), 3), mode, base))
                except Exception as e:
                    out.append((None, [f"ocr_failed:{type(e).__name__}"]))
            yield pd.DataFrame(out, columns=["text", "notes"])

    return F.pandas_udf(run, "text string, notes array<string>")


def recognise(pages: DataFrame, use_ocr: bool, mode: str = "fast", strategy_ocr: bool = False, ocr: OcrBackend | None = None, scale: float = 1.0) -> DataFrame:
    """Pages (content, width, height, layout_complex, image, warnings) with recognised text where it is wanted.

    Adds ocr_used and the warnings; drops layout_complex and image. A broken page that would be read in the fast mode is
    read in quality.
    """
    pages = text.fenced(pages, "content")
    n = F.octet_length("content")
    density = text.text_density(n, F.col("width"), F.col("height"))
    pages = pages.withColumns({"__garbled": text.garbled(F.col("content")), "__hybrid": text.hybrid_ocr(n, density, F.col("layout_complex"), F.lit(mode == "hybrid" or strategy_ocr))})
    pages = pages.withColumn("__broken", text.broken_page(n, density, F.col("__garbled"), F.lit(mode == "fast")))
    run = text.ocr_wanted(F.col("content"), F.lit(use_ocr), F.col("__hybrid"), F.col("__broken"))
    pages = text.fenced(pages.withColumn("__run", run), "__run", "__garbled", "__hybrid", "__broken")
    wanted, shown = F.col("__run"), F.col("image").isNotNull()
    read = F.lit(None).cast("struct<text: string, notes: array<string>>")
    if ocr is not None and use_ocr:
        read = _reader(ocr, scale)(F.when(wanted, F.col("image")), F.when(F.col("__broken") & F.lit(mode == "fast"), "quality").otherwise(mode))
    pages = pages.withColumn("__read", read)
    used = wanted & shown & (text.trim(F.coalesce(F.col("__read.text"), F.lit(""))) != "")
    pages = text.fenced(pages.withColumn("__used", F.coalesce(used, F.lit(False))), "__used")
    merged = F.col("__hybrid") & (text.trim(F.col("content")) != "")

    def note(when: Column, what: Column | str) -> Column:
        return F.when(when, F.lit(what) if isinstance(what, str) else what)

    failed = F.filter("__read.notes", lambda x: x.startswith("ocr_failed"))
    scales = F.filter("__read.notes", lambda x: ~x.startswith("ocr_failed"))
    notes = F.array_compact(
        F.array(
            note(F.col("__used") & merged, "hybrid_ocr_merged"),
            note(F.col("__used") & F.col("__broken"), "page_recovered"),
            note(F.col("__used") & (F.size(scales) > 0), F.concat(F.lit("ocr_scales_tried:"), F.array_join(scales, ","))),
            note(wanted & shown & F.lit(ocr is None), "ocr_requested_but_engine_unavailable"),
            note(wanted & ~shown, "ocr_skipped_no_image"),
            note(F.size(failed) > 0, F.get(failed, F.lit(0))),
            note(F.col("__garbled") & ~F.col("__used"), "garbled_native_text"),
        )
    )
    done = pages.withColumns(
        {
            "content": F.when(F.col("__used"), text.merged_ocr(F.col("content"), F.col("__read.text"), F.col("__hybrid"))).otherwise(F.col("content")),
            "ocr_used": F.col("__used"),
            "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), notes),
        }
    )
    return done.drop("image", "layout_complex", "__garbled", "__hybrid", "__broken", "__run", "__read", "__used")
