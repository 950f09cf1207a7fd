"""Options of a run: parsed and checked on the driver, then fixed."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, replace

from folioflow.functions.pii import mode_of

_CHOICES = {
    "layout_mode": {"auto": "auto", "bulk": "bulk", "fast": "bulk", "multi_column": "multi_column", "multicolumn": "multi_column", "layout": "multi_column"},
    "backend": {"auto": "auto", "pypdf": "pypdf", "flate": "flate"},
    "strategy": {"fast": "fast", "hi_res": "hi_res", "hi-res": "hi_res", "hires": "hi_res", "ocr": "ocr", "auto": "auto"},
    "repair_level": {"normal": "normal", "aggressive": "aggressive"},
    "ocr_mode": {"fast": "fast", "quality": "quality", "high": "quality", "hybrid": "hybrid", "vision": "vision"},
}


def choice(option: str, value: str | None) -> str | None:
    """The canonical value, whatever the case; ValueError for an unknown one."""
    if value is None:
        return None
    try:
        return _CHOICES[option][value.lower()]
    except KeyError:
        raise ValueError(f"unknown {option} '{value}': {', '.join(dict.fromkeys(_CHOICES[option].values()))}") from None


@dataclass(frozen=True)
class Options:
    chunk_size: int = 1000
    child_chunk_size: int | None = None
    use_cache: bool = False
    use_ocr: bool = False
    use_embeddings: bool = False
    use_vlm: bool = False
    pattern: str | None = None
    max_pages: int | None = None
    layout_mode: str = "auto"
    fast_chunk: bool | None = None
    doc_chunking: bool = False
    chunk_pages: bool = True
    backend: str = "auto"
    strategy: str | None = None
    repair_pdf: bool = False
    repair_level: str = "normal"
    ocr_mode: str = "fast"
    ocr_render_scale: float = 1.0
    pdf_password: str | None = None
    ingest_archives: bool = False
    pii_mode: str = "off"

    @classmethod
    def of(cls, **given) -> Options:
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        o = cls(**given)
        if o.chunk_size < 1 or (o.child_chunk_size is not None and o.child_chunk_size < 1) or (o.max_pages is not None and o.max_pages < 1):
            raise ValueError("sizes and limits must be at least 1")
        if o.pattern is not None:
            try:
                re.compile(o.pattern)
            except re.error as e:
                raise ValueError(f"invalid pattern: {e}") from None
        fixed = {k: choice(k, getattr(o, k)) for k in _CHOICES}
        scale = min(max(o.ocr_render_scale, 0.5), 3.0)
        return replace(o, **fixed, pii_mode=mode_of(o.pii_mode), pdf_password=o.pdf_password or None, ocr_render_scale=scale).planned()

    def planned(self) -> Options:
        """The strategy's say in the other options, and defaults that depend on them."""
        o = self
        if o.strategy == "hi_res":
            o = replace(o, layout_mode="multi_column" if o.layout_mode == "auto" else o.layout_mode)
        elif o.strategy == "ocr":
            o = replace(o, use_ocr=True)
        elif o.strategy == "fast":
            o = replace(o, use_ocr=False, use_vlm=False, use_embeddings=False, layout_mode="bulk")
        return replace(o, fast_chunk=not o.use_embeddings if o.fast_chunk is None else o.fast_chunk)

    def result_options(self) -> dict:
        """Those that change what a file yields: the cache's fingerprint."""
        return {k: v for k, v in asdict(self).items() if k not in ("use_cache", "pattern", "ingest_archives")}
