"""What needs native libraries or weights, as protocols with what can be had here.

A backend is built once by Python worker; those that aren't installed make error pages, never a failed job.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class PdfPage:
    text: str
    width: int = 0
    height: int = 0
    glyphs: list[tuple[str, float, float, float, float]] = field(default_factory=list)
    image: np.ndarray | None = None


@dataclass
class PdfDocument:
    pages: list[PdfPage]
    metadata: dict[str, str] = field(default_factory=dict)
    form_fields: dict[str, str] = field(default_factory=dict)


class PdfBackend(Protocol):
    def open(self, data: bytes, password: str | None, max_pages: int | None) -> PdfDocument: ...


class OcrBackend(Protocol):
    def read(self, image: np.ndarray) -> str: ...


class TableDetector(Protocol):
    def detect(self, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Pypdf:
    """Text, document tags and form values through pypdf, if it is installed."""

    def open(self, data: bytes, password: str | None, max_pages: int | None) -> PdfDocument:
        import io

        import pypdf

        r = pypdf.PdfReader(io.BytesIO(data), password=password or None)
        pages = [PdfPage(p.extract_text() or "", int(p.mediabox.width), int(p.mediabox.height)) for p in r.pages[:max_pages]]
        tags = {k.lstrip("/"): str(v) for k, v in (r.metadata or {}).items()}
        return PdfDocument(pages, tags, {k: str(v) for k, v in (r.get_form_text_fields() or {}).items() if v is not None})


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:\\.|[^\]])*\]\s*TJ|T\*|T[dDm]\b|'|\bET\b", re.S)
_MEDIA = re.compile(rb"/MediaBox\s*\[\s*" + rb"\s+".join([rb"(-?[0-9.]+)"] * 4) + rb"\s*\]")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:\((?:\\.|[^\\()])*\)|[^\]()])*\]|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)|/[^\s/<>\[\](){}%]+|[A-Za-z'\"]+\*?", re.S)
_PIECE = re.compile(rb"\((?:\\.|[^\\()])*\)|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", re.S)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


class FlatePdf:
    """Text of simple PDFs with the standard library alone: content streams, plain or deflated, in the order of the file.

    No fonts are decoded, so it reads Latin text of unsubsetted fonts only; a stream that shows text is a page. Glyph boxes
    follow the text matrices, with the widths of a common sans-serif font; rotated text isn't followed.
    """

    def open(self, data: bytes, password: str | None, max_pages: int | None) -> PdfDocument:
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        if b"/Encrypt" in data:
            raise PermissionError("encrypted")
        pages = []
        box = _MEDIA.search(data)
        sides = [float(x) for x in box.groups()] if box else [0.0] * 4
        size = round(sides[2] - sides[0]), round(sides[3] - sides[1])
        for m in _STREAM.finditer(data):
            raw = m[1]
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                pass
            if b"BT" in raw and (t := self._text(raw)):
                pages.append(PdfPage(t, *size, self._glyphs(raw)))
            if max_pages and len(pages) >= max_pages:
                break
        return PdfDocument(pages)

    def _text(self, raw: bytes) -> str:
        out: list[str] = []
        for m in _SHOWN.finditer(raw):
            s = m[0]
            if s[:1] in b"([":
                # a wide step to the right between strings of an array is a blank
                out += [_plain(x) if x[:1] == b"(" else " " for x in _PIECE.findall(s) if x[:1] == b"(" or float(x) < -200]
            elif out and out[-1] != "\n":
                out.append("\n")
        return "".join(out).strip()

    def _glyphs(self, raw: bytes) -> list[tuple[str, float, float, float, float]]:
        """(sign, left, right, top, bottom), y upwards; blanks only move on."""
        out: list[tuple[str, float, float, float, float]] = []
        held: list = []
        size, leading, at, x, y = 1.0, 0.0, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 0.0, 0.0

        def move(dx: float, dy: float) -> None:
            nonlocal x, y
            at[4] += dx * at[0] + dy * at[2]
            at[5] += dx * at[1] + dy * at[3]
            x, y = at[4], at[5]

        def show(text: str) -> None:
            nonlocal x
            wide, high = size * abs(at[0]), size * abs(at[3])
            for c in text:
                end = x + wide * _width(c)
                if not c.isspace():
                    out.append((c, x, end, y + high, y))
                x = end

        for m in _TOKEN.finditer(raw):
            t = m[0]
            if t[:1] in b"([":
                held.append(t)
                continue
            if t[:1] in b"+-.0123456789":
                held.append(float(t))
                continue
            n = [v for v in held if isinstance(v, float)]
            if t == b"BT":
                at, x, y = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 0.0, 0.0
            elif t == b"Tf" and n:
                size = n[-1]
            elif t == b"TL" and n:
                leading = n[-1]
            elif t in (b"Td", b"TD") and len(n) > 1:
                leading = -n[-1] if t == b"TD" else leading
                move(n[-2], n[-1])
            elif t == b"Tm" and len(n) > 5:
                at = n[-6:]
                x, y = at[4], at[5]
            elif t in (b"T*", b"'", b'"'):
                move(0.0, -leading)
            if t in (b"Tj", b"TJ", b"'", b'"') and held and isinstance(held[-1], bytes):
                for piece in _PIECE.finditer(held[-1]):
                    if piece[0][:1] == b"(":
                        show(_plain(piece[0]))
                    else:
                        x -= float(piece[0]) / 1000 * size * abs(at[0])
            held = []
        return out


def _plain(s: bytes) -> str:
    """A string in parentheses with its escapes undone."""
    return _ESCAPED.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), s[1:-1]).decode("latin-1")


def _width(c: str) -> float:
    return 0.28 if c in " .,:;!'|ijlftI()[]/-" else 0.85 if c in "mwMW@%" else 0.68 if c.isupper() else 0.54


def pdf_backend(name: str = "auto") -> PdfBackend:
    if name in ("auto", "pypdf"):
        try:
            import pypdf  # noqa: F401

            return Pypdf()
        except ImportError:
            if name == "pypdf":
                raise
    return FlatePdf()


REPAIRS = {
    "normal": (("qpdf", "--linearize", "{in}", "{out}"), ("gs", "-q", "-o", "{out}", "-sDEVICE=pdfwrite", "{in}")),
    "aggressive": (("qpdf", "--qdf", "--stream-data=uncompress", "{in}", "{out}"), ("qpdf", "--linearize", "{in}", "{out}"), ("gs", "-q", "-o", "{out}", "-sDEVICE=pdfwrite", "{in}")),
}


def repaired(data: bytes, level: str = "normal") -> Iterator[tuple[str, bytes]]:
    """(tool, bytes) of each outside repair that works, on copies in the worker's own folder; the input is never changed."""
    import pathlib
    import shutil
    import subprocess
    import tempfile

    for command in REPAIRS[level]:
        if not shutil.which(command[0]):
            continue
        with tempfile.TemporaryDirectory() as d:
            a, b = pathlib.Path(d, "in.pdf"), pathlib.Path(d, "out.pdf")
            a.write_bytes(data)
            subprocess.run([x.format(**{"in": a, "out": b}) for x in command], capture_output=True, timeout=120)
            if b.exists() and b.stat().st_size:
                yield command[0], b.read_bytes()


def open_pdf(data: bytes, backend: PdfBackend, password: str | None = None, max_pages: int | None = None, repair: bool = False, level: str = "normal") -> tuple[PdfDocument | None, dict[str, str]]:
    """(document or None, what opening it took)."""
    try:
        return backend.open(data, password or None, max_pages), {"pdf_open": "ok"}
    except PermissionError as e:
        return None, {"pdf_open_failed": "true", "pdf_error": str(e), "pdf_encrypted": "true"}
    except Exception as e:
        failed = {"pdf_open_failed": "true", "pdf_error": f"{type(e).__name__}: {e}"[:300]}
    if repair:
        tried = False
        for tool, better in repaired(data, level):
            tried = True
            try:
                return backend.open(better, password or None, max_pages), {"pdf_open": "repaired", "repair_level": level, "repair_method": tool, "xref_repaired": "true"}
            except Exception:
                failed["repair_retry_failed"] = "true"
        if not tried:
            failed["external_repair_skipped"] = "no tool is installed"
    return None, failed


class HashingEmbedder:
    """Deterministic vectors from hashed words: texts that share words are near. For tests and for want of weights."""

    def __init__(self, size: int = 384):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        h = np.fromiter((_word_hash(w) for ws in words for w in ws), np.int64)
        at = np.repeat(np.arange(len(texts)), [len(ws) for ws in words]) * self.size + h % self.size
        signs = np.where(h & 0x80000000, 1.0, -1.0)
        return np.bincount(at, signs, len(texts) * self.size).reshape(len(texts), self.size).astype(np.float32)


@lru_cache(1 << 17)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class OnnxEmbedder:
    """Mean-pooled vectors of a model file; the session is made once by worker."""

    def __init__(self, model: str, vocabulary: str, size: int = 384):
        self.model, self.vocabulary, self.size, self._session = model, vocabulary, size, None

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        import onnxruntime

        if self._session is None:
            self._session = onnxruntime.InferenceSession(self.model), WordPiece.load(self.vocabulary)
        session, words = self._session
        ids = [words.encode(t) for t in texts]
        wide = max(map(len, ids), default=1)
        a, m = np.zeros((len(ids), wide), np.int64), np.zeros((len(ids), wide), np.int64)
        for i, x in enumerate(ids):
            a[i, : len(x)], m[i, : len(x)] = x, 1
        feeds = {"input_ids": a, "attention_mask": m, "token_type_ids": np.zeros_like(a)}
        out = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        return (out * m[:, :, None]).sum(1) / np.maximum(m.sum(1)[:, None], 1)


class WordPiece:
    """Lower-case words split by the longest pieces of a vocabulary; a word with no split is one unknown."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    @classmethod
    def load(cls, path: str) -> WordPiece:
        with open(path, encoding="utf-8") as f:
            return cls({w.rstrip("\n"): i for i, w in enumerate(f)})

    def encode(self, text: str) -> list[int]:
        v = self.vocabulary
        out = [v["[CLS]"]]
        for word in text.lower().split():
            at = 0
            while at < len(word):
                mark = "##" if at else ""
                end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in v), None)
                if end is None:
                    out.append(v["[UNK]"])
                    break
                out.append(v[mark + word[at:end]])
                at = end
        return [*out, v["[SEP]"]]


def _vectors(embedder: Embedder, texts: list[str], batch: int) -> list[np.ndarray]:
    """Vectors of texts; those whose batch fails get zeros, which is similar to nothing."""
    rows: list[np.ndarray] = []
    for k in range(0, len(texts), batch):
        try:
            rows += list(np.asarray(embedder.embed(texts[k : k + batch]), np.float32))
        except Exception:
            rows += [np.zeros(embedder.size, np.float32)] * len(texts[k : k + batch])
    return rows


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 16) -> DataFrame:
    """Adds a vector column; texts whose batch fails get zeros, which is similar to nothing."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(_vectors(embedder, [t or "" for t in p], batch), dtype="object")

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def similarities(sentences: Column, embedder: Embedder, batch: int = 16, rows: int = 64) -> Column:
    """array<double> of each sentence's similarity to the one before it, null at the first: as ``embed`` and ``vectors.adjacent``,
    but the vectors stay where they are made. ``rows`` arrays are looked at together."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            if not len(p):
                yield pa.array([], pa.list_(pa.float64()))
            for k in range(0, len(p), rows):
                lists = p.slice(k, rows).to_pylist()
                ends = np.cumsum([len(x or ()) for x in lists])
                v = np.array(_vectors(embedder, [t or "" for x in lists for t in x or ()], batch), np.float64).reshape(ends[-1], embedder.size)
                norm = np.sqrt((v * v).sum(1))
                norm = norm[1:] * norm[:-1]
                sims, first = np.zeros(len(v)), np.zeros(len(v), bool)
                np.divide((v[1:] * v[:-1]).sum(1), norm, out=sims[1:], where=~(norm <= 0))
                first[[e - len(x) for e, x in zip(ends, lists) if x]] = True
                yield pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(sims, pa.float64(), mask=first))

    return F.arrow_udf(run, "array<double>")(sentences)


# ---- images --------------------------------------------------------------------------------------------------------


def stretch(rgb: np.ndarray, mode: str = "quality") -> np.ndarray:
    """Grey levels stretched over the whole range; the fast mode leaves the image as it is."""
    if mode == "fast":
        return rgb
    grey = rgb.astype(np.uint32).sum(-1) // 3
    low, span = grey.min(initial=255), max(int(grey.max(initial=0)) - int(grey.min(initial=255)), 1)
    flat = ((grey - low) / np.float32(span) * 255.0).astype(np.uint8)
    return np.repeat(flat[..., None], 3, -1)


def scaled_width(width: int, scale: float) -> int:
    return int(width * min(max(scale, 0.5), 3.0))


def vision_scales(base: float) -> list[float]:
    b = min(max(base, 0.75), 2.0)
    return [1.0, 1.5] if abs(b - 1.5) < 0.01 else [b, min(b * 1.5, 3.0)]


def best_candidate(candidates: list[tuple[float, str]]) -> str:
    """Most letters, digits and blanks, then most bytes; the last of equals."""
    score = lambda t: (sum(c.isalnum() or c.isspace() for c in t), len(t.encode()))
    best = ""
    for k, (_, t) in enumerate(candidates):
        if not k or score(t) >= score(best):
            best = t
    return best
