"""Registered queries over small made files and tables, with their expected rows as SQL.

The files are written to the folder all executors share, by name, so the plans run as they do on a real directory.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import chunking, elements, text, vectors
from folioflow.operators import cache, export, layout, report
from folioflow.operators import pages as page_ops
from folioflow.plans.catalog import _register, table
from folioflow.plans.ingest import ingest, ingest_text, pages_of
from folioflow.plans.options import Options
from folioflow.sources import files as sources
from folioflow.sources import formats
from folioflow.sources.backends import PdfDocument, PdfPage, WordPiece, open_pdf

# ---- fixtures ------------------------------------------------------------------------------------------------------


def zipped(files: dict[str, str | bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return b.getvalue()


_W = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
_DOCX = f"<w:document {_W}><w:body><w:p><w:r><w:t>Tea</w:t></w:r><w:r><w:t xml:space='preserve'> time</w:t><w:tab/><w:t>at</w:t><w:br/><w:t>five.</w:t></w:r></w:p><w:p><w:r><w:t>Next.</w:t></w:r></w:p></w:body></w:document>"
_HEAD = f"<w:hdr {_W}><w:p><w:r><w:t>Above</w:t></w:r></w:p></w:hdr>"
_SLIDE = "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>"
_BOOK = {
    "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='Costs' sheetId='1' r:id='rId1'/></sheets></workbook>",
    "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>",
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1'><v>2.5</v></c></row><row r='2'><c r='A2'><v>7.0</v></c><c r='B2' t='b'><v>1</v></c></row></sheetData></worksheet>",
    "xl/sharedStrings.xml": "<sst><si><t>Sum</t></si></sst>",
}
_ODF = "<o:c xmlns:o='o' xmlns:text='t'><text:h>Part</text:h><text:p>One<text:tab/>two<text:s text:c='2'/><text:span>three</text:span></text:p></o:c>"
_PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (Page \\(one\\)) Tj T* [(Wo) 3 (rld)] TJ ET\nendstream\nendobj"
_MULTI = 'From: x@y.z\nContent-Type: multipart/alternative; boundary="B1"\n\n--B1\nContent-Type: text/html\n\n<p>no</p>\n--B1\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--B1--\n'

#: name: (content, expected pages as (text, label), warning, whether it fails)
FILES: dict[str, tuple[str | bytes, list[tuple[str, str | None]], str, bool]] = {
    "a.txt": ("Just a line.", [("Just a line.", None)], "", False),
    "b.md": ("# Head\n\nBody", [("# Head\n\nBody", None)], "", False),
    "c.rst": ("Top\n===", [("Top\n===", None)], "", False),
    "d.tex": ("\\section{A}", [("\\section{A}", None)], "", False),
    "e.yaml": ("k: v", [("k: v", None)], "", False),
    "f.log": ("12:00 up", [("12:00 up", None)], "", False),
    "g.py": ("print(1)\n", [("print(1)\n", None)], "", False),
    "h.csv": ("p,q \n1,2\n", [("p,q\n1,2", None)], "", False),
    "i.json": ('{"z":"x","n":1,"e":null,"l":[1,"two"]}', [("l:\n1\ntwo\nn: 1\nz: x", None)], "", False),
    "j.ndjson": ('{"b":2,"a":1}\n\nnot json\n', [("a: 1 | b: 2\nnot json", None)], "", False),
    "k.HTML": ("<h1>Hi</h1><script>x()</script><p>a&amp;b</p>", [("Hi\n\n a&b", None)], "", False),
    "l.xml": ("<r><i>ok</i> <i>so</i></r>", [("ok so", None)], "", False),
    "m.rtf": (r"{\rtf1\ansi One \par Two\tab x}", [("One\nTwo\tx", None)], "", False),
    "n.eml": ("From: x@y.z\r\nSubject: Tea\r\nX-Own: no\r\n\r\nAt five\r\n", [("From: x@y.z\nSubject: Tea\n\nAt five", None)], "", False),
    "o.eml": (_MULTI, [("From: x@y.z\n\nhello", None)], "", False),
    "p.mbox": ("From q Mon\nSubject: one\n\nfirst\n\nFrom q Tue\nSubject: two\n\nsecond\n", [("Subject: one\n\nfirst\n\n---\n\nSubject: two\n\nsecond", None)], "", False),
    "q.msg": ("no compound file", [("", None)], "pdf_open_failed", True),
    "r.docx": (zipped({"word/document.xml": _DOCX, "word/header1.xml": _HEAD}), [("Tea time\tat\nfive.\nNext.\n\nAbove", None)], "", False),
    "s.pptx": (zipped({"ppt/slides/slide10.xml": _SLIDE.format("ten"), "ppt/slides/slide2.xml": _SLIDE.format("two")}), [("two", "slide2"), ("ten", "slide10")], "", False),
    "t.xlsx": (zipped(_BOOK), [("| Sum | 2.5 |\n|---|---|\n| 7 | true |", "Costs")], "", False),
    "u.odt": (zipped({"content.xml": _ODF}), [("Part\nOne\ttwo  three", None)], "", False),
    "v.epub": (zipped({"b.xhtml": "<p>Second</p>", "a.html": "<p>First</p>", "x.css": ""}), [("First", "chapter1"), ("Second", "chapter2")], "", False),
    "w.doc": ("old", [("Legacy binary document: convert it to the current format to extract its text.", None)], "legacy_office_deferred", False),
    "x.png": ("no image", [("", None)], "image_without_ocr", False),
    "y.pdf": (_PDF, [("Page (one)\nWorld", None)], "", False),
    "z.pdf": ("broken", [("", None)], "pdf_open_failed", True),
    "bad.json": ("{", [("", None)], "pdf_open_failed", True),
    "latin.txt": (b"\xff\xfe\xfa", [("", None)], "", False),
    "locked.pdf": (b"%PDF-1.4 /Encrypt", [("", None)], "pdf_open_failed", True),
    "none.md": ("", [("", None)], "", False),
    "sub/deep.txt": ("Below.", [("Below.", None)], "", False),
    "skip.exe": ("no", [], "", False),
}
ARCHIVE = {"d/a.txt": "first", "e/a.txt": "second", "../up.txt": "out", "n.zip": "x", "n.exe": "x"}


def _shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return f"{named.rstrip('/') if named else 'file://' + tempfile.mkdtemp(prefix='folioflow-')}/fixtures-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, files: dict[str, str | bytes]) -> str:
    at, jvm = _shared(spark), spark.sparkContext._jvm
    for name, body in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(body.encode() if isinstance(body, str) else body))
        out.close()
    return at


def _docs(spark: SparkSession) -> str:
    return _folder(spark, {k: v[0] for k, v in FILES.items()})


def _quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, int, float)):
        return str(v).upper() if isinstance(v, bool) else repr(v)
    body = "' || chr(10) || '".join(x.replace("'", "''") for x in v.split("\n")).replace("\t", "' || chr(9) || '")
    return f"('{body}')"


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of (name type, ...) columns."""
    names, types = zip(*(c.split() for c in columns.split(", ")))
    return f"SELECT {', '.join(f'{n}::{t} AS {n}' for n, t in zip(names, types))} FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) v({', '.join(names)})"



def _name():
    return F.element_at(F.split("path", "/"), -1).alias("name")


# ---- files ---------------------------------------------------------------------------------------------------------

_PAGES = [(name.rpartition("/")[2], i, t, label, warning, fails) for name, (_, pages, warning, fails) in FILES.items() for i, (t, label) in enumerate(pages)]


def _told(pages: DataFrame) -> DataFrame:
    m = F.col("metadata")
    label = F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in ("sheet", "slide", "chapter")])
    return pages.select(_name(), "page_index", "content", label.alias("label"), F.array_join("warnings", ",").alias("warnings"), F.col("error").isNotNull().alias("failed"))


@_register("file_pages", _values("name VARCHAR, page_index INTEGER, content VARCHAR, label VARCHAR, warnings VARCHAR, failed BOOLEAN", _PAGES))
def file_pages(spark, d):
    """A folder of one file of each kind to pages: dispatch, parsers, labels, warnings and error pages."""
    return _told(ingest(spark, _docs(spark)))


@_register("stream_pages", _values("name VARCHAR, page_index INTEGER, content VARCHAR, label VARCHAR, warnings VARCHAR, failed BOOLEAN", [r for r in _PAGES if r[0] != "none.md"]))
def stream_pages(spark, d):
    """The same folder as a stream, twice: the second run has no new files. Files without a byte make no rows."""
    from folioflow.streaming.ingest import ingest_stream

    docs, at = _docs(spark), _shared(spark)
    for _ in range(2):
        q = ingest_stream(spark, docs, f"{at}/pages", f"{at}/checkpoint")
        q.awaitTermination()
    return _told(spark.read.parquet(f"{at}/pages"))


@_register("stream_report", _values("extension VARCHAR, files BIGINT, bytes BIGINT", [("eml", 2, len(FILES["n.eml"][0]) + len(_MULTI)), ("json", 2, len(FILES["i.json"][0]) + 1), ("yaml", 1, 4)]))
def stream_report(spark, d):
    """Files of a stream by extension and window of time, the windows added up again."""
    from folioflow.streaming.ingest import file_stream, report_stream

    name = f"files_{uuid.uuid4().hex}"
    q = report_stream(file_stream(spark, _docs(spark))).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).where(F.col("extension").isin("eml", "json", "yaml")).groupBy("extension").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


@_register("file_listing", _values("name VARCHAR, ext VARCHAR, length BIGINT", [(n, n.rpartition(".")[2].lower(), len(FILES[n][0])) for n in ("h.csv", "i.json", "k.HTML")]))
def file_listing(spark, d):
    """Recursive listing by extension and name."""
    return sources.listing(spark, _docs(spark), "^[hik]").select(_name(), "ext", "length")


@_register("archive_pages", _values("member VARCHAR, content VARCHAR, failed BOOLEAN", [("d/a.txt", "first", False), ("e/a.txt", "second", False), ("", "", True), ("", "", True)]))
def archive_pages(spark, d):
    """Archives: members keep their paths; what climbs out, nests or isn't supported is left out; damage is an error page."""
    at = _folder(spark, {"all.zip": zipped(ARCHIVE), "nothing.zip": zipped({"n.exe": "x"}), "damaged.zip": "PK"})
    got = ingest(spark, at, ingest_archives=True)
    return got.select(F.when(F.col("path").contains("!/"), F.substring_index("path", "!/", -1)).otherwise("").alias("member"), "content", F.col("error").isNotNull().alias("failed"))


_KIND = {**{e: "plain" for e in "c cpp cs go h java js log md php py rb rs rst tex ts txt yaml yml".split()}, **{e: "image" for e in "bmp jpeg jpg png tif tiff webp".split()}, **{e: "other" for e in "csv doc docx eml epub htm html json mbox msg ndjson odp ods odt pdf ppt pptx rtf xls xlsx xml zip".split()}}


@_register("format_catalogue", _values("ext VARCHAR, kind VARCHAR", sorted(_KIND.items())))
def format_catalogue(spark, d):
    rows = [(e, "plain" if formats.is_plain_text(e) else "image" if formats.is_image(e) else "other") for e in sorted(formats.SUPPORTED)]
    return spark.createDataFrame(rows, "ext string, kind string")


@_register("drained_texts", _values("k INTEGER, content VARCHAR", list(enumerate(p[0][0] for p in (FILES[n][1] for n in ("a.txt", "b.md", "c.rst", "d.tex"))))))
def drained_texts(spark, d):
    """Texts in the order of path and page, drained row by row."""
    got = list(export.iterate(ingest_text(spark, _docs(spark), pattern="^[abcd][.]")))
    return spark.createDataFrame([(k, r["content"]) for k, r in enumerate(got)], "k int, content string")


@_register("page_cache", _values("run INTEGER, pages BIGINT, stored BIGINT, same BOOLEAN", [(1, 4, 4, True), (2, 4, 4, True), (3, 4, 8, True)]))
def page_cache(spark, d):
    """The same run twice stores once; a run with another chunk size misses."""
    docs, at, rows, first = _docs(spark), f"{_shared(spark)}/cache", [], None
    for run, size in ((1, 1000), (2, 1000), (3, 500)):
        got = sorted((r["path"], r["content"]) for r in ingest(spark, docs, cache_dir=at, use_cache=True, pattern="^[abcd][.]", chunk_size=size).collect())
        first = first or got
        rows.append((run, len(got), spark.read.parquet(at).count(), got == first))
    return spark.createDataFrame(rows, "run int, pages long, stored long, same boolean")


_CHUNKERS = [("whole", "One. Two.\n\nThree four.", 0), ("fast", "One. Two.", 0), ("fast", "Three four.", 1), ("document", "One. Two.", 0), ("document", "Three four.", 1), ("structural", "One", 0), ("structural", ". Two.", 1), ("structural", "Three", 2), ("structural", "four.", 3)]


@_register("chunker_choice", _values("how VARCHAR, chunk VARCHAR, chunk_index INTEGER", _CHUNKERS))
def chunker_choice(spark, d):
    """One text through each chunker that the options choose."""
    at, out = _folder(spark, {"t.txt": "One. Two.\n\nThree four."}), None
    for how, o in (("whole", {"chunk_pages": False}), ("fast", {"chunk_size": 12}), ("document", {"chunk_size": 12, "doc_chunking": True}), ("structural", {"chunk_size": 7, "fast_chunk": False})):
        one = ingest(spark, at, **o).select(F.lit(how).alias("how"), F.posexplode("chunks").alias("chunk_index", "chunk")).select("how", "chunk", "chunk_index")
        out = one if out is None else out.unionByName(one)
    return out


# ---- made PDF pages: glyphs, recognition, tables -------------------------------------------------------------------


class MadePdf:
    """Pages with images and glyphs: blank, few signs under overlapping glyphs, plain, garbled, two columns."""

    def open(self, data: bytes, password: str | None, max_pages: int | None) -> PdfDocument:
        image = np.full((4, 6, 3), 90, np.uint8)
        near = [(c, float(i), i + 9.0, 110.0, 100.0) for i, c in enumerate("cells here")]
        columns = _line("left a", 0, 100) + _line("right a", 300, 100) + _line("left b", 0, 80) + _line("right b", 300, 80)
        pages = [PdfPage("", 100, 100, image=image), PdfPage("few", 100, 100, near, image), PdfPage("plain " * 40, 100, 100), PdfPage("\ufffd\x01 " * 20, 100, 100), PdfPage("left a right a left b right b", 600, 800, columns)]
        return PdfDocument(pages[:max_pages], {"Title": "Made"}, {"name": "Ann"})


class MadeOcr:
    def read(self, image: np.ndarray) -> str:
        return f"seen {image.shape[1]}x{image.shape[0]} {int(image.max())}"


class MadeTables:
    def detect(self, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[0, 0, 200, 200], [1, 1, 200, 200], [0, 0, 1, 1]]), np.array([0.9, 0.8, 0.1])


def _line(s: str, x: float, y: float, size: float = 10.0, step: float = 6.0) -> list[tuple[str, float, float, float, float]]:
    return [(c, x + i * step, x + (i + 1) * step - 0.5, y + size, y) for i, c in enumerate(s) if c != " "]


_READ = [
    ("off", 0, "", False, ""), ("off", 1, "few", False, ""), ("off", 2, "plain " * 40, False, ""), ("off", 4, "left a right a left b right b", False, ""),
    ("fast", 0, "seen 6x4 90", True, ""), ("fast", 1, "few", False, ""), ("fast", 4, "left a right a left b right b", False, ""),
    ("vision", 0, "seen 9x6 0", True, "page_recovered,ocr_scales_tried:1.00,1.50"), ("vision", 1, "seen 9x6 0", True, "page_recovered,ocr_scales_tried:1.00,1.50"), ("vision", 4, "left a right a left b right b", False, ""),
    ("hybrid", 0, "seen 6x4 0", True, "page_recovered"), ("hybrid", 1, "few\n\n### OCR supplement:\nseen 6x4 0", True, "hybrid_ocr_merged,page_recovered"),
    ("no engine", 0, "", False, "ocr_requested_but_engine_unavailable"),
    ("tables", 0, "", False, ""), ("tables", 1, "few\n\n### VLM Extracted:\n| cells here |\n|---|\n\n", False, ""),
    ("columns", 4, "left a\nleft b\nright a\nright b\n", False, ""),
]
_RUNS = {
    "off": ({}, (0, 1, 2, 4)), "fast": ({"use_ocr": True, "ocr": MadeOcr()}, (0, 1, 4)), "vision": ({"use_ocr": True, "ocr_mode": "vision", "ocr": MadeOcr()}, (0, 1, 4)), "hybrid": ({"use_ocr": True, "ocr_mode": "hybrid", "ocr": MadeOcr()}, (0, 1)),
    "no engine": ({"use_ocr": True, "ocr_mode": "quality"}, (0,)), "tables": ({"use_vlm": True, "tables": MadeTables()}, (0, 1)), "columns": ({"strategy": "hi_res"}, (4,)),
}


def _made(spark: SparkSession) -> DataFrame:
    """One file in one partition: empty ones would start Python workers as well."""
    return spark.createDataFrame([("made.pdf", 1, None, bytearray(b"x"), "pdf")], "path string, length long, modificationTime timestamp, content binary, ext string").coalesce(1)


@_register("page_recognition", _values("how VARCHAR, page_index INTEGER, content VARCHAR, ocr_used BOOLEAN, warnings VARCHAR", _READ))
def page_recognition(spark, d):
    """Made pages under each recognition mode, with a table detector, and in columns."""
    out = None
    for how, (options, pages) in _RUNS.items():
        given = {k: v for k, v in options.items() if k in ("ocr", "tables")}
        o = Options.of(**{k: v for k, v in options.items() if k not in given})
        one = pages_of(spark, _made(spark), None, o, pdf=MadePdf(), **given).where(F.col("page_index").isin(*pages))
        one = one.select(F.lit(how).alias("how"), "page_index", "content", "ocr_used", F.array_join("warnings", ",").alias("warnings"))
        out = one if out is None else out.unionByName(one)
    return out


@_register("pdf_tags", _values("page_index INTEGER, title VARCHAR, opened VARCHAR, name VARCHAR, garbled BOOLEAN", [(i, "Made", "ok", "Ann", i == 3) for i in range(4)]))
def pdf_tags(spark, d):
    """Document tags, form fields, the page limit, and what opening took."""
    got = pages_of(spark, _made(spark), None, Options.of(max_pages=4), pdf=MadePdf())
    return got.select("page_index", F.col("metadata")["Title"].alias("title"), F.col("metadata")["pdf_open"].alias("opened"), F.col("form_fields")["name"].alias("name"), F.array_contains("warnings", "garbled_native_text").alias("garbled"))


_TWO = b"%PDF-1.4\n1 0 obj<</Type/Page/MediaBox[0 0 600 800]>>endobj\nstream\nBT /F1 10 Tf 50 700 Td (Left one) Tj 300 0 Td [(Right) -280 (one)] TJ 1 0 0 1 50 680 Tm (Left two) Tj 300 0 Td (Right two) Tj ET\nendstream\nendobj"


@_register("pdf_columns", _values("layout VARCHAR, content VARCHAR, width INTEGER", [("bulk", "Left one\nRight one\nLeft two\nRight two", 600), ("columns", "Left one\nLeft two\nRight one\nRight two\n", 600)]))
def pdf_columns(spark, d):
    """A PDF of two columns in the order of its stream, and by the boxes of its glyphs."""
    at, out = _folder(spark, {"two.pdf": _TWO}), None
    for layout_mode, how in (("bulk", "bulk"), ("multi_column", "columns")):
        raw = sources.pdf_pages(spark.read.format("binaryFile").load(at), multi_column=layout_mode == "multi_column").select(F.lit(how).alias("layout"), "content", "width")
        out = raw if out is None else out.unionByName(raw)
    return out


class _Mending:
    def open(self, data, password, max_pages):
        if data == b"whole" or password == "open":
            return PdfDocument([PdfPage("t")])
        raise PermissionError("encrypted") if data == b"locked" else ValueError("broken")


@_register("pdf_opening", _values("what VARCHAR, pages INTEGER, state VARCHAR, encrypted BOOLEAN", [("whole", 1, "ok", False), ("broken", 0, "failed", False), ("locked", 0, "failed", True), ("locked with password", 1, "ok", False)]))
def pdf_opening(spark, d):
    """How a PDF opens: plain, broken, locked, with its password."""
    rows = []
    for what, data, password in (("whole", b"whole", None), ("broken", b"junk", None), ("locked", b"locked", None), ("locked with password", b"locked", "open")):
        doc, how = open_pdf(data, _Mending(), password)
        rows.append((what, len(doc.pages) if doc else 0, how.get("pdf_open", "failed"), how.get("pdf_encrypted") == "true"))
    return spark.createDataFrame(rows, "what string, pages int, state string, encrypted boolean")


_GLYPH_PAGES = {
    1: (_line("left a", 0, 100) + _line("right a", 300, 100) + _line("left b", 0, 80) + _line("right b", 300, 80), "left a\nleft b\nright a\nright b\n", False),
    2: (_line("BIG HEADING", 0, 200, step=10.0) + _line("body text.", 0, 100), "\n# BIG HEADING\n\nbody text.\n", False),
    3: ([("x", float(i), i + 9.0, 10.0, 0.0) for i in range(30)], "x" * 30 + "\n", True),
}


@_register("glyph_pages", _values("page_id BIGINT, content VARCHAR, layout_complex BOOLEAN", [(k, t, c) for k, (_, t, c) in _GLYPH_PAGES.items()]))
def glyph_pages(spark, d):
    """Glyphs to lines, cells, columns and headings, and whether they overlap."""
    rows = [(k, i, c, *map(float, g)) for k, (gs, _, _) in _GLYPH_PAGES.items() for i, (c, *g) in enumerate(gs)]
    return layout.glyph_text(spark.createDataFrame(rows, "page_id long, idx int, c string, left float, right float, top float, bottom float"))


_BOXES = {
    "columns": ([(0, 700, 250, 750), (0, 600, 250, 650), (350, 700, 600, 750), (350, 600, 600, 650)], [0, 1, 2, 3]),
    "title": ([(50, 740, 550, 780), (50, 600, 250, 700), (350, 600, 550, 700)], [0, 1, 2]),
    "rows": ([(0, 10, 100, 20), (0, 40, 100, 50)], [1, 0]),
    "touching": ([(20, 0, 30, 10), (0, 0, 10, 10), (10, 0, 20, 10)], [2, 0, 1]),
    "one": ([(0, 0, 1, 1)], [0]),
}


@_register("reading_orders", _values("page VARCHAR, idx INTEGER, reading_index INTEGER", [(k, i, r) for k, (_, order) in _BOXES.items() for i, r in enumerate(order)]))
def reading_orders(spark, d):
    """Recursive cuts, the order by rows where nothing can be cut, and the sides that centres fall on."""
    rows = [(k, i, *map(float, b)) for k, (bs, _) in _BOXES.items() for i, b in enumerate(bs)]
    boxes = spark.createDataFrame(rows, "page string, idx int, x0 float, y0 float, x1 float, y1 float")
    return layout.reading_order(boxes, 600.0, 800.0, key="page").select("page", "idx", "reading_index")


@_register(
    "largest_gap",
    """WITH e AS (SELECT l_suppkey AS k, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::DOUBLE AS s, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::DOUBLE + 1 AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT k, s - before AS gap, before, s FROM m WHERE s > before)
SELECT k, first(before + gap / 2 ORDER BY gap DESC, s) AS cut FROM g GROUP BY k HAVING max(gap) >= 5""",
)
def largest_gap(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("s"), (day + 1).alias("e"))
    return layout.largest_gap(li, ["k"], "s", "e", 5.0)


# ---- signals, words, elements --------------------------------------------------------------------------------------


@_register("ocr_gate", "SELECT doc_id, true AS blank, length(text) % 3 = 0 OR length(text) % 5 = 0 AS wanted, CASE WHEN length(text) % 3 = 0 THEN text || chr(10) || chr(10) || '### OCR supplement:' || chr(10) || 'seen' ELSE 'seen' END AS merged FROM documents WHERE trim(text) <> ''")
def ocr_gate(spark, d):
    hybrid, broken = F.length("text") % 3 == 0, F.length("text") % 5 == 0
    docs = table(spark, d, "documents").where(F.trim("text") != "")
    return docs.select("doc_id", text.ocr_wanted(F.lit(" \n"), F.lit(True), F.lit(False), F.lit(False)).alias("blank"), text.ocr_wanted(F.col("text"), F.lit(True), hybrid, broken).alias("wanted"), text.merged_ocr(F.col("text"), F.lit("seen"), hybrid).alias("merged"))


_PIECES = ["[CLS]", "[SEP]", "[UNK]", "play", "##ing", "##s", "a", "ab", "##b"]
_WORDS = [("Playing a zebra", "0 3 4 6 2 1"), ("plays AB abb", "0 3 5 7 7 8 1"), ("", "0 1")]


@_register("word_pieces", _values("text VARCHAR, ids VARCHAR", _WORDS))
def word_pieces(spark, d):
    words = WordPiece({w: i for i, w in enumerate(_PIECES)})
    ids = F.pandas_udf(lambda s: s.map(lambda t: " ".join(map(str, words.encode(t)))), "string", functionType=F.PandasUDFType.SCALAR)
    return spark.createDataFrame([(t,) for t, _ in _WORDS], "text string").select("text", ids("text").alias("ids"))


@_register("sentence_cache", "SELECT conv_id, turn, text IN (SELECT text FROM conversations WHERE conv_id % 2 = 0) AS hit FROM conversations WHERE text IS NOT NULL")
def sentence_cache(spark, d):
    """Sentences whose vectors are stored, and those that are not."""
    s = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("sentence"))
    stored = s.where("conv_id % 2 = 0").select(F.xxhash64("sentence").alias("sentence_hash"), "sentence", F.array(F.lit(1.0)).alias("embedding")).distinct()
    hit, miss = cache.sentence_vectors(s, stored)
    return hit.select("conv_id", "turn", F.lit(True).alias("hit")).unionByName(miss.select("conv_id", "turn", F.lit(False).alias("hit")))


_ELEMENTS = [
    ("a/b.txt", 0, "# Top\n\n- item\n\nA long sentence that ends with a full stop.", [], [("Title", "# Top"), ("ListItem", "- item"), ("NarrativeText", "A long sentence that ends with a full stop.")]),
    ("a/b.txt", 1, "| x | y |\n\nShort", ["ocr_scales_tried:1.00"], [("FigureCaption", "| x | y |"), ("FigureCaption", "Short")]),
    ("c.pdf", 0, "What", ["garbled_native_text"], [("UncategorizedText", "What")]),
    ("c.doc", 2, "Old.", ["legacy_office_deferred"], [("UncategorizedText", "Old.")]),
    ("c.md", 3, "| x | y |\n\nLOUD", [], [("Table", "| x | y |"), ("Title", "LOUD")]),
]


@_register(
    "element_pages",
    _values("filename VARCHAR, file_directory VARCHAR, page_number INTEGER, element_index INTEGER, text VARCHAR, category VARCHAR", [(p.rpartition("/")[2], p.rpartition("/")[0] or ".", i + 1, k, t, c) for p, i, _, _, es in _ELEMENTS for k, (c, t) in enumerate(es)]),
)
def element_pages(spark, d):
    """Elements with their file and page; a page's warnings say more than its text."""
    rows = spark.createDataFrame([r[:4] for r in _ELEMENTS], "path string, page_index int, content string, warnings array<string>")
    return elements.elements(rows).select("filename", "file_directory", "page_number", "element_index", "text", "category")


@_register("partition", _values("filename VARCHAR, text VARCHAR, category VARCHAR", [("b.md", "# Head", "Title"), ("b.md", "Body", "Header"), ("w.doc", FILES["w.doc"][1][0][0], "UncategorizedText")]))
def partition(spark, d):
    """Files to typed elements in one call."""
    from folioflow.plans.partition import partition as run

    return run(spark, _docs(spark), pattern="^(b|w)[.]").select("filename", "text", "category")


_BITS = [("A\n\nB is here\n\nC", 12, ["A\n\nB is here", "C"]), ("one two three", 8, ["one two", "three"]), ("abcdefghij", 4, ["abcd", "efgh", "ij"]), ("ééé", 3, ["é", "é", "é"]), ("\n\n \n", 10, []), ("a. b. c", 5, ["a. b", ". c"])]


@_register("structural_examples", _values("text VARCHAR, size INTEGER, i INTEGER, chunk VARCHAR", [(t, n, i, c) for t, n, cs in _BITS for i, c in enumerate(cs)]))
def structural_examples(spark, d):
    """The recursive splitter on texts that can be followed by hand."""
    out = None
    for t, n, _ in _BITS:
        one = spark.createDataFrame([(t, n)], "text string, size int").select("text", "size", F.posexplode(chunking.structural(F.col("text"), n)).alias("i", "chunk"))
        out = one if out is None else out.unionByName(one)
    return out


_UNITS = [(1, "Intro one. Two\nmore.\n| a | b |\n| c | d |\nLast.", [("Intro one.", False), ("Two\nmore.", False), ("| a | b |\n| c | d |", True), ("Last.", False)]), (2, "| only |", [("| only |", True)]), (3, "Plain.", [("Plain.", False)])]


@_register("unit_examples", _values("id BIGINT, unit_index INTEGER, unit VARCHAR, is_table BOOLEAN", [(k, i, u, x) for k, _, us in _UNITS for i, (u, x) in enumerate(us)]))
def unit_examples(spark, d):
    """Table lines stay together, other lines give their sentences."""
    return chunking.units(spark.createDataFrame([r[:2] for r in _UNITS], "id long, content string"), "content", ["id"])


_VECTORS = [(1, 0, "a", (1.0, 0.0)), (1, 1, "b", (1.0, 0.1)), (1, 2, "c", (0.0, 1.0)), (2, 0, "x" * 30, (1.0, 0.0)), (2, 1, "y" * 30, (1.0, 0.0)), (3, 0, "only", (0.0, 0.0))]


@_register("semantic_examples", _values("doc_id BIGINT, i INTEGER, chunk VARCHAR", [(1, 0, "a b"), (1, 1, "c"), (2, 0, "x" * 30), (2, 1, "y" * 30), (3, 0, "only")]))
def semantic_examples(spark, d):
    """Sentences with given vectors: cut where neighbours differ or the chunk would be too long."""
    rows = spark.createDataFrame([(a, i, s, list(v)) for a, i, s, v in _VECTORS], "doc_id long, i int, sentence string, embedding array<float>")
    return vectors.semantic_chunks(rows, ["doc_id"], 40).select("doc_id", F.posexplode("chunks").alias("i", "chunk"))


# ---- options, pages, sinks, reports --------------------------------------------------------------------------------

_OPTIONS = [("fast", "bulk", False, False, True), ("Hi-Res", "multi_column", False, True, True), ("ocr", "auto", True, True, True), ("auto", "auto", False, True, True)]


@_register("strategies", _values("strategy VARCHAR, layout_mode VARCHAR, use_ocr BOOLEAN, use_vlm BOOLEAN, fast_chunk BOOLEAN", _OPTIONS))
def strategies(spark, d):
    """What a strategy makes of the other options."""
    made = [(s, Options.of(strategy=s, use_vlm=True)) for s, *_ in _OPTIONS]
    return spark.createDataFrame([(s, o.layout_mode, o.use_ocr, o.use_vlm, o.fast_chunk) for s, o in made], "strategy string, layout_mode string, use_ocr boolean, use_vlm boolean, fast_chunk boolean")


@_register("error_pages", "SELECT doc_id, 0 AS page_index, '' AS content, 'could not read ' || lang AS error, 0.0 AS confidence, 'pdf_open_failed' AS warnings, 0 AS num_chunks FROM documents")
def error_pages(spark, d):
    """A finished page for each file that failed."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang")
    done = page_ops.finish(page_ops.error_pages(files, F.concat(F.lit("could not read "), "lang")))
    return done.select(F.col("path").cast("long").alias("doc_id"), "page_index", "content", "error", F.col("extraction_confidence").cast("decimal(2,1)").alias("confidence"), F.array_join("warnings", ",").alias("warnings"), "num_chunks")


_LABELS = [("xlsx", "Costs", "sheet", "Costs"), ("pptx", "slide2", "slide", "slide2"), ("odp", "s", "slide", "s"), ("epub", "chapter1", "chapter", "chapter1"), ("txt", "x", None, None), ("ods", None, None, None)]


@_register("page_labels", _values("ext VARCHAR, label VARCHAR, key VARCHAR, value VARCHAR, source_type VARCHAR", [(*r, r[0]) for r in _LABELS]))
def page_labels(spark, d):
    rows = spark.createDataFrame([r[:2] for r in _LABELS], "ext string, label string").withColumn("m", page_ops.label_metadata(F.col("ext"), F.col("label")))
    own = F.get(F.filter(F.map_entries("m"), lambda e: e["key"] != "source_type"), F.lit(0))
    return rows.select("ext", "label", own["key"].alias("key"), own["value"].alias("value"), F.col("m")["source_type"].alias("source_type"))


@_register("markdown_pages", "SELECT '# Document: ' || conv_id || ' - Page ' || (turn + 1) || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS value FROM conversations")
def markdown_pages(spark, d):
    return export.markdown(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("page_index"), F.coalesce("text", F.lit("")).alias("content")))


@_register("json_pages", "SELECT conv_id::VARCHAR AS path, turn AS page_index, coalesce(text, '') AS content, strlen(coalesce(text, ''))::DOUBLE AS text_density FROM conversations")
def json_pages(spark, d):
    """Pages written as one JSON array and read back."""
    pages = page_ops.finish(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("page_index"), F.coalesce("text", F.lit("")).alias("content")))
    at = f"{_shared(spark)}/json"
    export.write_json(pages, at)
    return spark.read.schema("path string, page_index long, content string, text_density double").json(at)


@_register("document_metadata", _values("framework VARCHAR, id VARCHAR, text VARCHAR, source VARCHAR, chunk_index VARCHAR, kind VARCHAR", [(f, f"f.txt_p3_chunk_{i}", t, "f.txt", "9" if f == "fields last" else str(i), "own") for f in ("fields last", "index last") for i, t in enumerate(("one", "two"))]))
def document_metadata(spark, d):
    """Chunks as documents: which of equal keys wins differs between the two frameworks."""
    page = spark.createDataFrame([("f.txt", 3, ["one", "two"], {"kind": "own", "source": "old"}, {"chunk_index": "9"})], "path string, page_index int, chunks array<string>, metadata map<string,string>, form_fields map<string,string>")
    m, out = F.col("metadata"), None
    for name, last in (("fields last", True), ("index last", False)):
        one = export.chunk_documents(page, last).select(F.lit(name).alias("framework"), "id", "text", m["source"].alias("source"), m["chunk_index"].alias("chunk_index"), m["kind"].alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return page_ops.finish(table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("page_index"), F.col("text").alias("content")))


@_register("chars_by_file", "SELECT conv_id::VARCHAR AS path, count(*) AS pages, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM conversations GROUP BY conv_id")
def chars_by_file(spark, d):
    return report.chars_by_file(_turns(spark, d))


@_register("run_totals", "SELECT count(*) AS pages, count(*)::BIGINT AS chunks, coalesce(sum(turn) FILTER (turn > 0), 0)::BIGINT AS pii_hits FROM conversations")
def run_totals(spark, d):
    hits = F.create_map(F.lit("pii_redacted"), F.col("page_index").cast("string"))
    pages = _turns(spark, d).withColumns({"num_chunks": F.lit(1), "metadata": F.when(F.col("page_index") > 0, hits).otherwise(F.create_map().cast("map<string,string>"))})
    return report.totals(pages)


@_register("repair_counts", _values("files_ok BIGINT, files_failed BIGINT, pages_total BIGINT, pages_ocr BIGINT, repair_count BIGINT, extensions VARCHAR", [(2, 1, 4, 1, 1, "pdf:3,txt:1")]))
def repair_counts(spark, d):
    """A report over files of several pages, with repairs, recognition and a failure."""
    rows = [("a.pdf", 0, "text", None, True, {"xref_repaired": "true"}), ("a.pdf", 1, "text", None, False, {}), ("b.pdf", 0, "", "broken", False, {}), ("c.txt", 0, "text", None, False, {})]
    pages = page_ops.finish(spark.createDataFrame(rows, "path string, page_index int, content string, error string, ocr_used boolean, metadata map<string,string>"))
    e = F.array_join(F.transform(F.array_sort(F.map_entries("by_extension")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return report.ingest_report(pages).select("files_ok", "files_failed", "pages_total", "pages_ocr", "repair_count", e.alias("extensions"))
