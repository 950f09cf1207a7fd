import io
import json
import zipfile

import pytest

from folioflow.sources import backends, parsers
from folioflow.sources.formats import SUPPORTED, is_image, is_plain_text, is_supported

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return b.getvalue()


def test_formats():
    assert len(SUPPORTED) == 48 and is_supported("PDF") and is_plain_text("Rs") and is_image("TIFF") and not is_supported("exe")


def text(ext, data):
    pages, error = parsers.parse(ext, data)
    assert error is None, error
    return pages[0][1]


def test_json():
    assert text("json", b'{"title":"x","n":1}') == "n: 1\ntitle: x"
    assert text("json", b'{"a":1,"b":{"c":"x","d":[1,null,"y",[]]},"e":null,"f":{}}') == "a: 1\nb:\nc: x\nd:\n1\ny"
    assert text("json", b"3") == "3" and text("json", b'{"t":true,"x":1.5}') == "t: true\nx: 1.5"
    deep = current = {}
    for _ in range(13):
        current["k"] = {}
        current = current["k"]
    current["z"] = 1
    assert "{" in text("json", json.dumps(deep).encode())
    assert parsers.parse("json", b"{")[1].startswith("JSON")


def test_ndjson():
    assert text("ndjson", b'{"a":1}\n{"b":2}\n') == "a: 1\nb: 2"
    assert text("ndjson", b'{"b":null,"a":{"x":[1]}}\n\nraw line\n7') == 'a: {"x":[1]} | b: null\nraw line\n7'


def test_rtf():
    assert text("rtf", rb"{\rtf1\ansi Hello \par World\tab x}") == "Hello\nWorld\tx"


def test_mail():
    plain = b"From: a@b.c\r\nSubject: Hi\r\nX-Other: no\r\n\r\nBody line\r\n"
    assert text("eml", plain) == "From: a@b.c\nSubject: Hi\n\nBody line"
    multi = b'From: a@b.c\nContent-Type: multipart/alternative; boundary="XyZ"\n\n--XyZ\nContent-Type: text/html\n\n<p>html</p>\n--XyZ\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n--XyZ--\n'
    assert text("eml", multi) == "From: a@b.c\n\nhello"
    box = b"From x Mon\nSubject: one\n\nfirst\n\nFrom y Tue\nSubject: two\n\nsecond\n"
    assert text("mbox", box) == "Subject: one\n\nfirst\n\n---\n\nSubject: two\n\nsecond"
    assert parsers.parse("msg", b"fake msg") == ([], "MSG: ValueError: not a compound file")


def test_docx():
    run = f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space='preserve'> World</w:t><w:tab/><w:t>with tab and </w:t><w:br/><w:t>break.</w:t></w:r></w:p><w:p><w:r><w:t>Second paragraph.</w:t></w:r></w:p></w:body></w:document>"
    head = f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>"
    assert parsers.ooxml_text(run.encode()) == "Hello World\twith tab and \nbreak.\nSecond paragraph."
    assert text("docx", zipped(**{"word/document.xml": run, "word/header1.xml": head})).endswith("paragraph.\n\nTop")
    assert parsers.parse("docx", b"junk")[1].startswith("DOCX") and "missing" in parsers.parse("docx", zipped(a="b"))[1]


def test_pptx_order():
    slide = lambda s: f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>{s}</a:t></a:r></a:p></p:sld>"
    pages, _ = parsers.parse("pptx", zipped(**{"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")}))
    assert pages == [("slide2", "two"), ("slide10", "ten")]


def test_xlsx():
    book = "<workbook xmlns:r='r'><sheets><sheet name='S1' sheetId='1' r:id='rId1'/></sheets></workbook>"
    rels = "<Relationships><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>"
    sheet = "<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='C1'><v>3.14</v></c></row><row r='2'/><row r='3'><c r='A3'><v>42.0</v></c><c r='B3' t='b'><v>1</v></c><c r='C3' t='inlineStr'><is><t>in</t></is></c></row></sheetData></worksheet>"
    pages, error = parsers.parse("xlsx", zipped(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>Hello</t></si></sst>"}))
    assert error is None and pages == [("S1", "| Hello |  | 3.14 |\n|---|---|---|\n| 42 | true | in |")]
    assert [parsers.cell_text(v, None, []) for v in ("-123", "3.14", "42.0")] == ["-123", "3.14", "42"]


def test_odf_and_epub():
    odf = "<o:c xmlns:o='o' xmlns:text='t'><text:h>Head</text:h><text:p>One<text:tab/>two<text:s text:c='2'/><text:span>three</text:span> four</text:p></o:c>"
    assert text("odt", zipped(**{"content.xml": odf})) == "Head\nOne\ttwo  three four"
    pages, _ = parsers.parse("epub", zipped(**{"b.xhtml": "<p>B</p>", "a.html": "<p>A</p>", "x.css": ""}))
    assert pages == [("chapter1", "A"), ("chapter2", "B")] and parsers.parse("epub", zipped(a="b"))[1]


def test_zip_members():
    data = zipped(**{"d/a.txt": "1", "e/a.txt": "2", "../up.txt": "x", "n.zip": "x", "n.exe": "x"})
    assert [(n, b) for n, b, _ in parsers.expand_zip(data)] == [("d/a.txt", b"1"), ("e/a.txt", b"2")]


def test_pdf_and_images():
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (Hello \\(PDF\\)) Tj T* [(Wo) 3 (rld)] TJ ET\nendstream\nendobj"
    doc, how = backends.open_pdf(body, backends.FlatePdf())
    assert doc.pages[0].text == "Hello (PDF)\nWorld" and how == {"pdf_open": "ok"}
    doc, how = backends.open_pdf(b"nope", backends.FlatePdf(), repair=True)
    assert doc is None and how["pdf_open_failed"] == "true"
    assert backends.open_pdf(b"%PDF- /Encrypt", backends.FlatePdf())[1]["pdf_encrypted"] == "true"
    assert backends.vision_scales(1.0) == [1.0, 1.5] and backends.vision_scales(1.5) == [1.0, 1.5] and backends.vision_scales(9) == [2.0, 3.0] and backends.scaled_width(100, 9) == 300
    assert backends.best_candidate([(1, "abc"), (2, "a!!"), (3, "xyz")]) == "xyz" and backends.best_candidate([]) == ""
    import numpy as np

    img = np.array([[[10, 10, 10], [20, 20, 20]]], np.uint8)
    assert backends.stretch(img).tolist() == [[[0] * 3, [255] * 3]] and (backends.stretch(img, "fast") == img).all()


def test_wordpiece():
    v = {w: i for i, w in enumerate(["[CLS]", "[SEP]", "[UNK]", "play", "##ing", "a"])}
    assert backends.WordPiece(v).encode("Playing a zebra") == [0, 3, 4, 5, 2, 1]


@pytest.mark.parametrize("ext", sorted(parsers.PARSERS))
def test_damaged_files_are_errors(ext):
    for data in (b"", b"\xff\xfe\x00junk", b"PK\x03\x04broken"):
        pages, error = parsers.parse(ext, data)
        assert pages or error
