import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import elements, pii, text
from folioflow.sources import parsers


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><body><p>Hi</p></body></html>", "Hi"),
        ("a<br/>b<BR>c", "a\nb\nc"),
        ("<script>var t='</p>';</script>x<STYLE a=b>y</style>", "x"),
        ("&amp;lt;&nbsp;&quot;q&quot;&#39;", "&lt; \"q\"'".replace("&lt;", "<")),
        ("<p>a</p>\n\n\n\n<p>b</p>", "a\n\n b"),
        ("", ""),
    ],
)
def test_html(spark, html, want):
    assert one(spark, html, text.html_text) == want == parsers.html_text(html)


def test_csv_xml(spark):
    assert one(spark, "a,b \n1,2\t\n", text.csv_text) == "a,b\n1,2"
    assert one(spark, "a,b\r\n1,2\r\n", text.csv_text) == "a,b\n1,2"
    assert one(spark, "<root>\n <item a='1'>ok</item>  <x/>two</root>", text.xml_text) == "ok two"


def test_bytes_that_are_not_text(spark):
    assert one(spark, b"ab\xc3\xa9", text.utf8_text, "binary") == "abé" and one(spark, b"\xff\xfe", text.utf8_text, "binary") == ""


def test_language_ties_and_limits(spark):
    hint = lambda t: one(spark, t, text.language_hint)
    assert [hint("hello"), hint("привет"), hint("你好吗"), hint("سلام"), hint("123 !"), hint(" \n　")] == ["en", "ru", "zh", "ar", "unknown", None]
    assert hint("aб") == "ru" and hint("a你") == "zh" and hint("你س") == "ar"
    assert hint("1" * 2000 + "abc") == "unknown"


def test_signals(spark):
    conf = lambda n, ocr, err, d: round(spark.range(1).select(text.confidence(F.lit(n), F.lit(d).cast("float"), F.lit(ocr), F.lit(err))).first()[0], 4)
    assert conf(100, False, False, 1.0) == 0.9 and conf(100, False, True, 1.0) == 0 and conf(0, False, False, 0.0) == 0.1 and conf(19, False, False, 19.0) == 0.55
    assert conf(100, True, False, 0.1) == 0.6375 and conf(10, True, False, 0.01) == 0.315
    dens = lambda n, w, h: spark.range(1).select(text.text_density(F.lit(n), w, h)).first()[0]
    assert dens(800, 800, 800) == 100.0 and dens(7, 0, 0) == 7.0
    assert one(spark, "�" * 30, text.garbled) and not one(spark, "a normal sentence of text.", text.garbled) and not one(spark, "�" * 5, text.garbled)
    gate = lambda f, *a: spark.range(1).select(f(*map(F.lit, a))).first()[0]
    assert gate(text.hybrid_ocr, 10, 0.02, True, True) and not gate(text.hybrid_ocr, 5000, 2.0, False, False)
    assert gate(text.broken_page, 2, 5.0, False, False) and not gate(text.broken_page, 2, 5.0, False, True)
    assert gate(text.looks_scanned, 10.0) and not gate(text.looks_scanned, 500.0)


PII = [
    ("mail alice@corp.com please", "mail [EMAIL_REDACTED] please", 1),
    ("id 123-45-6789", "id [PHONE_REDACTED]", 1),
    ("card 4111 1111 1111 1111", "card [PHONE_REDACTED] 1111", 1),
    ("host 192.168.1.100 up", "host [IP_REDACTED] up", 1),
    ("key sk_live_abcdefghijklmnop", "key [API_KEY_REDACTED]", 1),
    ("t eyJabcdefghijk.abc.def x", "t [JWT_REDACTED] x", 1),
    ("", "", 0),
    ("nothing here", "nothing here", 0),
]


def test_pii_order(spark):
    df = pii.sanitize(spark.createDataFrame([(a,) for a, _, _ in PII], "t string"), "t", "redact")
    assert [(r["t"], r["pii"]["text"], r["pii"]["n"]) for r in df.collect()] == PII


def test_pii_modes(spark):
    go = lambda t, m: pii.sanitize(spark.createDataFrame([(t,)], "t string"), "t", m).first()["pii"]
    assert go("a bob@x.org b", "mask")["text"] == "a b***@x.org b" and go("a bob@x.org b", "label")["text"] == 'a <PII type="EMAIL">bob@x.org</PII> b'
    assert go("Call +33 6 12 34 56 78", "partial")["text"] == "Call ***-***-5678" and go("ip 10.0.0.1", "mask")["text"] == "ip 10****"
    assert go("a bob@x.org", "off")["n"] == 0 and list(go("bob@x.org 10.0.0.1", "redact")["types"]) == ["EMAIL", "IP"]
    with pytest.raises(ValueError):
        pii.mode_of("shred")


def test_no_mail_survives(spark):
    r = random.Random(3)
    rows = [("".join(r.choice("ab.@c- 1é") for _ in range(40)),) for _ in range(300)]
    df = pii.sanitize(spark.createDataFrame(rows, "t string"), "t", "redact")
    assert df.where(F.col("pii.text").rlike(pii.pattern("EMAIL"))).count() == 0


def test_elements(spark):
    body = "# Head\n\n| a | b |\n\n- item\n\n1. item\n\nSHOUT\n\nshort line\n\nA sentence that ends.\n \n "
    df = spark.createDataFrame([("d/f.txt", 0, body, []), ("g.txt", 1, "text.", ["ocr_skipped_no_image"]), ("h.txt", 0, "x.", ["garbled_native_text"])], "path string, page_index int, content string, warnings array<string>")
    got = elements.elements(df).orderBy("path", "element_index").collect()
    assert [r["category"] for r in got] == ["Title", "Table", "ListItem", "ListItem", "Title", "Header", "NarrativeText", "FigureCaption", "UncategorizedText"]
    assert (got[0]["filename"], got[0]["file_directory"], got[0]["page_number"], got[7]["file_directory"]) == ("f.txt", "d", 1, ".")
