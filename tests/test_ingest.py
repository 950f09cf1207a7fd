import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import cli
from folioflow.functions import pii
from folioflow.operators import cache, export, report
from folioflow.operators.pages import PAGE_COLUMNS
from folioflow.plans import ingest as plan
from folioflow.plans.options import Options
from folioflow.sources.backends import HashingEmbedder
from tests.test_sources import zipped


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "sub").mkdir()
    for name, body in {
        "hello.txt": "One sentence.", "data.csv": "a,b\n1,2\n", "data.json": '{"title":"x","n":1}', "page.HTML": "<p>Hi bob@corp.com</p>", "sub/readme.rst": "Title\n=====", "feed.ndjson": '{"a":1}\n',
        "data.xml": "<r><i>ok</i></r>", "skip.exe": "no", "bad.json": "{", "corrupt.pdf": "junk", "x.msg": "fake msg", "old.doc": "x", "pic.png": "x", "empty.md": "",
    }.items():
        (d / name).write_text(body)
    (d / "latin.txt").write_bytes(b"\xff\xfe\xfa")
    (d / "all.zip").write_bytes(zipped(**{"d/a.txt": "first", "e/a.txt": "second"}))
    return str(d)


def by_name(pages):
    return {r["path"].rpartition("/")[2]: r for r in pages.collect()}


def test_every_file_is_a_page(spark, folder):
    pages = plan.ingest(spark, folder)
    assert tuple(pages.columns) == PAGE_COLUMNS
    got = by_name(pages)
    assert len(got) == 14 and "skip.exe" not in got and "all.zip" not in got
    texts = {"hello.txt": "One sentence.", "data.csv": "a,b\n1,2", "data.json": "n: 1\ntitle: x", "page.HTML": "Hi bob@corp.com", "readme.rst": "Title\n=====", "feed.ndjson": "a: 1", "data.xml": "ok", "empty.md": "", "latin.txt": ""}
    assert {k: got[k]["content"] for k in texts} == texts
    assert all(got[k]["error"] and got[k]["extraction_confidence"] == 0 for k in ("bad.json", "corrupt.pdf", "x.msg"))
    assert got["old.doc"]["warnings"] == ["legacy_office_deferred"] and got["pic.png"]["warnings"] == ["image_without_ocr"]
    one = got["hello.txt"]
    assert (one["chunks"], one["num_chunks"], one["language"], one["metadata"]) == (["One sentence."], 1, "en", {"source_type": "txt"})


def test_options_of_a_run(spark, folder):
    got = by_name(plan.ingest(spark, folder, pattern=r"^(page|hello)", pii_mode="redact", child_chunk_size=6))
    assert set(got) == {"page.HTML", "hello.txt"} and got["page.HTML"]["content"] == "Hi [EMAIL_REDACTED]"
    assert got["page.HTML"]["metadata"]["pii_types"] == "EMAIL" and "bob" not in str(got["page.HTML"]["child_chunks"])
    assert plan.ingest(spark, folder, pattern="nothing-like-it").count() == 0
    members = {r["path"].rpartition("!/")[2]: r["content"] for r in plan.ingest(spark, folder, pattern="zip$", ingest_archives=True).collect()}
    assert members == {"d/a.txt": "first", "e/a.txt": "second"}
    for how in ({"doc_chunking": True}, {"fast_chunk": False}, {"chunk_pages": False}):
        assert by_name(plan.ingest(spark, folder, pattern="hello", **how))["hello.txt"]["chunks"] == ["One sentence."]
    semantic = plan.ingest(spark, folder, pattern="hello", use_embeddings=True, embedder=HashingEmbedder(8))
    assert semantic.first()["chunks"] == ["One sentence."]


def test_option_errors():
    for bad in ({"strategy": "x"}, {"ocr_mode": "x"}, {"pattern": "("}, {"chunk_size": 0}, {"pii_mode": "x"}, {"nope": 1}):
        with pytest.raises(ValueError):
            Options.of(**bad)
    o = Options.of(strategy="Hi-Res", ocr_mode="HIGH", pii_mode="remove", pdf_password="")
    assert (o.layout_mode, o.ocr_mode, o.pii_mode, o.pdf_password, o.fast_chunk) == ("multi_column", "quality", "redact", None, True)
    assert Options.of(strategy="ocr").use_ocr and not Options.of(strategy="fast", use_ocr=True).use_ocr


def test_texts_report_and_exports(spark, folder, tmp_path, capsys):
    assert plan.ingest_text(spark, folder, pattern="^data").count() == 3
    pages = plan.ingest(spark, folder)
    r = plan.build_ingest_report(pages)
    # files with neither text nor confidence fail as well
    assert (r["pages_total"], r["files_ok"] + r["files_failed"], r["by_extension"]["json"]) == (14, 14, 2) and 0 <= r["avg_confidence"] <= 1
    empty = plan.build_ingest_report(pages.where("false"))
    assert empty["pages_total"] == 0 and empty["avg_confidence"] == 0 and empty["by_extension"] == {}
    assert export.write_json_array(pages, str(tmp_path / "o.json")) == 14 and len(json.load(open(tmp_path / "o.json"))) == 14
    docs = export.chunk_documents(pages).collect()
    assert len({d["id"] for d in docs}) == len(docs) and all("source" in d["metadata"] for d in docs)
    assert export.markdown(pages).first()["value"].startswith("# Document: ")
    assert {x["extension"]: x["broken_files"] for x in report.doctor(pages).collect()}["pdf"] == 1
    assert cli.main(["ingest", folder, "--pattern", "hello", "--output", str(tmp_path / "o.md")]) == 0 and "One sentence." in open(tmp_path / "o.md").read()
    assert cli.main(["version"]) == 0
    capsys.readouterr()


def test_sanitize(spark):
    assert plan.sanitize_pii(spark, "a@b.cd 10.0.0.1") == ("[EMAIL_REDACTED] [IP_REDACTED]", 2, ["EMAIL", "IP"])


def test_cache_hits_and_other_options_miss(spark, folder, tmp_path):
    at = str(tmp_path / "cache")
    first = by_name(plan.ingest(spark, folder, cache_dir=at, use_cache=True, pattern="^data"))
    n = spark.read.parquet(at).count()
    again = by_name(plan.ingest(spark, folder, cache_dir=at, use_cache=True, pattern="^data"))
    assert first == again and spark.read.parquet(at).count() == n == 3
    plan.ingest(spark, folder, cache_dir=at, use_cache=True, pattern="^data", chunk_size=5)
    assert spark.read.parquet(at).count() == 2 * n
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "t string")
    keyed = cache.with_key(df, "t", {"a": 1})
    old = keyed.where("t = 'x'").select("cache_key", F.lit("cached").alias("r")).distinct()
    got, fresh = cache.reuse(keyed, old, lambda m: m.select("cache_key", F.lit("new").alias("r")))
    assert sorted((r["t"], r["r"]) for r in got.collect()) == [("x", "cached"), ("x", "cached"), ("y", "new")] and fresh.count() == 1


def test_stream(spark, folder, tmp_path):
    from folioflow.streaming import ingest as streams

    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        q = streams.ingest_stream(spark, folder, out, check)
        assert q.awaitTermination(120) is not False
    # the stream's source has no rows for files without a byte
    assert spark.read.parquet(out).count() == 13
    assert streams.report_of(spark, out).first()["pages_total"] == 13


def test_sql_functions(spark):
    plan.register_functions(spark)
    r = spark.sql("""SELECT redact_pii('a@b.cd x') AS r, structural_chunks('a b') AS c, flatten_json('{"b":1,"a":2}') AS j""").first()
    assert (r["r"], r["c"], r["j"]) == ("[EMAIL_REDACTED] x", ["a b"], "a: 2\nb: 1")
    texts = ["", "123-45-6789", "4111 1111 1111 1111", "DE89370400440532013000", "2024-01-15 192.168.1.100", "sk_live_" + "a1" * 10, "eyJhbGciOiJI.eyJzdWIiOiIx.abc", "https://u:p@h.example/x?q=1", "call +33 6 12 34 56 78 or a@b.cd", "٠١٢-٣٤-٥٦٧٨"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for mode in ("redact", "mask", "tag"):
        rows = pii.sanitize(df, "t", mode).withColumn("one", pii.sanitized(F.col("t"), mode)).collect()
        assert [x["one"] for x in rows] == [x["pii"]["text"] for x in rows]
    df.createOrReplaceTempView("texts")
    both = spark.sql("SELECT t, redact_pii(t) AS r FROM texts").collect()
    assert {x["t"]: x["r"] for x in both} == {x["t"]: x["pii"]["text"] for x in pii.sanitize(df, "t", "redact").collect()}


def test_masking_lists_plans_small(spark):
    from folioflow.operators.pages import finish

    pages = spark.createDataFrame([("a", 0, "x a@b.cd", ["x a@b.cd", "123-45-6789"])], "path string, page_index int, content string, chunks array<string>")
    plan_text = finish(pages, "mask")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan_text) < 50_000


class Pages:
    """A PDF backend of made pages: their text, an image each, and glyphs that overlap on the second."""

    def open(self, data, password, max_pages):
        from folioflow.sources.backends import PdfDocument, PdfPage

        image = np.full((4, 6, 3), 90, np.uint8)
        near = [(c, float(i), i + 9.0, 110.0, 100.0) for i, c in enumerate("table here")]
        pages = [PdfPage("", 100, 100, image=image), PdfPage("few", 100, 100, near, image), PdfPage("plain text " * 40, 100, 100), PdfPage("\ufffd\ufffd\x01 " * 20, 100, 100)]
        return PdfDocument(pages[:max_pages])


class Reader:
    def read(self, image):
        return f"read at {image.shape[1]}"


class Tables:
    def detect(self, image):
        return np.array([[0, 0, 200, 200]]), np.array([0.9])


def test_recognition_and_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("x")
    run = lambda **how: {r["page_index"]: r for r in plan.ingest(spark, str(tmp_path), pdf=Pages(), **how).collect()}
    off = run()
    assert [off[i]["content"] for i in range(2)] == ["", "few"] and not any(r["ocr_used"] for r in off.values())
    assert off[3]["warnings"] == ["garbled_native_text"] and off[2]["warnings"] == []
    fast = run(use_ocr=True, ocr=Reader())
    assert fast[0]["content"] == "read at 6" and fast[0]["ocr_used"] and fast[1]["content"] == "few" and fast[2]["content"] == off[2]["content"]
    vision = run(use_ocr=True, ocr_mode="vision", ocr=Reader())
    assert vision[0]["warnings"] == ["page_recovered", "ocr_scales_tried:1.00,1.50"] and vision[0]["content"] == "read at 9"
    hybrid = run(use_ocr=True, ocr_mode="hybrid", ocr=Reader())
    assert hybrid[1]["content"] == "few\n\n### OCR supplement:\nread at 6" and "hybrid_ocr_merged" in hybrid[1]["warnings"]
    none = run(use_ocr=True, ocr_mode="quality")
    assert none[0]["warnings"] == ["ocr_requested_but_engine_unavailable"] and none[3]["warnings"] == ["ocr_skipped_no_image", "garbled_native_text"]
    tables = run(use_vlm=True, tables=Tables())
    assert tables[1]["content"] == "few\n\n### VLM Extracted:\n| table here |\n|---|\n\n" and tables[0]["content"] == ""


def test_partition(spark, folder):
    from folioflow.plans.partition import partition, partition_pdf

    got = {r["filename"]: r for r in partition(spark, folder, pattern="^(hello|page)").collect()}
    assert got["hello.txt"]["category"] == "NarrativeText" and got["page.HTML"]["category"] == "Header" and got["hello.txt"]["page_number"] == 1
    assert [r["text"] for r in partition_pdf(spark, f"{folder}/hello.txt").collect()] == ["One sentence."]
