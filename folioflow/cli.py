"""python -m folioflow.cli ingest|sanitize|doctor|compare|bench|serve|version"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import folioflow
from folioflow.operators import export, report
from folioflow.plans.ingest import build_ingest_report, ingest, ingest_text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "sanitize", "doctor", "compare", "bench"):
        c = sub.add_parser(name)
        c.add_argument("directory")
        c.add_argument("--pattern")
        c.add_argument("--archives", action="store_true")
        if name in ("ingest", "sanitize"):
            c.add_argument("--output", help="a .json or .md file, or else a folder of JSON lines")
            c.add_argument("--pii-mode", default="redact" if name == "sanitize" else "off")
            c.add_argument("--chunk-size", type=int, default=1000)
            c.add_argument("--child-chunk-size", type=int)
            c.add_argument("--max-pages", type=int)
            c.add_argument("--repair-pdf", action="store_true")
            c.add_argument("--repair-level", default="normal")
            c.add_argument("--strategy")
            c.add_argument("--layout-mode", default="auto")
            c.add_argument("--backend", default="auto")
            c.add_argument("--use-ocr", action="store_true")
            c.add_argument("--ocr-mode", default="fast")
            c.add_argument("--use-embeddings", action="store_true")
            c.add_argument("--doc-chunking", action="store_true")
            c.add_argument("--pdf-password")
            c.add_argument("--cache-dir", help="where results are kept and looked up")
    served = sub.add_parser("serve")
    served.add_argument("--host", default="127.0.0.1")
    served.add_argument("--port", type=int, default=8000)
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(folioflow.__version__)
        return 0
    spark = SparkSession.builder.appName("folioflow").getOrCreate()
    if a.command == "serve":
        from folioflow.service import server

        server(spark, a.port, a.host).serve_forever()
        return 0
    common = {"pattern": a.pattern, "ingest_archives": a.archives}
    if a.command in ("ingest", "sanitize"):
        names = ("pii_mode", "chunk_size", "child_chunk_size", "max_pages", "repair_pdf", "repair_level", "strategy", "layout_mode", "backend", "use_ocr", "ocr_mode", "use_embeddings", "doc_chunking", "pdf_password")
        pages = ingest(spark, a.directory, cache_dir=a.cache_dir, use_cache=a.cache_dir is not None, **{k: getattr(a, k) for k in names}, **common)
        if a.output and a.output.endswith(".json"):
            export.write_json_array(pages, a.output)
        elif a.output and a.output.endswith(".md"):
            with open(a.output, "w", encoding="utf-8") as f:
                f.writelines(r["value"] + "\n" for r in export.markdown(pages).toLocalIterator())
        elif a.output:
            export.write_json(pages, a.output)
        said = build_ingest_report(pages) | report.totals(pages).first().asDict()
        print(json.dumps(said, indent=2))
    elif a.command == "doctor":
        for r in report.doctor(ingest(spark, a.directory, chunk_pages=False, **common)).orderBy("extension").toLocalIterator():
            print(json.dumps(r.asDict()))
    elif a.command == "compare":
        for r in report.chars_by_file(ingest(spark, a.directory, chunk_pages=False, **common)).orderBy("path").toLocalIterator():
            print(json.dumps(r.asDict()))
    else:
        began = time.time()
        n = ingest_text(spark, a.directory, **common).agg(F.count(F.lit(1)), F.sum(F.length("content"))).first()
        took = time.time() - began
        print(json.dumps({"pages": n[0], "chars": n[1] or 0, "seconds": round(took, 3), "pages_by_second": round(n[0] / max(took, 1e-9), 1)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
