"""A small HTTP service over one Spark session: one uploaded document to its pages and report, as JSON.

    python -m folioflow.cli serve --port 8000
    curl -F file=@report.docx -F chunk_size=500 localhost:8000/ingest

Uploads become one row of a DataFrame, so nothing is written to disk.
"""

from __future__ import annotations

import email
import email.policy
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import folioflow
from folioflow.operators import export, report
from folioflow.plans.ingest import pages_of
from folioflow.plans.options import Options
from folioflow.sources.formats import SUPPORTED

MOST_UPLOAD = 256 << 20
_ACCEPTED = SUPPORTED - {"zip"}
_FILE = "path string, length long, modificationTime timestamp, content binary, ext string"


def form(kind: str, body: bytes) -> tuple[str, bytes, dict[str, str]]:
    """(file name, content, other fields) of a multipart form."""
    message = email.message_from_bytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body, policy=email.policy.HTTP)
    name, content, fields = "", b"", {}
    for part in message.iter_parts() if message.is_multipart() else ():
        own = part.get_param("name", header="content-disposition")
        data = part.get_payload(decode=True) or b""
        if part.get_filename():
            name, content = part.get_filename(), data
        elif own:
            fields[own] = data.decode()
    return name, content, fields


def options_of(fields: dict[str, str]) -> Options:
    """Form fields by the types of the options; unknown names and bad values raise ValueError."""
    given = {}
    for k, v in fields.items():
        kind = str(Options.__dataclass_fields__[k].type) if k in Options.__dataclass_fields__ else "str"
        if v == "" and "None" in kind:
            continue
        given[k] = v.lower() in ("1", "true", "yes", "on") if "bool" in kind else int(v) if "int" in kind else float(v) if "float" in kind else v
    given.pop("use_cache", None)
    return Options.of(**{"strategy": "fast", "repair_pdf": True} | given)


def ingest_upload(spark: SparkSession, name: str, content: bytes, fields: dict[str, str]) -> dict:
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext not in _ACCEPTED:
        raise ValueError(f"unsupported extension '{ext}': {', '.join(sorted(_ACCEPTED))}")
    files = spark.createDataFrame([(name, len(content), None, bytearray(content), ext)], _FILE)
    pages: DataFrame = pages_of(spark, files, None, options_of(fields))
    rows = [json.loads(r["j"]) for r in export.ordered(pages).select(F.to_json(F.struct(*export.JSON_COLUMNS), {"ignoreNullFields": "false"}).alias("j")).collect()]
    said = report.ingest_report(pages).first().asDict(recursive=True)
    return {"success": True, "filename": name, "total_pages": len(rows), "pages": rows, "ingest_report": said}


def server(spark: SparkSession, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/":
                self.answer(200, {"version": folioflow.__version__, "supported_extensions": sorted(_ACCEPTED)})
            elif self.path == "/health":
                self.answer(200, {"status": "healthy", "version": folioflow.__version__, "spark": spark.version})
            else:
                self.answer(404, {"detail": "not found"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/ingest":
                return self.answer(404, {"detail": "not found"})
            if size > MOST_UPLOAD:
                return self.answer(413, {"detail": "the upload is too large"})
            try:
                self.answer(200, ingest_upload(spark, *form(self.headers.get("Content-Type", ""), self.rfile.read(size))))
            except ValueError as e:
                self.answer(400, {"detail": str(e)})
            except Exception as e:
                self.answer(500, {"detail": f"{type(e).__name__}: {e}"[:500]})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
