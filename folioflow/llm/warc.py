"""WARC archives: writing captures, reading records back and assembling transactions.

Each capture is three records: a response (or a revisit of an earlier response with the same payload), the request and
a metadata record, the latter two pointing to the first by WARC-Concurrent-To. Archives are written by the tasks that
hold the rows, one gzip member by record, into files that are named by partition and attempt; a task reports a file
only once it is closed, so the manifest of a retried task names one attempt's files alone. ``read_records`` streams
the files; ``assemble`` brings each capture's records together in one shuffle, keyed by the identifier they concur in,
with partial aggregation so that many copies of one capture are no hot task, and emits one nested row by capture.

Which row is the response: of rows with equal payloads (SHA-1 and length) of at least ``min_bytes`` bytes the one with the
smallest page id. Only digests are grouped for that, never payloads; the groups of two or more are broadcast if they
are few (counted first), else joined. Joins by payload or by response spread each key over ``SALTS`` places, so that a third of
all pages may share one payload.

Defined results. Null html: an empty payload. Null url: no target address. Addresses are written in UTF-8 as they are, but for
blanks and control characters, which are percent-encoded. Null page ids: null again, after all others.
Repeated rows: a capture each; those with the smallest id of their payload are responses all. Records that point to
no response make a capture without one. Empty tables: no files, no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, cut, drop_dir, own_dir, table

MIN_BYTES = 0
#: A file is closed and the next begun beyond so many compressed bytes.
ROLL = 256 << 20
BROADCAST_ROWS = 50_000
SALTS = 16
MOST_TASKS = 10_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLANK = re.compile(r"[\x00-\x20\x7f]")
_SPACE = uuid.UUID("7c6c3b6e-0b0a-5d0f-9a55-3f8a5f2f8a11")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def _record(kind: str, rid: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def capture_records(page_id: int | None, url: str | None, html: str | None, first: int | None) -> list[bytes]:
    """The records of one capture; ``first`` is the page whose response it revisits, or None for a response."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = digest_of(payload)
    uri = None if url is None else _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url)
    target, rid = ("WARC-Target-URI", uri), _id("capture", page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    typed = [target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        main = _record("response", rid, typed, http + payload)
    else:
        main = _record("revisit", rid, [*typed, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id("capture", first, digest))], http)
    host, _, path = (uri or "").partition("://")[2].partition("/")
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    asked = _record("request", _id("request", rid), [target, ("WARC-Concurrent-To", rid), ("Content-Type", "application/http; msgtype=request")], ask)
    said = "" if page_id is None else f"page_id: {page_id}\r\n"
    about = _record("metadata", _id("metadata", rid), [target, ("WARC-Concurrent-To", rid), ("Content-Type", "application/warc-fields")], said.encode())
    return [asked, main, about]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def write_archives(pages: DataFrame, out_dir: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to ``out_dir``; returns the manifest (path, records, bytes), already done."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html).alias("__sha"), F.octet_length(html).alias("__n"))
    same = pages.where(F.col("__n") >= min_bytes).groupBy("__sha", "__n").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__k"))
    same = cut(same.where("__k > 1").select(F.col("__sha").alias("__s"), F.col("__n").alias("__m"), "__first"))
    few = same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = (F.col("__sha") == F.col("__s")) & (F.col("__n") == F.col("__m"))
    if few:
        rows = pages.join(F.broadcast(same), on, "left")
    else:
        rows = pages.withColumn("__salt", _salt("page_id", "url")).join(_salted(same, "__t"), on & (F.col("__salt") == F.col("__t")), "left")
    # null ids come after all others, so they revisit wherever the group has an id
    rows = rows.withColumn("first", F.when(F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(out_dir)
        task, file, made, path, k, size = TaskContext.get(), None, [], "", 0, 0
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for b in batches:
            for page_id, url, text, first in zip(b["page_id"], b["url"], b["html"], b["first"]):
                if file is None:
                    fs.create_dir(base, recursive=True)
                    path, k, size = f"{name}-{len(made):04d}.warc.gz", 0, 0
                    file = fs.open_output_stream(f"{base}/{path}", compression=None)
                got = [x if isinstance(x, str) else None for x in (page_id, url, text, first)]
                for r in capture_records(None if got[0] is None else int(got[0]), got[1], got[2], None if got[3] is None else int(got[3])):
                    file.write(r)
                    k, size = k + 1, size + len(r)
                if size > ROLL:
                    file.close()
                    made.append((f"{out_dir}/{path}", k, size))
                    file = None
        if file is not None:
            file.close()
            made.append((f"{out_dir}/{path}", k, size))
        yield pd.DataFrame(made, columns=["path", "records", "bytes"]).astype({"path": "object", "records": "int64", "bytes": "int64"})

    # ids as strings: pandas would turn long columns with nulls into floats
    typed = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("first").cast("string").alias("first"))
    return cut(typed.mapInPandas(write, "path string, records long, bytes long"))


def parse_stream(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record is cut short")
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip(" \t\r\n")
        n = int(headers.get("content-length", 0))
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record is cut short")
        yield headers, block


_RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_length long, fields string, payload_bytes long, payload_sha1 string, payload binary"


def _row(h: dict[str, str], block: bytes) -> tuple:
    kind, payload, length, fields = h.get("warc-type"), None, None, None
    if kind in ("response", "revisit", "request"):
        head, _, body = block.partition(b"\r\n\r\n")
        fields = head.decode("utf-8", "replace")
        for line in fields.split("\r\n")[1:]:
            k, _, v = line.partition(":")
            if k.strip().lower() == "content-length" and v.strip().isdigit():
                length = int(v)
        payload = body if kind == "response" else None
    else:
        fields = block.decode("utf-8", "replace")
    digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
    # of a response the payload itself is measured, of a revisit its record says what the full payload has
    n, sha1 = (length, digest) if payload is None else (len(payload), digest_of(payload))
    ids = (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"))
    return *ids, digest, length, fields, n, sha1, payload


def read_records(paths: DataFrame, batch_bytes: int = 16 << 20) -> DataFrame:
    """One row by record of the archives in column ``path``; files are streamed, batches bounded by their bytes."""
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for b in batches:
            for path in b["path"]:
                fs, at = _filesystem(path)
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in parse_stream(stream):
                        rows.append(_row(h, block))
                        held += len(block) + 500
                        if held > batch_bytes:
                            yield _frame(rows, names)
                            rows, held = [], 0
        yield _frame(rows, names)

    # a task by file: a number that is asked for isn't merged at run time, however short the list of paths is
    return paths.select("path").repartition(max(1, min(paths.count(), MOST_TASKS))).mapInPandas(read, _RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"http_length": "Int64", "payload_bytes": "Int64"})


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row by capture: capture_id, page_id, response, request, metadata (structs, null where missing).

    Without the payload, its measured length and digest stand for it and no bytes of it are shuffled.
    """
    said = ["record_id", "type", "refers_to", "target_uri", "payload_digest", "http_length", "fields", "payload_bytes", "payload_sha1"]
    main = F.col("type").isin("response", "revisit")
    r = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    one = r.groupBy("capture_id").agg(
        F.min(F.when(main, F.struct(*said, *["payload"] * with_payload))).alias("response"),
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "fields"))).alias("request"),
        F.min(F.when(F.col("type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
        F.sum(main.cast("int")).alias("copies"),
    )
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1).cast("long"), "copies"))))
    page_id = F.regexp_extract(F.col("metadata.fields"), r"(?m)^page_id: (-?\d+)", 1)
    return one.select("capture_id", F.when(page_id != "", page_id.cast("long")).alias("page_id"), "response", "request", "metadata")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = own_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), at)
    captures = assemble(read_records(manifest), with_payload=False)
    r = F.col("response")
    slim = captures.where("response is not null").select(
        "page_id", "capture_id", r["type"].alias("record_type"), r["refers_to"].alias("to"), r["payload_bytes"].alias("payload_bytes"), r["payload_sha1"].alias("payload_digest")
    )
    # the archives have been read; the query needs them no more
    slim = cut(slim)
    drop_dir(spark, at)
    revisits = slim.where("record_type = 'revisit'")
    firsts = slim.where("record_type = 'response'").groupBy(F.col("capture_id").alias("to")).agg(F.min("page_id").alias("refers_to"))
    firsts = _salted(firsts.join(revisits.select("to").distinct(), "to", "left_semi"), "salt")
    revisits = revisits.withColumn("salt", _salt("capture_id")).join(firsts, ["to", "salt"], "left")
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return slim.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(revisits.select(*out))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('{_B32}',
  1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
