import json
import threading
import urllib.error
import urllib.request

import pytest

from folioflow import service


@pytest.fixture(scope="module")
def at(spark):
    s = service.server(spark, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def post(at, name, content, **fields):
    parts = [f'--B\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    parts.append(f'--B\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + content + b"\r\n--B--\r\n")
    asked = urllib.request.Request(f"{at}/ingest", b"".join(parts), {"Content-Type": "multipart/form-data; boundary=B"})
    return json.load(urllib.request.urlopen(asked))


def test_uploads(at):
    assert json.load(urllib.request.urlopen(f"{at}/health"))["status"] == "healthy"
    assert "docx" in json.load(urllib.request.urlopen(f"{at}/"))["supported_extensions"]
    got = post(at, "a.md", "One.\n\nTwo é.".encode(), chunk_size=5, child_chunk_size="")
    assert (got["total_pages"], got["pages"][0]["path"], got["pages"][0]["chunks"]) == (1, "a.md", ["One.", "Two é."])
    assert got["ingest_report"]["files_ok"] == 1 and got["pages"][0]["error"] is None
    assert post(at, "a.json", b"{")["pages"][0]["error"].startswith("JSON")


def test_bad_requests(at):
    for name, fields in (("a.exe", {}), ("a.txt", {"nope": 1}), ("a.txt", {"chunk_size": 0}), ("a.txt", {"chunk_size": "x"})):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(at, name, b"x", **fields)
        assert e.value.code == 400 and json.load(e.value)["detail"]
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/nowhere")
