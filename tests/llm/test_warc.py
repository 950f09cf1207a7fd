import gzip
import io

import pytest

from folioflow.llm import warc

T = "page_id long, url string, html string, type string"


def captured(spark, rows, tmp_path, **how):
    manifest = warc.write_archives(spark.createDataFrame(rows, T), f"file://{tmp_path}/w", **how)
    return manifest, warc.assemble(warc.read_records(manifest))


def test_round_trip_with_odd_rows(spark, tmp_path):
    rows = [(1, "http://a.b/c d\r\ne?x#y", "é\r\n\r\nWARC/1.1 ok", "t"), (2, None, None, None), (3, "http://a.b", "", None), (4, "x", "é\r\n\r\nWARC/1.1 ok", None), (4, "x", "é\r\n\r\nWARC/1.1 ok", None), (None, "y", "", None), (9, "z", "w" * 300_000, None)]
    manifest, got = captured(spark, rows, tmp_path)
    got = got.collect()
    assert sum(r["records"] for r in manifest.collect()) == 3 * len(rows) and len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["response"]["type"]) for r in got)
    assert kinds == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "revisit"), ("4", "revisit"), ("9", "response"), ("None", "revisit")]
    one = next(r for r in got if r["page_id"] == 1)
    assert bytes(one["response"]["payload"]).decode() == rows[0][2]
    assert all(r["request"]["fields"].startswith("GET /") and r["metadata"] for r in got)
    assert {r["response"]["refers_to"] for r in got if r["page_id"] == 4} == {one["capture_id"]}


def test_small_payloads_are_responses(spark, tmp_path):
    _, got = captured(spark, [(1, "a", "xy", ""), (2, "b", "xy", ""), (3, "c", "xyz", ""), (4, "d", "xyz", "")], tmp_path, min_bytes=3)
    assert {r["page_id"]: r["response"]["type"] for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table_and_orphans(spark, tmp_path):
    manifest, got = captured(spark, [], tmp_path)
    assert manifest.count() == 0 and got.count() == 0
    orphan = spark.createDataFrame([("<r>", "request", "<gone>", None, None, None, None, "GET /", None, None, None)], warc._RECORD)
    assert [(r["capture_id"], r["response"]) for r in warc.assemble(orphan).collect()] == [("<gone>", None)]


def test_files_roll_and_parser_refuses_damage(spark, tmp_path, monkeypatch):
    records = warc.capture_records(1, "http://h/p", "abc", None)
    whole = b"".join(gzip.decompress(r) for r in records)
    assert [h["warc-type"] for h, _ in warc.parse_stream(io.BytesIO(whole))] == ["request", "response", "metadata"]
    with pytest.raises(ValueError):
        list(warc.parse_stream(io.BytesIO(whole[:-30])))


def test_query_equals_brute_force(spark):
    import hashlib

    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in warc.query(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        b = r["html"].encode()
        assert got[r["page_id"]]["payload_bytes"] == len(b) and got[r["page_id"]]["payload_digest"] == warc.digest_of(b)


def test_addresses_come_back(spark, tmp_path):
    urls = ["http://bücher.example/straße?q=Ж%20中#😀", "https://h/a%2Fb", "http://h/\u3000"]
    _, got = captured(spark, [(i, u, "x", "") for i, u in enumerate(urls)], tmp_path)
    assert {r["page_id"]: r["response"]["target_uri"] for r in got.collect()} == dict(enumerate(urls))


def test_one_payload_on_most_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, f"u{i}", "" if i % 3 else f"p{i % 7}", "") for i in range(200)]
    _, got = captured(spark, rows, tmp_path)
    kinds = [(r["page_id"], r["response"]["type"]) for r in got.collect()]
    firsts = {}
    for i, _, h, _ in rows:
        firsts.setdefault(h, i)
    assert sorted(kinds) == [(i, "response" if firsts[h] == i else "revisit") for i, _, h, _ in rows]
