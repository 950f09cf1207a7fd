import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import chunking as ck
from folioflow.functions import vectors
from folioflow.sources.backends import HashingEmbedder, embed, similarities

TEXT = st.text(alphabet="ab .\n#é漢😀|", max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_slices_tile_the_text(t, size):
    data = t.encode()
    spans = ck.slices(data, size)
    assert [a for a, _ in spans] == [0, *[b for _, b in spans]][: len(spans)] and (not spans or spans[-1][1] == len(data))
    for a, b in spans:
        piece = data[a:b].decode()
        assert b - a <= size or len(piece) == 1


def test_structural_examples():
    t = "# One\nalpha beta\n## Two\n- item one\n- item two\n## Three\ngamma delta epsilon"
    got = ck.structural_list(t, 50)
    assert all(len(c.encode()) <= 50 for c in got) and any(c.startswith("# One") for c in got) and any("## Two" in c for c in got)
    assert ck.structural_list("", 5) == [] and ck.structural_list(None, 5) == [] and "".join(ck.structural_list("x" * 23, 5)) == "x" * 23
    assert ck.structural_list("   \n\n  ", 2) == [] and ck.structural_list("a   b", 2, keep_empty=True).count("") >= 1


def pack(parts, size):
    out, now = [], ""
    for p in parts:
        if now and len(now.encode()) + len(p.encode()) + 2 > size:
            out.append(now)
            now = ""
        now = f"{now}\n\n{p}" if now else p
        if len(now.encode()) >= size:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def test_paragraph_packer(spark):
    r = random.Random(1)
    rows = [("\n\n".join("é" * r.randint(0, 30) for _ in range(r.randint(0, 20))),) for _ in range(200)] + [("a\r\n\r\nb",), (" \n\n ",), ("",)]
    df = spark.createDataFrame(rows, "content string")
    for r in ck.fast_chunks(df, "content", 40).collect():
        want = pack([p for p in (x.strip() for x in r["content"].split("\n\n")) if p], 40)
        assert r["chunks"] == want == ck.fast_list(r["content"], 40)


def test_tables_and_children(spark):
    df = spark.createDataFrame([("a b c d e f g h | i j k l",), ("one\n\ntwo three four",)], "content string")
    got = ck.child_chunks(ck.fast_chunks(df, "content", 12), 5).collect()
    assert got[0]["chunks"] == ck.structural_list("a b c d e f g h | i j k l", 12)
    assert [(c["text"], c["parent_index"]) for c in got[1]["child_chunks"]] == [("one", 0), ("two three four", 1)]


def test_sentences(spark):
    cases = {"a\nb": ["a\nb"], "a.\nb": ["a.", "b"], "...": ["..."], "Hi! You? Yes.": ["Hi!", "You?", "Yes."], "\n\na": ["a"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(ck.sentences(F.col("t"))).collect()] == list(cases.values())


def test_units(spark):
    df = spark.createDataFrame([(1, "\nFirst. Second.\n| a |\r\n| b |\nThird.\n\n**Tableau Extrait 1")], "k int, t string")
    got = [(r["unit"], r["is_table"]) for r in ck.units(df, "t", ["k"]).orderBy("unit_index").collect()]
    assert got == [("First.", False), ("Second.", False), ("| a |\n| b |", True), ("Third.", False), ("**Tableau Extrait 1", True)]


def test_document_chunks(spark):
    pages = [("d", 0, "a" * 10 + "\n\n" + "b" * 10), ("d", 1, ""), ("d", 2, "c" * 30), ("e", 0, "")]
    got = {(r["path"], r["page_index"]): r["chunks"] for r in ck.document_chunks(spark.createDataFrame(pages, "path string, page_index int, content string"), 12).collect()}
    assert got[("d", 0)] == ["a" * 10] and got[("d", 1)] == ["b" * 10] and got[("d", 2)] == ["c" * 30] and got[("e", 0)] == [""]


def test_vectors(spark):
    df = spark.createDataFrame([(1, 0, "a", [1.0, 0.0]), (1, 1, "b", [1.0, 0.1]), (1, 2, "c", [0.0, 1.0]), (1, 3, "d", [0.0, 0.0])], "k int, i int, sentence string, embedding array<float>")
    sims = [r["similarity"] for r in vectors.adjacent(df, "i", "embedding", ["k"]).orderBy("i").collect()]
    assert sims[0] is None and sims[1] > 0.99 and sims[2] < 0.2 and sims[3] == 0
    assert vectors.semantic_chunks(df, ["k"], 100).first()["chunks"] == ["a b", "c", "d"]
    assert df.limit(1).select(vectors.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0))))).first()[0] == [2.0, 4.0]


def test_few_rows_of_a_batch_are_objects_at_once():
    rows = 2 * ck.ROWS + 1
    kept = []
    got = ck._by_few(lambda t: kept.append(t) or [t], pa.list_(pa.string()))(iter([pa.array([str(i) for i in range(rows)]), pa.array([], pa.string())]))
    sizes = [(len(a), len(kept)) for a in got]
    assert sizes == [(ck.ROWS, ck.ROWS), (ck.ROWS, 2 * ck.ROWS), (1, rows), (0, rows)]


def test_batches_of_many_rows_keep_their_order(spark):
    df = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.col("id").cast("string"), F.lit(" b"))).alias("t"))
    got = ck.child_chunks(df.withColumn("chunks", ck.structural("t", 4)), 4, fast=False).orderBy("id").collect()
    for r in got:
        want = ck.structural_list(r["t"], 4)
        assert r["chunks"] == want and [tuple(c) for c in r["child_chunks"]] == [(w, i) for i, w in enumerate(want)]


def test_similarities_in_a_row_equal_those_of_rows(spark):
    texts = ["One two. One two three. Four.", "", None, "A b c. A b c.\nA b d. ... x", "Lone"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, t string").select("doc", ck.sentences(F.col("t")).alias("sentence"))
    rows = embed(docs.select("doc", F.posexplode("sentence").alias("i", "sentence")), "sentence", HashingEmbedder(8))
    want = {(r["doc"], r["i"]): r["similarity"] for r in vectors.adjacent(rows, "i", "embedding", ["doc"]).collect()}
    got = docs.withColumn("sim", similarities(F.col("sentence"), HashingEmbedder(8), rows=7))
    assert {(r["doc"], r["i"]): r["s"] for r in got.select("doc", F.posexplode("sim").alias("i", "s")).collect()} == want
    chunks = {r["doc"]: r["chunks"] for r in vectors.semantic_chunks(rows, ["doc"], 20).collect()}
    cut = got.select("doc", vectors.cut_chunks(F.arrays_zip("sentence", "sim"), 20).alias("chunks")).where(F.size("chunks") > 0)
    assert {r["doc"]: r["chunks"] for r in cut.collect()} == chunks


def test_semantic_chunks_take_no_shuffle(spark):
    from folioflow.plans import catalog

    plan = catalog.queries()["semantic_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hashed_vectors():
    import zlib

    texts = ["a b a", "", "é a", "x " * 50]
    want = []
    for t in texts:
        want.append([0.0] * 5)
        for h in (zlib.crc32(w.encode()) for w in t.split()):
            want[-1][h % 5] += 1.0 if h & 0x80000000 else -1.0
    got = HashingEmbedder(5).embed(texts)
    assert got.tolist() == want and str(got.dtype) == "float32" and HashingEmbedder(5).embed([]).shape == (0, 5)
