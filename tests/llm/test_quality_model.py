import math
import random

import numpy as np

from folioflow.llm import quality_model as q

GOOD = "the of and to report river small table window answer garden light seven open".split()


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ws = [r.choice(GOOD) for _ in range(r.randint(20, 300))]
        y = i % 4 != 0
        rows.append((" ".join(ws) if y else " ".join(w.upper() + "!!" for w in ws), int(y)))
    return rows


def test_every_byte_is_covered():
    for n in (0, 1, 511, 512, 513, 1016, 5000):
        starts = q.chunk_starts(max(n, q.CHUNK))
        seen = np.zeros(max(n, q.CHUNK), bool)
        for s in starts:
            seen[s : s + q.CHUNK] = True
        assert seen.all() and q.chunks_of(b"x" * n).shape == (len(starts), q.CHUNK)


def test_gradient_descends_and_generalises():
    rows, held = corpus(200, 1), corpus(100, 2)
    p = q.train([t for t, _ in rows], np.array([y for _, y in rows]), steps=60)
    s = q.score(p, [t for t, _ in held])
    assert np.mean((s >= q.THRESHOLD) == np.array([y for _, y in held])) > 0.95
    again = q.train([t for t, _ in rows], np.array([y for _, y in rows]), steps=60)
    assert np.array_equal(q.score(again, ["a", None, ""]), q.score(p, ["a", None, ""]))
    assert len(set(q.score(p, [None, ""]))) == 1 and 0 <= q.score(p, ["x" * 3_000_000])[0] <= 1


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["quality"]["score"] for r in q.classify(docs, q.fit(docs, none)).collect()} == {0.5}
    assert q.classify(docs.where("false"), q.fit(docs, none)).count() == 0
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = q.classify(docs.withColumn("score", docs.doc_id), q.fit(docs, one))
    assert got.columns == ["doc_id", "text", "score", "quality"] and got.count() == 2


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in got])
    clean = np.mean([r["predicted"] for r in got if r["quality"] == 1])
    assert right > 0.85 and clean > 0.9, (right, clean)


def test_forward_pass_equals_loops(monkeypatch):
    """Each score again by plain loops over bytes, filters and layers."""
    texts = ["", "short", "é" * 300, "x y " * 700, None]
    p = q.train(["good text here " * 40, "zzzz 1111 " * 60] * 20, np.array([1, 0] * 20, np.float32), steps=3)
    for t, got in zip(texts, q.score(p, texts)):
        data = (t or "").encode()
        data += b"\0" * (q.CHUNK - len(data))
        starts = list(range(0, len(data) - q.CHUNK + 1, q.CHUNK - q.WIDTH))
        if starts[-1] != len(data) - q.CHUNK:
            starts.append(len(data) - q.CHUNK)
        assert set(range(len(data))) == {s + k for s in starts for k in range(q.CHUNK)}
        rows = []
        for s in starts:
            row = []
            for f in range(q.FILTERS):
                taps = p["filters"][:, f].reshape(q.WIDTH, q.EMBED)
                best = max(sum(float(p["embed"][data[s + at + k]] @ taps[k]) for k in range(q.WIDTH)) for at in range(0, q.CHUNK - q.WIDTH + 1, q.STEP))
                row.append(max(0.0, best + float(p["filter_bias"][f])))
            rows.append(row)
        x = [sum(c) / len(rows) for c in zip(*rows)] + [max(c) for c in zip(*rows)]
        h = [max(0.0, sum(a * float(w) for a, w in zip(x, p["w1"][:, j])) + float(p["b1"][j])) for j in range(q.HIDDEN)]
        z = sum(a * float(w) for a, w in zip(h, p["w2"])) + float(p["b2"][0])
        assert abs(1 / (1 + math.exp(-z)) - got) < 1e-4


def test_a_null_id_is_neither_held_out_nor_learned_from(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert docs.select(q._held_out(docs.doc_id)).where("not isnull(1)").count() == 2
    assert "constant" in q.fit(docs, labels)
