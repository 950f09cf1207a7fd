import math
import random
from collections import defaultdict

import pytest

from folioflow.llm import mixing as mx


def brute_targets(sizes):
    """Reshares the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: mx.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    target = {s: total * w[s] / sum(w.values()) for s in names}
    for _ in range(1000):
        excess = sum(max(0, target[s] - 2 * sizes[s]) for s in names)
        for s in names:
            target[s] = min(target[s], 2 * sizes[s])
        free = [s for s in names if target[s] < 2 * sizes[s]]
        if excess < 1e-9 or not free:
            break
        for s in free:
            target[s] += excess * w[s] / sum(w[x] for x in free)
    return target


def corpus(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"])
        rows.append((i, None if i % 50 == 0 else "w " * r.randint(0, 5 if s == "tiny" else 60), s, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_totals(spark, seed):
    rows = corpus(seed)
    got = mx.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string")).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        m = r["mix"]
        assert m["size"] == len((r["text"] or "").split()) and m["taken"] % max(1, m["size"]) == 0 and m["taken"] <= 2 * m["size"]
        sizes[r["source"]] += m["size"]
        taken[r["source"]] += m["taken"]
    target = brute_targets(sizes)
    for r in got:
        assert r["mix"]["target"] == pytest.approx(target[r["source"]]) and r["mix"]["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes) and len(got) == len(rows)
    epochs = {s: math.floor(target[s] / sizes[s]) if sizes[s] else 0 for s in sizes}
    assert all(r["mix"]["taken"] >= epochs[r["source"]] * r["mix"]["size"] for r in got)


def test_bins_change_nothing_and_reruns_agree(spark):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string, source string, size string")
    rows = lambda **how: sorted((r["doc_id"], r["mix"]["taken"]) for r in mx.mix(df, **how).collect())
    assert rows() == rows(bins=1) == rows(bins=7)


def test_heavier_documents_come_first(spark):
    rows = [(i, "one two", "s", 1.0 if i % 2 else 16.0) for i in range(2000)]
    got = mx.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), weight="q", share=0.5).collect()
    heavy = sum(r["mix"]["taken"] > 0 for r in got if r["q"] > 1)
    assert heavy > 850 and sum(r["mix"]["taken"] for r in got) == 2000


def test_odd_tables(spark):
    t = "doc_id long, text string, source string"
    assert mx.mix(spark.createDataFrame([], t)).count() == 0
    got = mx.mix(spark.createDataFrame([(None, None, None), (1, "", None), (1, "", None)], t)).collect()
    assert [tuple(r["mix"]) for r in got] == [(0, 0, 0.0, 0)] * 3
    one = mx.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], t)).collect()
    assert sorted(r["mix"]["taken"] for r in one) == [2, 4]


def test_weights_on_any_scale(spark):
    rows = [(i, "one two", "s", 0.05 if i % 2 else 0.8) for i in range(2000)] + [(5000 + i, "a", "t", w) for i, w in enumerate([None, 0.0, -1.0, math.nan, math.inf])]
    t = "doc_id long, text string, source string, q double"
    taken = lambda k: {r["doc_id"]: r["mix"]["taken"] for r in mx.mix(spark.createDataFrame([(*r[:3], r[3] and r[3] * k) for r in rows], t), weight="q", share=0.5).collect() if r["source"] == "s"}
    one = taken(1.0)
    assert sum(n > 0 for i, n in one.items() if i % 2 == 0) > 850 and one == taken(1e6) == taken(1e-6)


def test_kept_columns_change_nothing(spark):
    df = spark.createDataFrame(corpus(5), "doc_id long, text string, source string, size string")
    slim = mx.mix(df, keep=["doc_id"])
    assert slim.columns == ["doc_id", "mix"]
    assert sorted(slim.collect(), key=str) == sorted(mx.mix(df).select("doc_id", "mix").collect(), key=str)
