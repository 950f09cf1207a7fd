import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from folioflow.llm import bagminhash as bag
from folioflow.llm import near_dup as nd


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, threshold=0.8):
    """Class ids from all pairs."""
    g = [grams(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if g[i] and g[j] and jaccard(g[i], g[j]) >= threshold:
            top[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(30, 120))] * r.choice([1, 1, 1, 3])
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 5, 20])):
            near = list(r.choice(texts[-3:]))
            for _ in range(r.randint(0, 4)):
                near[r.randrange(len(near))] = r.choice(vocab)
            texts.append(near)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_signature_estimates_weighted_jaccard():
    r = np.random.default_rng(3)
    gaps = []
    for _ in range(200):
        e = r.integers(0, 2**63, 60).astype(np.uint64)
        wa, wb = r.integers(0, 20, 60), r.integers(0, 20, 60)
        a, b = np.sort(np.repeat(e, wa)), np.sort(np.repeat(e, wb))
        s = bag.signatures([a, b])
        gaps.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
        assert abs(bag.similarity(a, b) - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 1e-12
    assert abs(np.mean(gaps)) < 0.011


def test_signature_does_not_depend_on_the_batch():
    r = np.random.default_rng(4)
    sets = [np.sort(r.integers(0, 50, k).astype(np.uint64)) for k in (1, 3, 40, 400, 2)]
    assert np.array_equal(bag.signatures(sets), np.vstack([bag.signatures([s]) for s in sets]))


def test_classes_equal_all_pairs(spark):
    rows = corpus(1, 60)
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(rows[::7])] + [(20_000, "a b"), (20_001, "a b"), (20_002, "a  b"), (20_003, "b a")]
    got = nd.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dup"]["class_id"] for r in got} == brute(rows)
    assert all(r["dup"]["kept"] == (r["doc_id"] == r["dup"]["class_id"]) for r in got)


def test_chains_lose_no_link(spark):
    # each text is linked to its neighbours only
    base = [f"v{i}" for i in range(160)]
    rows = [(i, " ".join(base[i : i + 60])) for i in range(0, 100, 3)]
    got = nd.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dup"]["class_id"] for r in got} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, None, "x"), (3, "", "y"), (4, " \n", "y"), (5, "q w e r t y", "z"), (5, "q w e r t y", "z"), (None, "q w e r t y", "z"), (6, "q w e r t y", "z"), (7, "k " * 200_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((str(r["doc_id"]), str(r["dup"]["class_id"]), r["dup"]["kept"]) for r in nd.mark(df).collect())
    assert got == [("1", "1", True), ("2", "2", True), ("3", "3", True), ("4", "4", True), ("5", "5", True), ("5", "5", True), ("6", "5", False), ("7", "7", True), ("None", "5", False)]
    one = nd.deduplicate(df)
    assert one.columns == df.columns and sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "2", "3", "4", "5", "7"]
    assert nd.mark(df.where("false")).count() == 0


def test_one_row_of_near_copies_with_null_or_equal_ids(spark):
    near = lambda c: [" ".join(f"{c}{j}" for j in range(100)) + f" end{i}" for i in range(3)]
    rows = [(None, t, "null") for t in near("n")] + [(7, t, "equal") for t in near("e")] + [(i, t, "mixed") for i, t in zip((None, 9, 9), near("m"))]
    rows += [rows[0], rows[3], rows[8], (8, "a text of its own", "alone"), (None, "another text of its own", "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r["source"], r["doc_id"] or 0) for r in nd.deduplicate(df).collect()) == [("alone", 0), ("alone", 8), ("equal", 7), ("mixed", 9), ("null", 0)]
    kept = {(r["source"], r["text"]) for r in nd.mark(df).collect() if r["dup"]["kept"]}
    assert sorted(s for s, _ in kept) == ["alone", "alone", "equal", "mixed", "null"]


def test_query_equals_all_links(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in nd.query(spark, d).collect()} == brute(docs)


def test_shingles_are_those_of_the_words(monkeypatch):
    texts = ["", " \n", "a", "a b c d", "a b c d e", "é\u3000x 中文 😀 a\x0bb\x1cc", "w" * 90, *(t for _, t in corpus(2, 10))]
    whole = bag.shingle_sets(texts)
    for t, s in zip(texts, whole):
        assert sorted(grams(t).values()) == sorted(np.unique(s, return_counts=True)[1].tolist())
    of = {}
    for t, s in zip(texts, whole):
        for one in grams(t):
            of.setdefault(one, bag.shingle_sets([" ".join(one)])[0][0])
        assert sorted(of[g] for g, k in grams(t).items() for _ in range(k)) == s.tolist()
    # wherever the bytes are cut; longer words are hashed on their own, and alike in any text
    monkeypatch.setattr(bag, "SLICE", 16)
    cut = bag.shingle_sets(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole[:5], cut)) and np.array_equal(cut[6], bag.shingle_sets([texts[6]])[0])


def test_a_long_text_is_drawn_in_parts(monkeypatch):
    r = np.random.default_rng(5)
    sets = [np.sort(r.integers(0, 5000, k).astype(np.uint64)) for k in (20_000, 3, 700)]
    whole = bag.signatures(sets)
    monkeypatch.setattr(bag, "PART", 64)
    assert np.array_equal(bag.signatures(sets), whole)


def test_bands_find_what_is_similar():
    """Of pairs at a similarity of about 0.8, all but 7e-4 share a bucket: of 1500 at most a handful doesn't."""
    r, lost, n = np.random.default_rng(6), 0, 0
    for _ in range(1500):
        e = r.integers(0, 2**63, 111).astype(np.uint64)
        a, b = np.sort(e[:100]), np.sort(e[11:])
        if bag.similarity(a, b) >= 0.8:
            n += 1
            lost += not (bag.bands(bag.signatures([a, b]))[0] == bag.bands(bag.signatures([a, b]))[1]).any()
    assert n == 1500 and lost <= 6


def test_a_bucket_of_many_groups(spark):
    # members of one bucket that form several groups, the largest of them not the first
    core = " ".join(f"c{j}" for j in range(90))
    rows = [(i, core + f" {'x y z u v'.split()[i % 5]}{i % 5} " + " ".join(f"t{i % 5}_{j}" for j in range(28)) + f" e{i}") for i in range(60)]
    got = nd.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dup"]["class_id"] for r in got} == brute(rows) and len(set(brute(rows).values())) == 5


def size_power(df):
    """The power of ten of the size that the driver holds for a plan."""
    return int((re.findall(r"E\+(\d+)", df._jdf.queryExecution().optimizedPlan().stats().simpleString()) or [0])[0])


def test_a_loop_leaves_no_growing_size(spark):
    # joins multiply sizes; kept from checkpoint to checkpoint, they fill the driver's memory
    found = nd.components(spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long"))
    assert {(r["node"], r["label"]) for r in found.collect()} == {(i, 0) for i in range(501)}
    assert size_power(found) < 100


def test_rounds_of_leaders_leave_no_growing_size(spark):
    core = [f"c{j}" for j in range(90)]
    rows = [(i, " ".join(core + [f"t{i % 5}_{j}" for j in range(30)] + [f"e{i}"])) for i in range(60)]
    found = nd.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["least_id"] for r in found.collect()} == set(range(5)) and size_power(found) < 100


def test_a_loop_leaves_no_growing_shuffles(spark, monkeypatch):
    # what a step leaves is dropped before the next ones; else the driver holds the shuffles of all of them
    held, cut = [], nd.cut
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    monkeypatch.setattr(nd, "cut", lambda df: (held.append(shuffles.size()), cut(df))[1])
    nd._release(edges := spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long"))
    assert {r["label"] for r in nd.components(edges).collect()} == {0}
    assert len(held) > 8 and max(held) <= held[0] + 12, held
