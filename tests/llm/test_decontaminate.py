import random
import re

from folioflow.llm import decontaminate as dc


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in range(60)] + ["the"] * 40
    items = [(i, ". ".join(" ".join(r.choice(vocab) for _ in range(r.randint(5, 14))) for _ in range(r.randint(1, 6))) + ".") for i in range(150)]
    docs = []
    for d in range(80):
        ws = [r.choice(vocab) for _ in range(r.randint(0, 900))]
        inside = []
        if d % 3 == 0:
            for i, t in r.sample(items, 2):
                k = r.randrange(len(ws) + 1)
                ws[k:k] = t.upper().split() if d % 2 else t.split()
                inside.append(i)
        docs.append((d, " ".join(ws), inside))
    return items, docs


def brute(index, words):
    """All items of an index by scoring every one against every window."""
    found = {}
    for s in range(0, max(1, len(words) - index.window // 2), index.window // 2):
        passage = words[s : s + index.window]
        have = {index.term[w] for w in passage if w in index.term}
        for item in range(len(index.items)):
            score = sum(x for t in have for i, x in zip(index.at[t], index.impact[t]) if i == item)
            if score >= dc.THRESHOLD and min(index.overlap(item, passage)) >= dc.OVERLAP:
                found[item] = max(score, found.get(item, 0))
    return found


def test_search_equals_scoring_everything(monkeypatch):
    monkeypatch.setattr(dc, "POSTINGS_BLOCK", 3)
    items, docs = corpus(1)
    indexes = [x for x in dc.build(items) if isinstance(x, dc.Index)]
    r = random.Random(2)
    for index in indexes:
        for threshold in (0.05, 0.2, 0.5):
            for _ in range(60):
                q = set(r.sample(range(len(index.at)), 40)) | {index.term[w] for w in r.choice(index.items)[::2]}
                all_ = {i: sum(x for t in q for j, x in zip(index.at[t], index.impact[t]) if j == i) for i in range(len(index.items))}
                want = {i for i, s in all_.items() if s >= threshold - 1e-9}
                assert {i for i, _ in index.search(q, threshold)} == want
    for _, text, inside in docs[:40]:
        ws = dc.terms(text)
        for index in indexes:
            assert set(index.hits(ws, dc.THRESHOLD, dc.OVERLAP)) == set(brute(index, ws) if ws else {})
        flat = lambda ws: " " + " ".join(ws) + " "
        whole = {i for i in inside if len(dc.terms(items[i][1])) >= dc.LEAST and flat(dc.terms(items[i][1])) in flat(ws)}
        assert {i for i, _ in dc.find(indexes, text)} >= whole


def test_query_finds_what_is_there_and_nothing_else(spark):
    d = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    got = {r["doc_id"]: set(r["item_ids"]) for r in dc.query(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        inside = {i["item_id"] for i in items if flat(i["text"]) in flat(r["text"])}
        assert inside <= got[r["doc_id"]]
        grams = dc._shingles(dc.terms(r["text"]))
        for i in got[r["doc_id"]] - inside:
            own = dc._shingles(dc.terms(next(x["text"] for x in items if x["item_id"] == i)))
            assert len(own & grams) >= 0.5 * len(own)


def test_odd_rows_and_blocks(spark, monkeypatch):
    text = "one two three four five six seven. Eight nine ten eleven twelve."
    docs = spark.createDataFrame([(1, text.upper(), "x"), (2, None, "x"), (3, "", "y"), (3, "", "y"), (4, "zz " * 100_000 + text, "")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, text), (8, text), (9, None), (10, "too short"), (None, text)], "item_id long, text string")
    want = [("1", [7, 8, None]), ("2", []), ("3", []), ("3", []), ("4", [7, 8, None])]
    show = lambda df: sorted((str(r["doc_id"]), [x["item_id"] for x in r["leaks"]]) for r in df.collect())
    assert show(dc.scan(docs, items)) == want
    assert show(dc.scan(docs, items.where("false"))) == [(i, []) for i, _ in want]
    assert dc.scan(docs.where("false"), items).count() == 0
    monkeypatch.setattr(dc, "BLOCK_BYTES", 40)
    assert show(dc.scan(docs, items)) == want


def test_short_items_are_found_as_runs_of_words(spark):
    items = [(1, "Paris"), (2, "Who wrote Emma?"), (None, "Jane Austen."), (3, "wrote Emma Who"), (4, "...")]
    docs = [(1, "In paris, who wrote EMMA"), (2, "parisian"), (3, "who wrote: emma? jane austen"), (4, None)]
    got = dc.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: [(h["item_id"], h["score"]) for h in r["leaks"]] for r in got} == {1: [(1, 1.0), (2, 1.0)], 2: [], 3: [(2, 1.0), (None, 1.0)], 4: []}


def test_many_blocks_find_the_same_items(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet")
    found = lambda: {r["doc_id"]: sorted(h["item_id"] for h in r["leaks"] if h["score"] > 0.9) for r in dc.scan(docs, items).collect()}
    one = found()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 4000)
    assert found() == one and any(one.values())
