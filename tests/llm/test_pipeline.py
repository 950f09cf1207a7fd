import re

import pytest

import corpus_pipeline as cp
from folioflow.llm import decontaminate, pii, quality_model
from tests.llm.test_near_dup import brute as brute_classes

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it made."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{D}/documents.parquet"), {}
    for name, f in cp.STAGES:
        f(spark, docs, D).write.parquet(f"{at}/{name}")
        made = spark.read.parquet(f"{at}/{name}")
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()], docs.columns, made.columns)
        docs = made
    return out


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dup", "decontamination", "pii", "mixing"] and cp.ORACLE_SQL is None
    for name, (_, _, given, made) in stages.items():
        assert made == given if name != "mixing" else made[: len(given)] == given


def test_quality_rejects_what_scores_low(spark, stages):
    given, made, *_ = stages["quality"]
    params = quality_model.fit(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    kept = {r["doc_id"] for r, s in zip(given, quality_model.score(params, [r["text"] for r in given])) if s >= quality_model.THRESHOLD}
    assert {r["doc_id"] for r in made} == kept and 0 < len(kept) < len(given)


def test_one_of_each_group_stays(stages):
    given, made, *_ = stages["near_dup"]
    ids = brute_classes([(r["doc_id"], r["text"]) for r in given])
    assert sorted(r["doc_id"] for r in made) == sorted(set(ids.values()))


def test_documents_with_test_items_go(spark, stages):
    given, made, *_ = stages["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    dirty = {r["doc_id"] for r in given if any(flat(i) in flat(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in made}
    assert not dirty & kept
    for r in given:
        if r["doc_id"] not in dirty | kept:
            own = decontaminate._shingles(decontaminate.terms(r["text"]))
            assert any(len(g & own) >= 0.5 * len(g) for g in (decontaminate._shingles(decontaminate.terms(i)) for i in items))


def test_personal_data_gives_way(stages):
    given, made, *_ = stages["pii"]
    new = {r["doc_id"]: r for r in made}
    for r, (_, spans) in zip(given, pii.find([r["text"] for r in given])):
        assert new[r["doc_id"]]["text"] == pii.redact(r["text"], spans) and new[r["doc_id"]]["n_chars"] == len(new[r["doc_id"]]["text"])
        assert not pii.base_spans(new[r["doc_id"]]["text"])


def test_the_mix_comes_near_its_targets(stages):
    given, made, *_ = stages["mixing"]
    by = {}
    for r in made:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    longest = max(len(r["text"].split()) for r in given)
    assert made and all(abs(t - n) <= longest for t, n in by.values()) and all(0 < r["taken"] <= 2 * r["size"] for r in made)


def test_run_is_the_stages(spark, stages):
    assert sorted(r["doc_id"] for r in cp.run(spark, D).collect()) == sorted(r["doc_id"] for r in stages["mixing"][1])
