import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioflow.llm import token_counts as tc

PATH = public_tokenizers.path(tc.TOKENIZER)
ODD = [
    None, "", " \n\t ", "Hello, World's don't we'll 123 4½ x²", "áe é", "İstanbul ıI ſ ß", "日本語 text 😀 and more",
    "<|endoftext|> a<|startoftext|>b <|other|>", "x\x1cy\x1dz \x85 \xa0q", "a b　c", "ǅ ǆ ĳ ŉ", "_under_score__ ''' 's'S", "\x00\x01 \x7f",
    "w" * 3000, "ÀÉÎõü straße ŁÓDŹ", "don’t “quote” — dash…", "é" * 50 + " ok", "<|endoftext|", "$$$ a&&b *** ###",
]


def test_lengths_equal_library():
    t = Tokenizer.from_file(PATH)
    own = tc.Lengths(PATH, {})
    for x in ODD:
        assert own.count(x) == (len(t.encode(x, add_special_tokens=False).ids) if x else 0), x


def test_mixed_path_cuts_at_the_tokenizers_white_space():
    t = Tokenizer.from_file(PATH)
    own = tc.Lengths(PATH, {})
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["\u180e", "\u200b", "\u2060", "\ufeff"]
    for c in spaces:
        for x in (f"abc {c} def — x", f"abc{c}def — x", f"ab —{c}{c}日本{c}cd's", f"{c}<|endoftext|>{c}a{c}"):
            assert own.count(x) == len(t.encode(x, add_special_tokens=False).ids), ascii(x)


def test_small_tiers_and_slices(monkeypatch):
    t = Tokenizer.from_file(PATH)
    monkeypatch.setattr(tc, "CACHE", 3)
    monkeypatch.setattr(tc, "SLICE", 5)
    own = tc.Lengths(PATH, {"hello": 1})
    for x in ODD[3:]:
        assert own.count(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_query_over_all_rows(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(PATH)
    docs = pq.read_table(f"{d}/documents.parquet").to_pylist()
    want = {r["doc_id"]: (len(r["text"].encode()), len(t.encode(r["text"], add_special_tokens=False).ids)) for r in docs}
    got = tc.query(spark, d).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "a b", "y")], "doc_id long, text string, tokens string")
    got = tc.count_tokens(df, PATH, out="t").collect()
    assert sorted((r["doc_id"], r["t"]["n_tokens"], r["tokens"]) for r in got) == [(1, 0, "x"), (1, 0, "x"), (2, 2, "y")]
    assert tc.count_tokens(df.where("false"), PATH, out="t").count() == 0


def test_no_pre_token_is_shuffled(spark):
    plan = tc.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
