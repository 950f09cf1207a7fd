import re
from collections import Counter

from folioflow.llm import quality_rules as qr

LONG = "the " + " ".join(f"word{i}" for i in range(40))


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines, seen, dup = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


TEXTS = [None, "", " \n ", "one", LONG, LONG + "\n" + LONG, "a b c d e " * 30, "x y z w v u " + LONG + " x y z w v", "l\n" * 20 + LONG, "$ # a|b <c> & é漢😀 " + LONG, "a" * 100_000, "p q " * 60_000, "\x85 \xa0 　 a", "\n\n\x0b" + LONG + "\x0c"]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_words long")
    got = qr.judge(df)
    assert got.columns == ["doc_id", "text", "n_words", "rules"]
    for r in got.collect():
        v = r["rules"]
        assert (v["n_words"], v["word_chars"], v["n_symbols"], v["n_dup_lines"], v["n_repeat_words"], v["base_failed"]) == brute(r["text"]), r["doc_id"]
        assert not (v["base_failed"] and v["kept"])


def test_the_table_of_rules_decides(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    kept = lambda *rules: qr.judge(df, rules=rules).first()["rules"]["kept"]
    assert kept() and kept(*qr.RULES) and kept(qr.Rule("n_words", 41, 41)) and not kept(qr.Rule("n_words", high=40)) and not kept(qr.Rule("stop_share", low=0.5))
    assert qr.judge(df.where("false")).count() == 0
    plan = qr.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    got = qr.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed").collect()
    assert sum(r["kept"] for r in got) > 0.98 * len(got)
