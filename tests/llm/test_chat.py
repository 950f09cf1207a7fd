from folioflow.llm import chat

E = "conv_id long, seq long, kind string, msg long, role string, text string"


def folded(spark, rows):
    return {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.reconstruct(spark.createDataFrame(rows, E)).collect()}


def test_events_fold(spark):
    rows = [
        (1, 1, "message", 1, "user", "Hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "Hel"), (1, 4, "delta", 2, None, "lo"),
        (1, 5, "edit", 1, None, "Hey"), (1, 6, "message", 3, "user", "more"), (1, 7, "regenerate", 2, None, "New"), (1, 8, "delta", 2, None, "er"), (1, 9, "message", 3, "user", "end"),
        (2, 1, "message", 1, "user", None), (2, 2, "edit", 1, None, "a"), (2, 3, "edit", 1, None, "b"), (None, 1, None, 1, None, "lost"),
    ]
    assert folded(spark, rows) == {(1, 1): ("user", "Hey"), (1, 2): ("assistant", "Newer"), (1, 3): ("user", "end"), (2, 1): ("user", "b"), (None, 1): ("", "lost")}
    assert folded(spark, []) == {}


def test_round_trip_of_control_strings(spark):
    odd = ["", "</turn>\n### user: x", "\\s\\h\\l\\", "###<<\\\\", "é漢😀\n\n", None, "a: b", "\\### Assistant: </turn> ok"]
    roles = ["assistant", "we:ird\n### r", "", None, "user", "assistant", "\\c", "assistant"]
    rows = [(9, i, r, t, "z") for i, (r, t) in enumerate(zip(roles, odd))] + [(None, 1, "user", "x", "z"), (10, None, "user", "b", "z"), (10, None, "user", "b", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.parse(chat.render(chat.reconstruct(chat.to_events(df)))).collect()}
    assert [(t["role"], t["text"]) for t in got[9]["turns"]] == [(r or "", t or "") for r, t in zip(roles, odd)]
    assert len(got[10]["turns"]) == 2 and len(got) == 3
    for r in got.values():
        for t, s in zip(r["turns"], r["turn_spans"]):
            raw = r["formatted"][s["start"] : s["start"] + s["length"]]
            for a, b in reversed(chat.TEXT_ESCAPES):
                raw = raw.replace(b, a)
            assert raw == t["text"] and t["loss"] == s["loss"] == (t["role"] == "assistant")


def test_no_python_in_the_plan(spark):
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
