import numpy as np
import pytest

from folioflow.llm import url_filter as uf

T = "page_id long, url string, html string, host string"


def verdicts(df):
    return {r["page_id"]: (r["f"]["host"], r["f"]["path"], r["f"]["rule"], r["f"]["verdict"]) for r in df.collect()}


def test_parts_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/7x?q#f", None, "h"), (2, "x://example.com/en/6", None, "h"), (3, None, None, None), (4, "no scheme/en/", None, "h"),
        (5, "a://b.net?x=/de/", None, "h"), (6, "a://b.net/de/8", None, "h"), (7, "a://c.example.net/de/8#", None, "h"), (8, "q://notcom/en/", None, "h"),
        (9, "a\n://org/es/", None, "h"), (9, "a\n://org/es/", None, "h"), (10, "http://com", "", "h"), (11, "://", None, "h"),
    ]
    got = verdicts(uf.judge(spark.createDataFrame(rows, T), out="f"))
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[5] == ("b.net", "", None, "allow")
    assert got[6][2:] == ("net/de/", "allow") and got[7][2:] == ("example.net/de/8", "block") and got[8][2:] == (None, "allow")
    assert got[9] == ("org", "/es/", "org/es/", "block") and got[10][:3] == ("com", "", None) and got[11][:3] == ("", "", None)
    assert uf.judge(spark.createDataFrame([], T)).count() == 0


def brute_rank(edges, seeds, nodes):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    r = dict(seeds)
    for _ in range(300):
        lost = sum(r.get(h, 0) for h in nodes if h not in out)
        r = {h: (1 - uf.DAMPING) * seeds.get(h, 0) + uf.DAMPING * (sum(r.get(a, 0) * n / out[a] for (a, b), n in edges.items() if b == h) + lost * seeds.get(h, 0)) for h in nodes}
    return r


def test_ranks_equal_brute_force(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 5, ("d", "c"): 1, ("c", "e"): 1}
    seeds = {"a": 0.75, "e": 0.25}
    df = uf.spread(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, s double"))
    want = brute_rank(edges, seeds, set("abcde"))
    got = {r["host"]: r["r"] for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 0.006 for h in want)
    assert sum(got.values()) == pytest.approx(1)


def test_a_long_chain_and_a_hub_settle(spark):
    """Rank gets to hosts far from the seed, and a host that thousands link to is settled; the error bound holds over all hosts."""
    n = 3000
    edges = [(f"c{i}", f"c{i + 1}", 1) for i in range(20)] + [(f"h{i}", "hub", 1 + i % 3) for i in range(n)] + [("hub", f"h{i}", 1) for i in range(n)]
    seeds = {"c0": 0.5, "h7": 0.5}
    df = uf.spread(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, s double"))
    got = {r["host"]: r["r"] for r in df.collect()}
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {h: i for i, h in enumerate(names)}
    src, dst, w = np.array([at[a] for a, *_ in edges]), np.array([at[b] for _, b, _ in edges]), np.array([k for *_, k in edges], float)
    out = np.bincount(src, w, len(names))
    s = np.zeros(len(names))
    for h, x in seeds.items():
        s[at[h]] = x
    r = s.copy()
    for _ in range(400):
        r = (1 - uf.DAMPING) * s + uf.DAMPING * (np.bincount(dst, r[src] * w / out[src], len(names)) + r[out == 0].sum() * s)
    assert sum(abs(got[h] - r[at[h]]) for h in names) <= uf.TOLERANCE * uf.DAMPING / (1 - uf.DAMPING)
    assert got["c20"] > 0.001 and got["hub"] > 0.1


def test_distrust_follows_links_backwards(spark):
    link = lambda *hs: "".join(f'<A class=x HREF="http://{h}/p">t</A>' for h in hs)
    rows = [(1, "http://bad.com/en/1", "", ""), (2, "http://fan.test/x", link("bad.com", "bad.com"), ""), (3, "http://good.net/de/1", link("friend.test"), ""), (4, "http://friend.test/", "<a href='/own'>", ""), (5, "http://lone.test/", "<a href=//fan.test/y>", "")]
    got = verdicts(uf.judge(spark.createDataFrame(rows, T), out="f"))
    assert {i: v[3] for i, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}
