import numpy as np
import pandas as pd

from folioflow.operators import layout


def order(boxes, w=600, h=800, y_down=False):
    return layout.xy_order(np.array(boxes, float), w, h, y_down)


def test_reading_orders():
    assert order([[0, 700, 250, 750], [0, 600, 250, 650], [350, 700, 600, 750], [350, 600, 600, 650]]) == [0, 1, 2, 3]
    assert order([[50, 740, 550, 780], [50, 600, 250, 700], [350, 600, 550, 700]]) == [0, 1, 2]
    assert order([[0, 10, 100, 20], [0, 40, 100, 50]], y_down=True) == [0, 1] and order([[0, 10, 100, 20], [0, 40, 100, 50]]) == [1, 0]
    assert order([]) == [] and order([[0, 0, 1, 1]]) == [0]
    assert order([[20, 0, 30, 10], [0, 0, 10, 10], [10, 0, 20, 10]]) == [1, 2, 0]


def test_intervals_and_gaps(spark):
    rows = [(1, 0.0, 5.0), (1, 5.0, 7.0), (1, 20.0, 30.0), (1, 1.0, 2.0), (1, 45.0, 46.0), (2, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, s double, e double")
    got = sorted(tuple(r) for r in layout.merge_intervals(df, ["k"], "s", "e").collect())
    assert got == [(1, 0.0, 7.0), (1, 20.0, 30.0), (1, 45.0, 46.0), (2, 0.0, 1.0)]
    assert [tuple(r) for r in layout.largest_gap(df, ["k"], "s", "e", 8.0).collect()] == [(1, 37.5)]
    assert layout.largest_gap(df, ["k"], "s", "e", 16.0).count() == 0


def test_gaps_of_equal_and_nested_intervals(spark):
    # equal rows, one interval within another, two gaps of one width, and starts that are missing
    rows = [(1, 0.0, 9.0), (1, 0.0, 9.0), (1, 2.0, 3.0), (1, 19.0, 20.0), (1, 19.0, 20.0), (1, 30.0, 31.0), (1, None, 99.0), (2, None, None), (2, 1.0, 2.0), (2, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k int, s double, e double")
    assert sorted(tuple(r) for r in layout.largest_gap(df, ["k"], "s", "e", 5.0).collect()) == [(1, 14.0), (2, 5.5)]
    got = sorted(tuple(r) for r in layout.merge_intervals(df, ["k"], "s", "e").collect())
    assert got == [(1, 0.0, 9.0), (1, 19.0, 20.0), (1, 30.0, 99.0), (2, 1.0, 2.0), (2, 9.0, 9.0)]


def test_a_gap_takes_one_sort(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0)], "k int, s double, e double")
    plan = layout.largest_gap(df, ["k"], "s", "e", 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Aggregate [") == 1


def test_many_pages_are_cut_as_one_by_one():
    rng = np.random.default_rng(7)
    for y_down in (False, True):
        pages = []
        for _ in range(400):
            n = int(rng.integers(1, 40))
            low = rng.integers(0, 40, (n, 2)) * rng.choice([5.0, 20.0])
            pages.append(np.concatenate([low, low + rng.integers(-1, 12, (n, 2)) * 5.0], 1))
            if rng.random() < 0.1:
                pages[-1][0, int(rng.integers(4))] = rng.choice([np.nan, np.inf])
        first = np.cumsum([0, *map(len, pages[:-1])])
        got = layout.xy_ranks(np.concatenate(pages), first, 600.0, 800.0, y_down)
        for at, page in zip(first, pages):
            assert np.argsort(got[at : at + len(page)]).tolist() == layout.xy_order(page, 600.0, 800.0, y_down)


def test_pages_across_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(None if p == 3 else f"p{p}", i, *map(float, rng.integers(0, 50, 2) * 10), 0.0, 0.0) for p in range(60) for i in range([1, 3, 40][p % 3])]
    rows = [(*r[:4], r[2] + 15, r[3] + 8) for r in rows]
    df = spark.createDataFrame(rows, "page string, idx int, x0 float, y0 float, x1 float, y1 float").coalesce(1)
    want = {}
    for p in {r[0] for r in rows}:
        boxes = sorted(r[1:] for r in rows if r[0] == p)
        want |= {(p, boxes[k][0]): at for at, k in enumerate(layout.xy_order(np.array([b[1:] for b in boxes]), 600, 800))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = layout.reading_order(df, 600.0, 800.0, key="page").collect()
            assert len(got) == len(rows) and {(r["page"], r["idx"]): r["reading_index"] for r in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def line(text, x, y, size=10.0, step=6.0):
    return [(c, x + i * step, x + (i + 1) * step - 0.5, y + size, y) for i, c in enumerate(text) if c != " "]


def glyphs(*lines):
    return pd.DataFrame([g for l in lines for g in l], columns=["c", "left", "right", "top", "bottom"])


def test_two_columns_of_glyphs():
    g = glyphs(line("left one", 0, 100), line("right one", 300, 100), line("left two", 0, 80), line("right two", 300, 80))
    assert layout.page_text(g).split() == "left one left two right one right two".split()
    assert layout.page_text(g.iloc[:0]) == ""


def test_wide_capitals_are_headings():
    # blanks of 10 units stay within a cell, whose limit is 15 at this height
    g = glyphs(line("BIG TITLE HERE", 0, 200, step=10), line("body", 0, 100))
    assert layout.page_text(g).startswith("\n# BIG TITLE HERE\n\n")


def test_glyph_pages(spark):
    rows = [(p, i, c, *map(float, g)) for p in (1, 2) for i, (c, *g) in enumerate(line(f"page {p}", 0, 10))]
    df = spark.createDataFrame(rows, "page_id long, idx int, c string, left float, right float, top float, bottom float")
    assert {r["page_id"]: r["content"] for r in layout.glyph_text(df).collect()} == {1: "page 1\n", 2: "page 2\n"}


def test_complex_layout_and_tables():
    assert layout.is_complex([(0, 10, 10, 0)] * 30) and not layout.is_complex([(i * 20, i * 20 + 10, 10, 0) for i in range(30)])
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30]], float)
    assert layout.non_max_suppression(boxes, np.array([0.9, 0.8, 0.3])) == [0, 2]
    g = glyphs(line("ab", 0, 50), line("cd", 60, 50), line("ef", 0, 30), line("gh", 60, 30))
    assert layout.table_markdown(g, (0, 0, 100, 100)) == "| ab | cd |\n|---|---|\n| ef | gh |"
