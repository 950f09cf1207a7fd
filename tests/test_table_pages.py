"""The chunks of every page, with a table or without, against plain Python."""

from collections import Counter

import pytest

from folioflow.functions import chunking as ck
from folioflow.plans import catalog
from tests.test_chunking import pack

CELLS = "<p>" + "</p><p>".join(f"row {i} | " + "cell é " * 12 for i in range(30)) + "</p>"
HTML = {
    1: "<p>one</p><p>two</p>",
    2: CELLS,
    3: "<p>" + "plain words. " * 60 + "</p><br/><br/>" + CELLS + "<br/><br/><p>" + "after it " * 90 + "</p>",
    4: "<p>### VLM Extracted: " + "word " * 300 + "</p>",
    5: "<p>**Tableau Extrait 1</p><br/><br/>" + "<p>short</p><br/><br/>" * 80,
    6: "<p>" + "long text. " * 200 + "</p>",
    7: "",
}


def chunks(t, size):
    if "|" in t or "### VLM Extracted:" in t or "**Tableau Extrait" in t:
        return ck.structural_list(t, size)
    return pack([p for p in (x.strip() for x in t.split("\n\n")) if p], size)


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, f"http://h/{k}", v) for k, v in HTML.items()], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def rows(spark, d, name):
    return Counter(tuple(r) for r in catalog.queries()[name](spark, d).collect())


@pytest.mark.parametrize("given", [False, True])
def test_queries_hold_all_pages(spark, fixture_dir, given):
    d = "/root/testdata/sf0.01" if given else fixture_dir
    pages = catalog._pages(spark, d).collect()
    tops = {(r["page_id"], r["url"]): chunks(r["content"], catalog.SIZE) for r in pages}
    if not given:
        assert all(tops[k, f"http://h/{k}"] for k in range(1, 7)) and len(tops[3, "http://h/3"]) > 3
    assert rows(spark, d, "fast_chunks") == Counter((p, i, c) for (p, _), cs in tops.items() for i, c in enumerate(cs))
    assert rows(spark, d, "child_chunks") == Counter((p, i, x) for (p, _), cs in tops.items() for i, c in enumerate(cs) for x in chunks(c, catalog.CHILD))
    assert rows(spark, d, "export_chunks") == Counter((f"{u}_p0_chunk_{i}", c, u) for (_, u), cs in tops.items() for i, c in enumerate(cs))
