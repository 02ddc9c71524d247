"""The queries' inputs hold every line of a document whole."""

import pytest

from folioflow.plans import inputs
from folioflow.plans.queries import QUERIES

LINES = [f"start{i}x " + "word " * 30 + f"end{i}x" for i in range(40)]


@pytest.fixture()
def sf(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(LINES))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, column", [("markdown_blocks", "text"), ("markdown_to_html", "data"), ("markdown_to_text", "data"), ("markdown_to_word", "data"), ("line_classes", "content")])
def test_queries_see_whole_lines(spark, sf, name, column):
    got = "\n".join(r[column] or "" for r in QUERIES[name](spark, sf).collect())
    assert [i for i in range(len(LINES)) if f"start{i}x" not in got or f"end{i}x" not in got] == []


def test_outline_has_whole_titles(spark, sf):
    got = [r.title for r in QUERIES["markdown_outline"](spark, sf).orderBy("ord").collect()]
    assert got == [x for i, x in enumerate(LINES) if i % 16 in (0, 14)]


def test_lines_stand_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = inputs.markdown_documents(docs).first().source
    places = [source.find(x) for x in LINES]
    assert places == sorted(places) and places[0] >= 0
    rows = inputs.marked_lines(docs).orderBy("pos").collect()
    assert len({r.pos for r in rows}) == len(rows) and [r.text for r in rows if r.text == ""] == [""] * 4
    assert all(any(x in r.text for r in rows) for x in LINES)
