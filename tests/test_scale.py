"""Steps whose memory or rows must not depend on how small Spark takes a table to be."""

import time

import pyarrow as pa
import pytest

from folioflow.operators import find
from folioflow.operators.inlines import pieces
from folioflow.operators.rendering import rendered, titles
from folioflow.operators.structure import Containers, document_blocks, streamed, structure
from folioflow.operators.word import to_word
from folioflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["table_delimiters", "standalone_pages", "nested_html", "nested_text", "placed_pictures", "document_titles"])
def test_no_table_that_grows_is_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["nested_html", "nested_text"])
def test_nothing_is_broadcast_while_documents_are_rendered(spark, name):
    """Rendered rows came whole to the driver, as Spark took them for small; what it sees of their size meanwhile must not change the join again."""
    found = QUERIES[name](spark, SF)
    found.collect()
    ran = plan(found)
    assert "isFinalPlan=true" in ran and "Broadcast" not in ran


def test_sizes_of_large_keys(spark, tmp_path):
    """n of the last key is 2 * 1200000^3 * 50^2 bytes, beyond a long."""
    rows = [(1, "a", "b", "t", 1, 7.0), (1_200_000, "a", "b", "t", 50, 7.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.size_text for r in QUERIES["size_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: "1 byte", 1_200_000: "8,640,000 PB"}


def test_blocks_take_one_shuffle_of_whole_documents(spark):
    """Lines are neither exploded nor sorted by Spark; only what is asked for leaves a task."""
    docs = spark.createDataFrame([(1, "# *a*\n\nb [c]\n\n[c]: /d"), (2, None), (3, "e\r\n😀 *f*"), (3, "g")], "doc long, source string")
    found = structure(docs, ("block", "kind", "loc", "text"), inline=False)
    assert "Window" not in plan(found) and plan(found).count("Exchange") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 1, "heading", 0, "*a*"), (1, 2, "paragraph", 7, "b [c]"), (3, 1, "paragraph", 0, "e\ng\n😀 *f*")]
    heads = structure(docs, ("kind", "anchor", "pieces"), kinds=("heading",)).collect()
    assert [(r.doc, r.kind, r.anchor, r.pieces[0][1].text) for r in heads] == [(1, "heading", "a", "a")]


def test_an_index_is_shuffled_once(spark, tmp_path, monkeypatch):
    """Runs of a document are distinct before they are shuffled; documents of one id that share runs are found by all of them only."""
    plans = []
    sort = type(spark.range(0)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(0)), "sortWithinPartitions", lambda df, *c: plans.append(plan(df)) or sort(df, *c))
    docs = spark.createDataFrame([(1, "abcab"), (1, "abc"), (2, "abcd"), (3, None)], "doc_id long, text string")
    find.build_index(docs, f"{tmp_path}/index")
    assert plans[0].count("Exchange") == 1
    assert sorted(r.text for r in find.find(docs, f"{tmp_path}/index", "ABCD").collect()) == ["abcd"]
    assert sorted(r.text for r in find.find(docs, f"{tmp_path}/index", "bca").collect()) == ["abcab"]


def test_ranges_are_dealt_by_document_once(spark):
    """Both sides of the join are dealt by number, not by bytes; the sweep and the counts take the same partitions."""
    found = plan(QUERIES["ranges_in_order"](spark, SF))
    assert found.count("Exchange") == found.count("REPARTITION_BY_NUM") == 2


def test_documents_are_read_once_for_their_pictures(spark):
    """Headers are walked on the side of the files; the tasks that read documents have one Python worker each."""
    found = QUERIES["placed_pictures"](spark, SF)
    assert plan(found).count("MapInArrow") == plan(found).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["nested_html", "markdown_to_word", "document_titles", "placed_pictures"])
def test_documents_made_by_their_key_are_dealt_by_number(spark, name):
    """Else they stay in the partitions that they were made in, which Spark puts together by bytes."""
    found = QUERIES[name](spark, SF)
    assert plan(found).count("REPARTITION_BY_NUM") == plan(found).count("MapInArrow") == 1


def test_titles_stop_at_the_first_heading_with_words(spark, monkeypatch):
    """Lines behind a title go through no automaton; headings without words, and references defined later, count as before."""
    read = []
    line = Containers.line
    monkeypatch.setattr(Containers, "line", lambda self, pos, base, text: read.append(pos) or line(self, pos, base, text))
    source = "# ![](p.png)\n\n## [a]\n\n" + "word\n\n" * 500 + "# later\n\n[a]: /u\n"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([source])], names=["doc", "source"])
    made = pa.Table.from_batches(list(streamed(iter([batch]), ("block", "kind", "lines", "pieces"), kinds=("heading",), to_title=True))).to_pylist()
    assert [x["block"] for x in made] == [1, 2] and made[1]["pieces"][0][0]["link"] == "/u" and len(read) < 10
    docs = spark.createDataFrame([(1, "# \n\n# *b*\n# c"), (2, "a\n"), (3, "#\n\n# ![](p.png)\n\n# d"), (4, None)], "doc long, source string")
    assert sorted(map(tuple, titles(docs).collect())) == [(1, "b"), (2, "Untitled"), (3, "[image: p.png]"), (4, "Untitled")]


@pytest.mark.parametrize("text", ["a" + " " * 40_000 + "b", "a" + "! " * 40_000 + "\n b"])
def test_blanks_take_time_by_their_length(text):
    """Each blank of a run was tried as the begin of a line's end, which took seconds."""
    began = time.process_time()
    assert "".join(p["text"] for p in pieces(text)).replace(" ", "") == text.replace(" ", "")
    assert time.process_time() - began < 0.5


@pytest.mark.parametrize("name, tables", [("markdown_to_word", 1), ("document_titles", 1), ("nested_html", 2), ("nested_text", 2)])
def test_documents_are_made_once(spark, name, tables):
    """What is made of documents needs no second reading of their tables to be joined to."""
    assert plan(QUERIES[name](spark, SF)).count("FileScan") == tables


def test_each_row_of_documents_has_one_of_the_result(spark):
    """Copies are rendered for each row, of all their lines; null, empty and unnamed documents keep their rows."""
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, ""), (4, None), (4, "c"), (None, "d"), (None, "e")], "doc long, source string")
    got = lambda df: sorted(((r[0] or 0, r[1]) for r in df.collect()))
    assert got(rendered(docs, "text")) == [(0, ""), (0, ""), (1, "a\nb\n"), (1, "a\nb\n"), (2, ""), (3, ""), (4, "c\n"), (4, "c\n")]
    assert got(titles(docs)) == [(k, "Untitled") for k in (0, 0, 1, 1, 2, 3, 4, 4)]
    words = [(k, x.count("<w:p>"), x.count("<w:t ")) for k, x in got(to_word(docs))]
    assert words == [(0, 0, 0), (0, 0, 0), (1, 1, 3), (1, 1, 3), (2, 0, 0), (3, 0, 0), (4, 1, 1), (4, 1, 1)]


@pytest.mark.parametrize("text", ["# a" + " " * 40_000 + "b", "# a" + " #" * 20_000 + " b"])
def test_headings_take_time_by_their_length(text):
    """Each blank of a run was tried as the begin of a heading's end, which took seconds."""
    began = time.process_time()
    assert [b["text"] for b in document_blocks([text], True, None)] == [text[2:]]
    assert time.process_time() - began < 0.5
    ends = {"# a # ": "a", "# a#": "a#", "# #": "", "## # #": "#", "#": "", "# a  ": "a", "# a ## b #": "a ## b"}
    assert {x: next(document_blocks([x], True, None))["text"] for x in ends} == ends
