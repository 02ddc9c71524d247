"""Text functions on cases that the tables don't hold."""

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import geometry, text

CASES = ["", " ", "é", "é", "日本", "😀é", "👨‍👩‍👧 x", "a b c\u0085d\x0be", "\t x 　", "Hello, World!", "ÀB--c_d", "12,5%", "#", "*a_b`c\\", "|x", "👍🏽"]


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_units_and_words(spark):
    s = F.col("s")
    got = column(spark, CASES, text.utf16_length(s), text.grapheme_length(s), text.word_count(s))
    assert got == [(len(v.encode("utf-16-le")) // 2, len(regex.findall(r"\X", v)), len(v.split())) for v in CASES]


def test_random_text(spark):
    values = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF), max_size=20))
    def gather(v):
        values.append(v)

    gather()
    s = F.col("s")
    for v, (units, inline, html) in zip(values, column(spark, values, text.utf16_length(s), text.escape_inline(s), text.html_escape(s)), strict=True):
        assert units == len(v.encode("utf-16-le")) // 2
        assert inline == regex.sub(r"([*_`\\])", r"\\\1", v)
        assert html == v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def test_escapes_and_slugs(spark):
    s = F.col("s")
    got = column(spark, CASES, text.slug(s), text.escape_line(s), text.trim_blanks(s))
    assert [g[0] for g in got][9:12] == ["hello-world", "àb-c-d", "12-5"]
    assert [g[1] for g in got][12:15] == ["\\#", "\\*a\\_b\\`c\\\\", "\\|x"]
    assert got[8][2] == "x"


def test_list_continuation(spark):
    lines = ["- a", "  * [x] b", "9. c", "12) ", "- [ ] ", "plain", "-no", "+ é"]
    assert [g[0] for g in column(spark, lines, text.continued_list(F.col("s")))] == ["\n- ", "\n  * [ ] ", "\n10. ", "", "", None, None, "\n+ "]


def test_paths_numbers_and_colours(spark):
    paths = ["/home/me/a b/c.tar.MD", "/home/me/x", "/homely/y.z", "noext"]
    s = F.col("s")
    assert column(spark, paths, text.extension(s), text.suggested_name(s, "html"), text.short_directory(s, "/home/me")) == [("md", "c.tar.html", "~/a b"), ("", "x.html", "~"), ("z", "y.html", "/homely"), ("", "noext.html", "noext")]
    assert [g[0] for g in column(spark, ["a%20b+c", "%zz", "é"], text.percent_decoded(s))] == ["a b+c", None, "é"]
    assert column(spark, ["#FF0080", "00ff0033", "red"], text.hex_channel(s, 0), text.hex_channel(s, 3)) == [(1.0, 1.0), (0.0, 0.2), (None, None)]


def test_sizes(spark):
    row = spark.range(1).select(geometry.image_scale(F.lit(2000.0), F.lit(1000.0), F.lit(10.0)), geometry.grid_scale(F.lit(760.0), F.lit(720.0)), geometry.heading_points(F.lit(9)), *geometry.emu_size(F.lit(2000.0), F.lit(1000.0)), *geometry.clamped_progress(F.lit(0), F.lit(-1), F.lit(3.0))).first()
    assert [round(x, 6) for x in row] == [0.04, 0.94, 14.72, 5943600, 2971800, 1, 1, 1.0]


def test_selections(spark):
    s, at = F.col("s"), F.lit
    rows = ["a😀b c", "x **b** y", "x **b** y"]
    got = column(spark, rows, text.utf16_slice(s, at(1), at(3)), text.wrapped(s, at(4), at(1), "**"))
    assert got[0] == ("😀b", "a😀b** **c") and got[1][1] == "x b y"
    assert column(spark, ["x **b** y"], text.wrapped(s, at(2), at(5), "**"))[0] == ("x b y",)
    assert column(spark, ["t"], text.link(s, at(None)), text.toggled_checkbox(at("[X]")), text.toggled_checkbox(at("[ ]")))[0] == ("[t]()", "[ ]", "[x]")
    page = column(spark, ["a<b"], text.standalone(s, at("<p>x</p>"), text.css_variables({"ink": "#111"})))[0][0]
    assert "<title>a&lt;b</title><style>:root{--ink:#111;}</style>" in page and page.endswith("<body>\n<p>x</p></body></html>\n")
