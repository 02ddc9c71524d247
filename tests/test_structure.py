"""Containers, inline marks and what is made of them: golden cases, places against the source, and odd inputs."""

import random
import re
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.operators import inlines, offsets, ranges, rendering, word
from folioflow.operators.structure import Anchors, Containers, structure
from folioflow.sources import files

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docs(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources)), "doc long, source string")


HTML = [
    ("> - a\n>   b\n> lazy\nlazier\n\n> new", "<blockquote>\n<ul>\n<li>a\nb\nlazy\nlazier</li>\n</ul>\n</blockquote>\n<blockquote>\n<p>new</p>\n</blockquote>\n"),
    ("- a\n\n  second\n\n  ```\n  x\n\n   y\n  ```\n- b", "<ul>\n<li><p>a</p>\n<p>second</p>\n<pre><code>x\n\n y</code></pre>\n</li>\n<li>b</li>\n</ul>\n"),
    ("1. a\n   > q\n   >> r\n\n   - [ ] c\n2. d", '<ol>\n<li><p>a</p>\n<blockquote>\n<p>q</p>\n<blockquote>\n<p>r</p>\n</blockquote>\n</blockquote>\n<ul class="task-list">\n<li class="task-item"><input type="checkbox" disabled> c</li>\n</ul>\n</li>\n<li>d</li>\n</ol>\n'),
    ("    code\n\n      more\n    \ntext\n    not code", "<pre><code>code\n\n  more</code></pre>\n<p>text\nnot code</p>\n"),
    ("> ```\n> x\ny", "<blockquote>\n<pre><code>x</code></pre>\n</blockquote>\n<p>y</p>\n"),
    ("-\n\n- a\n\t- b", "<ul>\n<li></li>\n<li><p>a</p>\n<ul>\n<li>b</li>\n</ul>\n</li>\n</ul>\n"),
    ("- # h\n- > q", '<ul>\n<li><h1 id="h">h</h1>\n</li>\n<li><blockquote>\n<p>q</p>\n</blockquote>\n</li>\n</ul>\n'),
    ("p\n| a | b |\n|:-:|--:|\n| `x\\|y` | *z*\n> q", '<p>p</p>\n<table>\n<thead>\n<tr>\n<th style="text-align:center">a</th>\n<th style="text-align:right">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style="text-align:center"><code>x|y</code></td>\n<td style="text-align:right"><em>z</em></td>\n</tr>\n</tbody>\n</table>\n<blockquote>\n<p>q</p>\n</blockquote>\n'),
    ("| a |\n|---|---|\n", "<p>| a |\n|---|---|</p>\n"),
    ("``a ` b`` &amp; &lt; &#35; &nope; \\&amp;", "<p><code>a ` b</code> &amp; &lt; # &amp;nope; &amp;amp;</p>\n"),
    ("_a **b**_ ***c** d* **e*f*g**", "<p><em>a <strong>b</strong></em> <em><strong>c</strong> d</em> <strong>e<em>f</em>g</strong></p>\n"),
    ("[t](http://a.b/c_(d)) [*a* [b](c)](d) ![x *y*](<p q> 't')", '<p><a href="http://a.b/c_(d)">t</a> [<em>a</em> <a href="c">b</a>](d) <img src="p q" alt="x y" title="t"></p>\n'),
    ("*a [b*](c)* ~~d~~ ~e~ ~~~f~~~ <mailto:x@y.z> <x@y.z>", '<p><em>a <a href="c">b*</a></em> <del>d</del> <del>e</del> ~~~f~~~ <a href="mailto:x@y.z">mailto:x@y.z</a> <a href="mailto:x@y.z">x@y.z</a></p>\n'),
    ("a  \nb\\\nc <br/> <!-- x --> <?y?>", "<p>a<br>\nb<br>\nc <br/> <!-- x --> <?y?></p>\n"),
    ("<!-- a\n\n*b*\n-->\n*c*\n\n<x y='z'>\n*d*\n\n*e*", "<!-- a\n\n*b*\n-->\n<p><em>c</em></p>\n<x y='z'>\n*d*\n<p><em>e</em></p>\n"),
    ("1) a\n2. b\n\n3. c\n- d\n+ e", '<ol>\n<li>a</li>\n</ol>\n<ol start="2">\n<li>b</li>\n<li>c</li>\n</ol>\n<ul>\n<li>d</li>\n</ul>\n<ul>\n<li>e</li>\n</ul>\n'),
    ("a\n2. b\n1. c", "<p>a\n2. b</p>\n<ol>\n<li>c</li>\n</ol>\n"),
    ("- a\n ***\n- - -", "<ul>\n<li>a</li>\n</ul>\n<hr>\n<hr>\n"),
    ("[a][B c] [b  C] [b c][] ![x][b c] [d][e] [f]\n\n> [b C]: <u v> \"t\"\n\n[f]: /w\n[b c]: later\n[g]: h i", '<p><a href="u v" title="t">a</a> <a href="u v" title="t">b  C</a> <a href="u v" title="t">b c</a> <img src="u v" alt="x" title="t"> [d][e] <a href="/w">f</a></p>\n<blockquote>\n</blockquote>\n<p>[g]: h i</p>\n'),
    ("[*a*][x]\ntext\n[x]: y\n\n[x]: /z 'q'\nrest", '<p><a href="/z" title="q"><em>a</em></a>\ntext\n<a href="/z" title="q">x</a>: y</p>\n<p>rest</p>\n'),
    ("", ""), ("\n \n\t\n", ""), (">", "<blockquote>\n</blockquote>\n"),
]


def test_html(spark):
    got = rendering.rendered(docs(spark, *(s for s, _ in HTML)), "html").orderBy("doc").collect()
    assert [(s, r.data) for (s, _), r in zip(HTML, got, strict=True)] == HTML


TEXT = [
    ("- a\n\n  second\n\n  > q\n- [x] b\n  1. c\n\n     d\n\nend", "•  a\n\n   second\n\n>    q\n\n[x] b\n\n   1. c\n\n      d\n\n\nend\n"),
    ("> 7. x\n>    y", "> 7. x\n>    y\n"),
    ("- \n- <b>\n- ```\n  z", "•\n\n•\n\n•      z\n"),
    ("[a](b) [b](b) [`c`](d) &copy; ![e](f)", "a (b) b c (d) © [image: e — f]\n"),
]


def test_text(spark):
    got = rendering.rendered(docs(spark, *(s for s, _ in TEXT)), "text").orderBy("doc").collect()
    assert [(s, r.data) for (s, _), r in zip(TEXT, got, strict=True)] == TEXT


PRIVATE = "".join(chr(c) for c in range(0xE000, 0xE100))


@pytest.mark.parametrize("raw_html", [True, False])
def test_private_characters_stay_what_they_are(spark, raw_html):
    source = f"{PRIVATE}\n\n\ue001script\ue002alert(1)\ue001/script\ue002 *\ue02aa\ue02a* `\ue060`\n\n# \ue03cb\ue03e\n\n| \ue07c |\n|-|\n| \ue03cb\ue03e |\n"
    html = rendering.rendered(docs(spark, source), "html", raw_html=raw_html).first().data
    private = lambda text: [c for c in text if "\ue000" <= c <= "\uf8ff"]
    assert private(html) == private(source) and len(private(source)) > 256
    assert "<script" not in html and "<b>" not in html and f"<p>{PRIVATE}</p>" in html
    assert private(rendering.rendered(docs(spark, source), "text").first().data) == private(source)


OURS = re.compile(r'</?(?:p|h[1-6]|em|strong|del|code|pre|blockquote|ul|ol|li|table|thead|tbody|tr|th|td|a|img|br|hr|input|span)(?: [a-z]+="[^"<>]*"| disabled| checked)*>')


def test_no_tag_of_a_source_is_left_without_raw_html(spark):
    rng = random.Random(8)
    bits = ["<script>", "</script>", "<img src=x onerror=y>", "<!-- ", "-->", "<a href='j'>", "\ue001", "\ue002", "`", "``", "*", "[", "](", ")", "&lt;", "&#60;", "<", ">", '"', "\n", "\n\n", "> ", "- ", "| a |\n|-|\n", "<div>\n", "\\<", "x", " "]
    sources = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for r in rendering.rendered(docs(spark, *sources), "html", raw_html=False).collect():
        left = OURS.sub("", r.data)
        assert "<" not in left and ">" not in left, (sources[r.doc], r.data)


def test_every_place_is_that_of_the_source(spark):
    rng = random.Random(3)
    bits = ["a", "é", "😀", " ", "*", "**", "_", "`", "``", "~~", "[", "](u)", "![", "\n", "\n> ", "\n- ", "\n  ", "\\*", "&amp;", "<http://x.y>", "\n\n", "| b ", "|\n|-|\n", "# "]
    sources = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    units = [s.encode("utf-16-le") for s in sources]
    cut = lambda doc, loc, n: units[doc][2 * loc : 2 * (loc + n)].decode("utf-16-le")
    found = structure(docs(spark, *sources)).cache()
    marks = {"strong": {"**", "__"}, "em": {"*", "_"}, "del": {"~", "~~"}}
    rows = inlines.delimiters(found).collect()
    assert len(rows) > 200
    for r in rows:
        shown = cut(r.doc, r["loc"], r["len"])
        if r.kind in marks:
            assert shown in marks[r.kind]
        elif r.kind == "code":
            assert set(shown) == {"`"}
        else:
            assert shown[0] in "[]<>"
    for r in inlines.marked(found).where("p.kind = 'text'").select("doc", "p.loc", "p.len", "p.text").collect():
        shown = cut(r.doc, r["loc"], r["len"])
        assert inlines.unescaped(shown) == r.text or "&amp;" in shown or "\\" in shown, (shown, r.text)
    for r in found.where("kind <> 'empty'").collect():
        piece = cut(r.doc, r["loc"], r["len"])
        assert piece and piece.count("\n") == r.n_lines - 1
        assert all(cut(r.doc, x["at"], len(x["text"].encode("utf-16-le")) // 2) == x["text"] for x in r.lines)
    found.unpersist()


def test_header_cells_are_bold_in_spans_and_segments(spark):
    found = structure(docs(spark, "| *a* | b |\n|-|-|\n| **c _d_** | e |"))
    spans = sorted(map(tuple, inlines.spans(found).select("loc", "len", "traits").collect()))
    assert spans == [(2, 3, 3), (3, 1, 3), (8, 1, 1), (20, 9, 1), (24, 3, 3)]
    pieces = sorted(map(tuple, ranges.segments(inlines.spans(found)).select("loc", "len", "traits").collect()))
    assert pieces == [(2, 1, 3), (3, 1, 3), (4, 1, 3), (8, 1, 1), (20, 4, 1), (24, 3, 3), (27, 2, 1)]


def runs(data):
    tree = ElementTree.fromstring(data)
    marks = lambda r: {x.tag.replace(W, "") + (f":{x.get(f'{W}val')}" if x.get(f"{W}val") else "") for x in r.findall(f"{W}rPr/*")}
    return [("".join(t.text or "" for t in r.iter(f"{W}t")) or ("\n" if r.find(f"{W}br") is not None else ""), marks(r)) for r in tree.iter(f"{W}r")]


def test_word_runs_have_all_marks_they_stand_in(spark):
    source = "_a **b**_ ~~*c*~~ **`d`** \\*e\\*  \nf [g *h*](u)[i](u) [j](v) [k]() ![l](m.png)\n\n| n | o |\n|-|-|\n| p | *q* |"
    data = word.to_word(docs(spark, source)).first().data
    got = {t: m for t, m in runs(data)}
    assert got["a "] == {"i"} and got["b"] == {"b", "i"} and got["c"] == {"i", "strike"} and got["d"] == {"b", "rStyle:InlineCode"}
    assert any(t.startswith(" *e*") for t in got) and "\n" in got
    assert got["g "] == {"rStyle:Hyperlink"} and got["h"] == {"rStyle:Hyperlink", "i"} and got["n"] == {"b"} and got["p"] == set() and got["q"] == {"i"} and got["[l]"] == {"i"}
    links = list(ElementTree.fromstring(data).iter(f"{W}hyperlink"))
    assert ["".join(t.text for t in x.iter(f"{W}t")) for x in links] == ["g hi", "j"]
    assert data.count('TargetMode="External"') == 2 and 'Target="u"' in data and 'Target="v"' in data


def test_word_holds_each_picture_once(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (2000).to_bytes(4, "big") + (100).to_bytes(4, "big")
    bmp = b"BM" + bytes(16) + (70_000).to_bytes(4, "little") + (-480).to_bytes(4, "little", signed=True)
    stored = spark.createDataFrame([("/d/a.png", bytearray(png)), ("/d/b.bmp", bytearray(bmp)), ("/d/c.png", bytearray(b"no header"))], "path string, content binary")
    source = "![one](a.png) ![two](./a.png)\n\n- ![three](../d/a.png \"t\")\n\n![four](b.bmp) ![five](c.png) ![six](http://x/a.png)"
    rows = spark.createDataFrame([("/d/doc.md", source), ("/e/doc.md", source), ("/f", None)], "doc string, source string")
    got = {r.doc: r.data for r in files.word_documents(rows, stored).collect()}
    tree = ElementTree.fromstring(got["/d/doc.md"])
    assert got["/d/doc.md"].count("<pkg:binaryData>") == 2 and got["/d/doc.md"].count("/image\" Target=") == 2
    blips = [x.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed") for x in tree.iter("{http://schemas.openxmlformats.org/drawingml/2006/main}blip")]
    assert blips == ["picture1", "picture1", "picture1", "picture2"]
    assert {"[five]", "[six]"} <= {t for t, _ in runs(got["/d/doc.md"])}
    extents = [(x.get("cx"), x.get("cy")) for x in tree.iter("{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}extent")]
    assert extents == [("5943600", "297180")] * 3 + [("5943600", "40756")]
    # only one source leads out of the other folder to a file
    assert got["/e/doc.md"].count("<pkg:binaryData>") == 1 and ElementTree.fromstring(got["/f"]) is not None


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], "doc long, source string, block int, text string, pieces int, p int")
    for to in ("html", "text"):
        assert rendering.rendered(empty, to).collect() == []
    assert word.to_word(empty).collect() == [] and structure(empty).collect() == []
    rows = spark.createDataFrame([(None, "# a", 1, "x", 2, 3), (1, None, 1, "x", 2, 3), (2, "b", 1, "x", 2, 3)], empty.schema)
    assert {r.doc: r.data for r in rendering.rendered(rows, "html").collect()}[2] == "<p>b</p>\n"
    assert rendering.titles(rows).where("doc = 1").first().title == "Untitled"
    long = "*a* " * 60_000
    assert rendering.rendered(docs(spark, long), "html").first().data == "<p>" + ("<em>a</em> " * 60_000).rstrip() + "</p>\n"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab *_~`[]()!<>&;\\\n\"'", max_size=60))
def test_pieces_hold_all_of_a_text(text):
    found = inlines.pieces(text)
    places = [(p["loc"], p["loc"] + p["len"]) for p in found]
    assert all(a < b for a, b in places) and places == sorted(places)
    depth = []
    for p in found:
        if p["kind"] == "open":
            depth.append(p["tag"])
        elif p["kind"] == "close":
            assert depth.pop() == p["tag"]
    assert not depth


@pytest.mark.parametrize("text", ["*a " * 30_000, "[" * 60_000, "a*" * 30_000, "[a](" * 20_000, "<!--" * 20_000, "*a_ " * 20_000, "`" * 3 + "a`" * 30_000, "![a" * 20_000, "*a **b " * 15_000 + "c** d* " * 15_000])
def test_time_grows_with_the_text(text):
    import time

    began = time.perf_counter()
    inlines.pieces(text)
    assert time.perf_counter() - began < 8


def test_lines_in_any_number_keep_little(spark):
    state = Containers()
    kept = 0
    for k in range(5000):
        state.line(k, k * 8, f"> - a{k}")
        kept = max(kept, len(state.rows))
        del state.rows[:-1]
    assert kept <= 3 and len(state.stack) == 2


def test_anchors_take_the_first_free_number():
    names = Anchors()
    assert [names.of(t) for t in ("A", "A-2", "A", "A", "!", "?", "!", "Ä b", "x  y!")] == ["a", "a-2", "a-3", "a-4", "section", "-2", "-3", "ä-b", "x-y"]


def test_offsets_of_awkward_lines(spark):
    index = offsets.line_index(docs(spark, "é**b**\r\n日本\n😀x\n\nabc", ""))
    asked = [(0, 1, 3), (0, 1, 2), (0, 2, 7), (0, 3, 5), (0, 3, 3), (0, 99, 99), (0, 0, 0), (0, 4, 1), (0, 5, 2), (1, 1, 1), (1, 5, 9), (0, None, 1)]
    got = offsets.to_units(spark.createDataFrame(asked, "doc long, line long, column long"), index).collect()
    assert {(r.doc, r.line, r.column): r.unit for r in got} == {(0, 1, 3): 1, (0, 1, 2): 0, (0, 2, 7): 10, (0, 3, 5): 13, (0, 3, 3): 11, (0, 99, 99): 19, (0, 0, 0): 0, (0, 4, 1): 15, (0, 5, 2): 17, (1, 1, 1): 0, (1, 5, 9): 0, (0, None, 1): None}
    points = spark.createDataFrame([(0, 0), (0, 1), (0, 6), (0, 7), (0, 9), (0, 11), (0, 12), (0, 13), (0, 15), (0, 19), (0, 50), (1, 0)], "doc long, at long")
    back = {(r.doc, r.at): (r.line, r.column, r.line_loc, r.line_len) for r in offsets.to_positions(points, index).collect()}
    assert back == {
        (0, 0): (1, 1, 0, 7), (0, 1): (1, 3, 0, 7), (0, 6): (1, 8, 0, 7), (0, 7): (1, 8, 0, 7), (0, 9): (2, 4, 8, 2), (0, 11): (3, 1, 11, 3), (0, 12): (3, 1, 11, 3), (0, 13): (3, 5, 11, 3),
        (0, 15): (4, 1, 15, 0), (0, 19): (5, 4, 16, 3), (0, 50): (5, 4, 16, 3), (1, 0): (1, 1, 0, 0),
    }
    starts = spark.createDataFrame([(0, 5, "a"), (0, 9, "b"), (2, 0, "c")], "doc long, loc long, name string")
    asof = offsets.last_start(spark.createDataFrame([(0, 4), (0, 5), (0, 30), (1, 3), (0, None)], "doc long, at long"), starts, ["loc", "name"])
    assert sorted(map(tuple, asof.where("at IS NOT NULL").collect())) == [(0, 4, None, None), (0, 5, 5, "a"), (0, 30, 9, "b"), (1, 3, None, None)]


def test_segments_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(d, rng.randrange(40), rng.randrange(0, 15), rng.randrange(32)) for d in range(3) for _ in range(40)] + [(0, None, 3, 1), (1, 5, 6, None)]
    got = sorted(map(tuple, ranges.segments(spark.createDataFrame(rows, "doc long, loc long, len long, traits int")).collect()))
    want = []
    for d in range(3):
        mine = [r for r in rows if r[0] == d and r[1] is not None and r[3] is not None and r[2] > 0]
        cuts = sorted({r[1] for r in mine} | {r[1] + r[2] for r in mine})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            bits = 0
            for r in mine:
                bits |= r[3] if r[1] <= a and b <= r[1] + r[2] else 0
            want += [(d, a, b - a, bits)] if bits else []
    assert got == sorted(want)
