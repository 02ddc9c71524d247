"""Golden cases of the Markdown relations."""

import pytest

from folioflow.operators import code, markdown, rendering
from folioflow.sources import files

SOURCE = """# Title *one* #

Plain **bold** and `a*b*c` <x>
second line
- item
- [x] done
2. two
> quoted
> more

```Python
x = "<1>"
# not a heading
```
| a | b\\|c |
|---|:-:|
| 1 | ~~2~~ |
***
# Title one
![pic](a.png) [link](http://x.y)
"""


def docs(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources)), "doc long, source string")


def test_blocks(spark):
    got = markdown.blocks(docs(spark, SOURCE)).orderBy("block").collect()
    assert [(r.kind, r.n_lines) for r in got] == [("heading", 1), ("paragraph", 2), ("item", 1), ("item", 1), ("item", 1), ("quote", 2), ("code", 4), ("table", 3), ("rule", 1), ("heading", 1), ("paragraph", 1)]
    for r in got:
        piece = SOURCE[r["loc"] : r["loc"] + r["len"]]
        assert not piece.startswith("\n") and not piece.endswith("\n") and piece.count("\n") == r.n_lines - 1
    assert [r.language for r in got if r.kind == "code"] == ["python"] and [r.checked for r in got if r.kind == "item"] == [None, True, None]


def test_html(spark):
    html = rendering.rendered(docs(spark, SOURCE, "", "a\r\nb"), "html").orderBy("doc").collect()
    assert html[0].data == (
        '<h1 id="title-one">Title <em>one</em></h1>\n<p>Plain <strong>bold</strong> and <code>a*b*c</code> <x>\nsecond line</p>\n<ul class="task-list">\n<li>item</li>\n'
        '<li class="task-item"><input type="checkbox" disabled checked> done</li>\n</ul>\n<ol start="2">\n<li>two</li>\n</ol>\n<blockquote>\n<p>quoted\nmore</p>\n</blockquote>\n'
        '<pre><code class="language-python">x = <span class="tok-string">&quot;&lt;1&gt;&quot;</span>\n<span class="tok-comment"># not a heading</span></code></pre>\n'
        '<table>\n<thead>\n<tr>\n<th>a</th>\n<th style="text-align:center">b|c</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td style="text-align:center"><del>2</del></td>\n</tr>\n</tbody>\n</table>\n<hr>\n'
        '<h1 id="title-one-2">Title one</h1>\n<p><img src="a.png" alt="pic"> <a href="http://x.y">link</a></p>\n'
    )
    assert [r.data for r in html[1:]] == ["", "<p>a\nb</p>\n"]


def test_text(spark):
    got = rendering.rendered(docs(spark, SOURCE), "text").first().data
    assert got.startswith("Title one\n=========\n\nPlain bold and a*b*c \nsecond line\n\n•  item\n\n[x] done\n\n\n2. two\n\n\n> quoted\n> more\n\n    x = \"<1>\"\n")
    assert got.endswith("a  b|c\n─  ───\n1  2\n\n" + "─" * 40 + "\n\nTitle one\n=========\n\n[image: pic — a.png] link (http://x.y)\n")
    with pytest.raises(ValueError):
        rendering.rendered(docs(spark, SOURCE), "word")


def test_offsets_count_utf16_units(spark):
    source = "é😀 x\n# head 日本\n- 😀"
    found = {r.kind: r for r in markdown.blocks(docs(spark, source)).collect()}
    units = source.encode("utf-16-le")
    assert units[2 * found["heading"]["loc"] :][: 2 * found["heading"]["len"]].decode("utf-16-le") == "# head 日本"
    assert [(r["loc"], r["len"], r.presentation) for r in markdown.markers(docs(spark, source)).orderBy("loc").collect()] == [(6, 2, "hidden"), (16, 2, "bullet")]


def test_anchors_take_the_first_free_number(spark):
    heads = markdown.outline(markdown.blocks(docs(spark, "# A\n# A-2\n# A\n# A\n# !\n# ?\n# !")))
    assert [r.anchor for r in heads.orderBy("ord").collect()] == ["a", "a-2", "a-3", "a-4", "section", "-2", "-3"]


def test_tokens(spark):
    text = 'def f(x):  # note "no"\n    return "a\\"b" + Name(0x1F)'
    got = code.code_tokens(spark.createDataFrame([(1, text)], "doc long, text string"), "python").orderBy("ord").collect()
    assert [(r.token, r.lexeme) for r in got] == [("keyword", "def"), ("comment", '# note "no"'), ("keyword", "return"), ("string", '"a\\"b"'), ("number", "0x1F")]
    assert all(text[r["loc"] : r["loc"] + r["len"]] == r.lexeme for r in got)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Hi\n")
    (tmp_path / "b.txt").write_bytes(b"Hi \xe9")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.xyz").write_bytes(b"?")
    strict = {r.path[-4:]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert [strict[k].error_code for k in ("a.md", "b.txt"[1:], ".pdf", ".xyz") if k in strict] == [None, "unreadableFile", "unsupportedConversion", "unsupportedInput"]
    loose = files.read_documents(spark, str(tmp_path), "latin1")
    assert {r.source for r in loose.collect()} == {"# Hi\n", "Hi é", None}
    made = {r.suggested_name: (r.data, r.error_code) for r in files.convert_files(loose, "html").collect()}
    assert made == {"a.html": ('<h1 id="hi">Hi</h1>\n', None), "b.html": ("<p>Hi é</p>\n", None), "c.html": (None, "unsupportedConversion"), "d.html": (None, "unsupportedInput")}


def test_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (400).to_bytes(4, "big") + (200).to_bytes(4, "big")
    images = spark.createDataFrame([("/d/a.md", "x.png"), ("/d/a.md", "../x.png"), ("/d/a.md", "http://h/x.png"), ("/d/a.md", "none.png")], "doc string, src string")
    stored = spark.createDataFrame([("/d/x.png", bytearray(png))], "path string, content binary")
    got = {r.src: r.href for r in files.inlined_images(images, stored).collect()}
    assert got.pop("x.png").startswith("data:image/png;base64,iVBOR") and all(k == v for k, v in got.items())
    assert stored.select(files.image_size(stored.content).alias("s")).first().s == (400, 200)


def test_word_packages_are_sound_xml(spark):
    from xml.etree import ElementTree

    from folioflow.operators import word

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    got = word.to_word(docs(spark, SOURCE, "", "a & <b> **c `d` *e*\x07 | ~~f~~", "|a|b|\n|-|-|\n|1|\n- [ ] x\n-\n")).orderBy("doc").collect()
    trees = [ElementTree.fromstring(r.data) for r in got]
    texts = ["".join(t.text or "" for t in tree.iter(f"{w}t")) for tree in trees]
    assert texts[0].startswith("Title one #"[:9]) and "x = \"<1>\"" in texts[0] and "[pic] link" in texts[0]
    assert [p.get(f"{w}val") for p in trees[0].iter(f"{w}pStyle")][:6] == ["Heading1", "Normal", "ListParagraph", "ListParagraph", "ListParagraph", "Quote"]
    bold = [("".join(t.text for t in r.iter(f"{w}t"))) for r in trees[0].iter(f"{w}r") if r.find(f"{w}rPr/{w}b") is not None]
    assert bold == ["bold", "a", "b|c"]
    assert texts[1] == "" and "d" in texts[2] and "\x07" not in texts[2]
    assert len(list(trees[3].iter(f"{w}tc"))) == 4 and "☐ x" in texts[3]


def html(spark, source, **options):
    return rendering.rendered(docs(spark, source), "html", **options).first().data


def text(spark, source):
    return rendering.rendered(docs(spark, source), "text").first().data


def test_nested_lists(spark):
    source = "- a\n  more\n  1. b\n  2. c\n     - d\n- e\n* f\n\nend"
    assert html(spark, source) == (
        "<ul>\n<li><p>a\nmore</p>\n<ol>\n<li>b</li>\n<li><p>c</p>\n<ul>\n<li>d</li>\n</ul>\n</li>\n</ol>\n</li>\n<li>e</li>\n</ul>\n<ul>\n<li>f</li>\n</ul>\n<p>end</p>\n"
    )
    assert text(spark, source) == "•  a\n   more\n\n   1. b\n\n   2. c\n\n      •  d\n\n•  e\n\n\n•  f\n\n\nend\n"


def test_lists_are_well_formed(spark):
    """Whatever the indents and marks, what is opened is closed."""
    import random
    from xml.etree import ElementTree

    rng = random.Random(2)
    sources = ["\n".join(" " * rng.choice((0, 0, 2, 3, 4, 6, 20)) + rng.choice(("- ", "* ", "1. ", "7) ", "> ", ">> ", "- [x] ", "", "# ")) + rng.choice(("x", "", "y z")) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    for r in rendering.rendered(docs(spark, *sources), "html").collect():
        closed = r.data.replace(" disabled checked>", "/>").replace(" disabled>", "/>").replace("<hr>", "")
        ElementTree.fromstring(f"<a>{closed}</a>")


def test_inline_marks(spark):
    assert html(spark, r"\*a\* _b_ __c__ snake_case_d `e*f* \_` ~~g~~ **h `i` j**  " + "\nk\\\nl") == "<p>*a* <em>b</em> <strong>c</strong> snake_case_d <code>e*f* \\_</code> <del>g</del> <strong>h <code>i</code> j</strong><br>\nk<br>\nl</p>\n"
    assert html(spark, '[a](b "c") ![d](e "f") <http://g.h> <b class="x">i</b> `<b class="x">` & 1 < 2') == '<p><a href="b" title="c">a</a> <img src="e" alt="d" title="f"> <a href="http://g.h">http://g.h</a> <b class="x">i</b> <code>&lt;b class=&quot;x&quot;&gt;</code> &amp; 1 &lt; 2</p>\n'
    assert text(spark, "[a](b) [b](b) [c]() ![d](e) ![](f) ![g]() <b>h</b> <http://i.j> `k*l*` _m_\\_n") == "a (b) b c [image: d — e] [image: f] [image: g] h http://i.j k*l* m_n\n"


def test_raw_html_can_be_kept_out(spark):
    source = "<div onclick='x'>\n*a*\n\nb <script>c</script>"
    assert html(spark, source) == "<div onclick='x'>\n*a*\n<p>b <script>c</script></p>\n"
    assert html(spark, source, raw_html=False) == "<p>&lt;div onclick='x'&gt;\n*a*\n</p>\n<p>b &lt;script&gt;c&lt;/script&gt;</p>\n"


def test_fences_end_with_their_own_mark(spark):
    found = markdown.blocks(docs(spark, "````x\n```\n~~~\n````\na\n~~~\n```\nb\n~~~~ \n```\nopen")).orderBy("block").collect()
    assert [(r.kind, r.text) for r in found] == [("code", "```\n~~~"), ("paragraph", "a"), ("code", "```\nb"), ("code", "open")]
    assert html(spark, "```\n\nx  \n```") == "<pre><code>\nx  </code></pre>\n"


def test_underlined_headings_and_titles(spark):
    assert html(spark, "One\ntwo\n===\nThree\n---\n- a\n---\n") == '<h1 id="one-two">One\ntwo</h1>\n<h2 id="three">Three</h2>\n<ul>\n<li>a</li>\n</ul>\n<hr>\n'
    got = rendering.titles(docs(spark, "x\n\n## The *one* [a](a)\n# Other", "none", "")).orderBy("doc").collect()
    assert [r.title for r in got] == ["The one a", "Untitled", "Untitled"]


def test_drawn_diagrams(spark):
    drawn = spark.createDataFrame([("graph A", "<svg/>")], "source string, svg string")
    source = "```Mermaid\ngraph A\n```\n```mermaid\nother <\n```\n```x\ngraph A\n```"
    assert html(spark, source, diagrams=drawn) == '<figure class="diagram"><svg/></figure>\n<pre><code class="language-mermaid">other &lt;</code></pre>\n<pre><code class="language-x">graph A</code></pre>\n'
