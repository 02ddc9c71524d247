"""Code tokens by language, alias and place in a document."""

from folioflow.operators import code


def test_aliases_and_languages(spark):
    rows = [(1, "let A = 1 // x", "Swift"), (2, "@media /* a\nb */ 'q'", "scss"), (3, "if x # c", "zsh"), (4, "return /* open", "c++"), (5, "let x", "klingon"), (6, "match é1 'a\\\nb'", "py"), (7, "a", None)]
    got = code.tokens_by_language(spark.createDataFrame(rows, "doc long, text string, language string")).orderBy("doc", "ord").collect()
    assert [(r.doc, r.token, r.lexeme) for r in got] == [
        (1, "keyword", "let"), (1, "type", "A"), (1, "number", "1"), (1, "comment", "// x"), (2, "keyword", "media"), (2, "comment", "/* a\nb */"), (2, "string", "'q'"),
        (3, "keyword", "if"), (3, "comment", "# c"), (4, "keyword", "return"), (4, "comment", "/* open"), (6, "keyword", "match"), (6, "string", "'a\\\nb'"),
    ]


def test_fenced_code_has_places_in_the_document(spark):
    source = "😀 text\n```js\nlet a = 1\r\nlet b = 'é'\n```\n~~~ts\nreturn Name\n~~~\n```mermaid\nif 1\n```\n```python\n```\n"
    got = code.fenced_tokens(spark.createDataFrame([(1, source)], "doc long, source string")).orderBy("loc").collect()
    units = source.encode("utf-16-le")
    assert [r.lexeme for r in got] == ["let", "1", "let", "'é'", "return", "Name"]
    assert all(units[2 * r["loc"] : 2 * (r["loc"] + r["len"])].decode("utf-16-le") == r.lexeme for r in got)
