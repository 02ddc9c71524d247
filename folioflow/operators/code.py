"""Tokens of code blocks by regular expressions: comments, strings, numbers, keywords and types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import html_escape, utf16_length
from folioflow.operators import markdown


@dataclass(frozen=True)
class Language:
    keywords: str
    comment: str
    strings: str
    types: bool = True


LINE, BLOCK = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)"
#: The marked words of each language, as they are given, and its comments and quotes.
LANGUAGES = {
    "swift": Language("associatedtype actor async await break case catch class continue default defer deinit do else enum extension fallthrough false final for func guard if import in init inout internal is let lazy mutating nil open operator private protocol public repeat return self some static struct subscript super switch throw throws true try typealias var where while nonisolated any", f"{LINE}|{BLOCK}", '"'),
    "python": Language("and as assert async await break class continue def del elif else except False finally for from global if import in is lambda None nonlocal not or pass raise return True try while with yield self match case", "#[^\n]*", "\"'", False),
    "javascript": Language("async await break case catch class const continue debugger default delete do else export extends false finally for from function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while yield interface type enum implements readonly as declare", f"{LINE}|{BLOCK}", "\"'`"),
    "bash": Language("if then else elif fi for while do done case esac function return export local set echo cd source in", "#[^\n]*", "\"'", False),
    "json": Language("true false null", r"(?!)", '"', False),
    "css": Language("important media import supports keyframes from to and not", BLOCK, "\"'", False),
}
#: Names of languages as people write them; the C family has comments, quotes and numbers of JavaScript.
ALIASES = {x: x for x in LANGUAGES} | {x: k for k, names in {
    "javascript": "js jsx ts typescript tsx json5 c cpp c++ objc objective-c java kotlin go rust php",
    "python": "py", "bash": "sh zsh shell console terminal", "css": "scss less",
}.items() for x in names.split()}


def lexeme_pattern(lang: Language) -> str:
    """What cuts a text into lexemes: comments, strings, numbers, words, and single characters."""
    strings = "|".join(rf"{q}(?:\\(?s:.)|[^{q}\\\n])*(?:{q}|\\\z)?" for q in lang.strings)
    return rf"(?:{lang.comment})|{strings}|\p{{N}}[\p{{N}}a-fA-Fx._]*|[\p{{L}}_][\p{{L}}\p{{N}}_]*|(?s:.)"


def token_of(lexeme: Column, lang: Language) -> Column:
    """comment, string, number, keyword or type; null for other lexemes."""
    first = F.substring(lexeme, 1, 1)
    return (
        F.when(lexeme.rlike(f"^(?:{lang.comment})$"), "comment")
        .when(first.isin(*lang.strings), "string")
        .when(first.rlike(r"^\p{N}$"), "number")
        .when(lexeme.isin(*lang.keywords.split()), "keyword")
        .when(F.lit(lang.types) & first.rlike(r"^\p{Lu}$"), "type")
    )


def highlighted(text: Column, language: Column) -> Column:
    """Code as HTML with a span around each token; code of other languages, diagrams among them, is only escaped."""

    def shown(lang: Language) -> Column:
        span = lambda x: F.concat(F.lit('<span class="tok-'), token_of(x, lang), F.lit('">'), html_escape(x), F.lit("</span>"))
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({lexeme_pattern(lang)})"), F.lit(1)), lambda x: F.coalesce(span(x), html_escape(x))), "")

    out = html_escape(text)
    for name, lang in LANGUAGES.items():
        out = F.when(language.isin(*(alias for alias, of in ALIASES.items() if of == name)), shown(lang)).otherwise(out)
    return out


def code_tokens(code: DataFrame, language: str) -> DataFrame:
    """tokens_by_language of code (doc, text) in one language or alias; an unknown language gives no rows."""
    return tokens_by_language(code.withColumn("language", F.lit(language))).drop("language")


def tokens_by_language(code: DataFrame) -> DataFrame:
    """doc, ord, loc, len, token, lexeme for code (doc, text, language, ...); other columns are kept before them.

    Alternatives in order: comment, string, number, word. A number goes on over hexadecimal digits, x, points and
    underscores. Every character is in one lexeme, so a running sum of lengths gives the places. Blanks and punctuation are
    left out, and so are rows of unknown languages. doc must tell texts apart.
    """
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))[F.lower("language")]
    lexemes, token = F.array().cast("array<string>"), F.lit(None).cast("string")
    for name, lang in LANGUAGES.items():
        lexemes = F.when(F.col("__known") == name, F.regexp_extract_all("text", F.lit(f"({lexeme_pattern(lang)})"), F.lit(1))).otherwise(lexemes)
        token = F.when(F.col("__known") == name, token_of(F.col("lexeme"), lang)).otherwise(token)
    others = [x for x in code.columns if x not in ("doc", "text")]
    rows = code.withColumn("__known", known).where("__known IS NOT NULL").select("doc", *others, "__known", F.posexplode(lexemes).alias("ord", "lexeme"))
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("loc", F.coalesce(F.sum(utf16_length(F.col("lexeme"))).over(before), F.lit(0))).withColumn("token", token).where("token IS NOT NULL")
    return placed.select("doc", *others, "ord", "loc", utf16_length(F.col("lexeme")).alias("len"), "token", "lexeme")


def fenced_tokens(docs: DataFrame) -> DataFrame:
    """doc, block, language, ord, loc, len, token, lexeme of the fenced code in docs (doc, source); loc counts from the document's start."""
    lines = markdown.line_kinds(markdown.source_lines(docs)).where("kind = 'code'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isNull(), F.struct("pos", "raw_text")))), lambda x: x["raw_text"]), "\n")
    # a line that ended in CRLF keeps a blank in place of CR, so that places hold
    gap = F.lead("loc").over(Window.partitionBy("doc", "block").orderBy("pos")) - F.col("loc") - F.col("len") - 1
    rows = lines.withColumn("raw_text", F.concat("text", F.repeat(F.lit(" "), F.coalesce(gap, F.lit(0)).cast("int"))))
    code = rows.groupBy("doc", "block").agg(F.max("language").alias("language"), F.min(F.when(F.col("role").isNull(), F.col("loc"))).alias("start"), body.alias("text"))
    tokens = tokens_by_language(code.select(F.struct("doc", "block").alias("doc"), "language", "start", "text"))
    return tokens.select("doc.doc", "doc.block", "language", "ord", (F.col("start") + F.col("loc")).alias("loc"), "len", "token", "lexeme")
