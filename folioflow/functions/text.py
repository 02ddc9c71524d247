"""Text functions as column expressions: units of length, escapes, slugs, counts and the texts shown for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Horizontal white space, as trimmed around lines: space separators and the tab.
BLANKS = r"[\p{Zs}\t]"


def utf16_length(s: Column) -> Column:
    """UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def grapheme_length(s: Column) -> Column:
    """User-perceived characters."""
    return F.length(F.regexp_replace(s, r"\X", "x")).cast("long")


def trim_blanks(s: Column) -> Column:
    return F.regexp_replace(s, f"^{BLANKS}+|{BLANKS}+$", "")


def word_count(s: Column) -> Column:
    """Runs of characters other than Unicode white space."""
    return F.size(F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")).cast("long")


def reading_minutes(words: Column) -> Column:
    """Minutes at 200 words a minute, one at least; none without words."""
    return F.when(words == 0, 0).otherwise(F.greatest(F.lit(1), F.round(words / F.lit(200.0)))).cast("long")


def words_text(words: Column) -> Column:
    return F.when(words == 1, "1 word").otherwise(F.concat(F.format_number(words, 0), F.lit(" words")))


def reading_text(words: Column) -> Column:
    return F.when(words == 0, "No words yet").otherwise(F.concat(words_text(words), F.lit(" · "), reading_minutes(words).cast("string"), F.lit(" min")))


def replace_all(s: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


CONTROLS = r"[\x00-\x08\x0B-\x1F]"


def html_escape(s: Column) -> Column:
    return replace_all(s, HTML)


def attribute_escape(s: Column) -> Column:
    return replace_all(s, (*HTML, ("'", "&#39;")))


def xml_escape(s: Column) -> Column:
    """Escapes for OOXML parts; control characters other than tab and line feed are not allowed there and go."""
    return replace_all(F.when(s.rlike(CONTROLS), F.regexp_replace(s, CONTROLS, "")).otherwise(s), (*HTML, ("'", "&apos;")))


def slug(s: Column) -> Column:
    """Anchor of a heading: lower case, runs of characters other than letters, marks and numbers become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{M}\p{N}]+", "-"), "^-+|-+$", "")


def unique_anchors(slugs: Column) -> Column:
    """Anchors of a document's headings in order: a slug that is taken gets the first free -2, -3, ...

    An empty slug is `section` the first time; its further ones are numbered from an empty stem.
    """

    def next_anchor(seen: Column, s: Column) -> Column:
        name = F.when(s == "", "section").otherwise(s)
        tail = F.transform(F.sequence(F.lit(2), F.size(seen) + 2), lambda k: F.concat(s, F.lit("-"), k.cast("string")))
        return F.when(F.array_contains(seen, name), F.get(F.filter(tail, lambda x: ~F.array_contains(seen, x)), F.lit(0))).otherwise(name)

    return F.aggregate(slugs, F.array().cast("array<string>"), lambda seen, s: F.concat(seen, F.array(next_anchor(seen, s))))


def escape_inline(s: Column) -> Column:
    """Backslashes before the characters that mark emphasis or code."""
    return F.regexp_replace(s, r"([*_`\\])", r"\\$1")


def escape_line(s: Column) -> Column:
    """escape_inline, and a backslash before a first character that would begin a block."""
    return F.regexp_replace(escape_inline(s), r"^([#>|])", r"\\$1")


def normalized_line(s: Column) -> Column:
    """A line as compared between pages: trimmed, numbers as #, white space runs as one blank."""
    return F.regexp_replace(F.regexp_replace(trim_blanks(s), r"(?U)\d+", "#"), r"(?U)\s+", " ")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def suggested_name(path: Column, ext: str | Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(base, F.lit("."), ext if isinstance(ext, Column) else F.lit(ext))


def short_directory(path: Column, home: str) -> Column:
    """The directory of a path, with ~ for the home folder."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    inside = (folder == home) | F.startswith(folder, F.lit(home + "/"))
    return F.when(inside, F.concat(F.lit("~"), F.substring(folder, len(home) + 1, 1 << 20))).otherwise(folder)


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def percent_decoded(s: Column) -> Column:
    """Percent escapes decoded; a plus sign stays one. Null where an escape is broken."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def has_scheme(url: Column) -> Column:
    return url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def toggled_checkbox(box: Column) -> Column:
    return F.when(F.contains(F.lower(box), F.lit("x")), "[ ]").otherwise("[x]")


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^\s*([-*+]|\d{1,9}[.)])\s")


def continued_list(line: Column) -> Column:
    """What Return inserts after a list line: the next marker, the empty text to end the list, or null for other lines."""
    indent, mark, box, rest = (F.regexp_extract(line, r"^(\s*)([-*+]|\d{1,9}[.)])( \[[ xX]\])?(?: (.*))?$", k) for k in (1, 2, 3, 4))
    number = F.regexp_extract(mark, r"^(\d+)", 1)
    following = F.when(number == "", mark).otherwise(F.concat((number.try_cast("long") + 1).cast("string"), F.regexp_extract(mark, r"([.)])$", 1)))
    task = F.when(box != "", " [ ]").otherwise("")
    return F.when(mark == "", F.lit(None)).when(F.trim(rest) == "", "").otherwise(F.concat(F.lit("\n"), indent, following, task, F.lit(" ")))


def indented(text: Column, by: int) -> Column:
    """Each line moved by blanks: two steps in, or out as far as it has them."""
    move = (lambda x: F.concat(F.lit(" " * by), x)) if by > 0 else (lambda x: F.regexp_replace(x, f"^ {{1,{-by}}}", ""))
    return F.array_join(F.transform(F.split(text, "\n"), move), "\n")


def number_text(x: Column) -> Column:
    """Whole numbers without a fraction; others with six significant digits, none of them trailing zeros, as %g has them; ties go away from zero."""
    science = F.format_string("%.5e", x)
    power = F.regexp_extract(science, r"e([+-]\d+)$", 1).cast("int")
    plain = F.lit(None).cast("string")
    for k in range(-4, 6):
        plain = F.when(power == k, F.regexp_replace(F.format_string(f"%.{5 - k}f", x), r"\.0+$|(\.\d*[1-9])0+$", "$1")).otherwise(plain)
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.coalesce(plain, F.regexp_replace(science, r"\.0+e|(\.\d*[1-9])0+e", "$1e")))


def size_text(n_bytes: Column) -> Column:
    """File sizes in decimal units: bytes and kB whole, MB with one digit, larger ones with two; empty for none."""
    out = F.when(n_bytes == 1, "1 byte").otherwise(F.concat(n_bytes.cast("string"), F.lit(" bytes")))
    for unit, size, digits in (("kB", 1e3, 0), ("MB", 1e6, 1), ("GB", 1e9, 2), ("TB", 1e12, 2), ("PB", 1e15, 2)):
        shown = F.regexp_replace(F.format_number(F.floor(n_bytes / F.lit(size / 10**digits) + 0.5) / 10**digits, digits), r"(\.\d*?)0+$", "$1")
        out = F.when(n_bytes >= F.lit(size), F.concat(F.regexp_replace(shown, r"\.$", ""), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n_bytes > 0, out).otherwise("")


def percent_text(fraction: Column) -> Column:
    return F.concat(F.round(fraction * 100).cast("long").cast("string"), F.lit("%"))


def queue_text(index: Column, count: Column) -> Column:
    """The place in a queue of files; null for a single file."""
    return F.when(count > 1, F.concat(F.lit("File "), index.cast("string"), F.lit(" of "), count.cast("string")))


def title_text(name: Column, n_bytes: Column) -> Column:
    """A file's name and size, or its name alone."""
    return F.concat_ws(" · ", name, F.nullif(size_text(n_bytes), F.lit("")))


def hex_channel(colour: Column, k: int) -> Column:
    """Channel k (0 red to 3 alpha) of #RRGGBB or #RRGGBBAA, between 0 and 1; alpha is 1 where it is not given."""
    digits = F.regexp_replace(colour, "^#", "")
    part = F.substring(digits, 2 * k + 1, 2)
    value = F.conv(part, 16, 10).cast("double") / 255
    known = digits.rlike("^[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?$")
    return F.when(~known, F.lit(None).cast("double")).when(part == "", F.lit(1.0)).otherwise(value)


def utf16_slice(s: Column, loc: Column, length: Column) -> Column:
    """The part of a text at a place and length in UTF-16 units, held to the text's ends."""
    at = F.greatest(F.lit(0), loc)
    raw = F.substring(F.encode(s, "UTF-16BE"), (2 * at + 1).cast("int"), (2 * F.greatest(F.lit(0), length)).cast("int"))
    return F.decode(raw, "UTF-16BE")


def wrapped(s: Column, loc: Column, length: Column, marker: str) -> Column:
    """The text with marker around a selection, or without it where the selection already has it, inside or around."""
    n, mark = len(marker), F.lit(marker)
    before, inside, after = utf16_slice(s, F.lit(0), loc), utf16_slice(s, loc, length), utf16_slice(s, loc + length, F.lit(1 << 29))
    around = before.endswith(marker) & after.startswith(marker)
    within = (F.length(inside) >= 2 * n) & inside.startswith(marker) & inside.endswith(marker)
    cut = lambda x, skip, keep: F.substring(x, F.lit(skip + 1), keep)
    return (
        F.when(around, F.concat(cut(before, 0, F.length(before) - n), inside, cut(after, n, F.length(after))))
        .when(within, F.concat(before, cut(inside, n, F.length(inside) - 2 * n), after))
        .otherwise(F.concat(before, mark, inside, mark, after))
    )


def link(label: Column, url: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]("), F.coalesce(url, F.lit("")), F.lit(")"))


def css_variables(tokens: dict[str, str]) -> str:
    """Theme tokens as CSS custom properties, for the head of standalone pages."""
    return ":root{" + "".join(f"--{name}:{value};" for name, value in tokens.items()) + "}"


def standalone(title: Column, body: Column, css: str) -> Column:
    """A page around rendered HTML."""
    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), html_escape(title), F.lit(f"</title><style>{css}</style></head><body>\n"), body, F.lit("</body></html>\n"))


def found(docs: DataFrame, needle: str, text_col: str = "text") -> DataFrame:
    """docs that hold a text, whatever its case, with the place of the first hit (from 1) and how many there are."""
    low, wanted = F.lower(text_col), needle.lower()
    count = (F.length(text_col) - F.length(F.replace(low, F.lit(wanted), F.lit("")))) / len(wanted)
    return docs.where(low.contains(wanted)).withColumn("first_at", F.instr(low, wanted)).withColumn("hits", F.floor(count).cast("long"))
