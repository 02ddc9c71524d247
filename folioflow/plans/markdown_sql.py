"""DuckDB SQL of the Markdown queries over whole documents, in the same steps as the operators: lines, fences, kinds, blocks, output.

Patterns are shared with the operators; both engines read them alike.
"""

from __future__ import annotations

from folioflow.operators import code, markdown
from folioflow.plans import inputs

#: Marks that a backslash escapes, and the characters that stand for them meanwhile.
MARKS = "\\`*_[]()#~|>!<&-.+\""
HIDDEN = "".join(chr(0xE000 + ord(c)) for c in MARKS)
#: What parts the cells of a table meanwhile: no inline mark reaches over it.
CELL = "\n\x1f"
CODE = "`([^`\x1f]*)`"
AUTOLINK = r"(https?://[^\s<>&]+)"
TARGET = r"\(([^)\s\x1f]*)\)"
TITLED = r"\(([^)\s\x1f]*)[ ]+{q}([^)\x1f]*?){q}\)"
WORDS = r"\[([^\]\x1f]*)\]"
#: Patterns of marks around text, and the tag of each.
SPANS = (
    (r"\*\*([^\s*](?:[^\n]*?[^\s*])?)\*\*", "$1", "strong", "$2"),
    (r"(^|[^\p{L}\p{N}_])__([^\s_](?:[^\n]*?[^\s_])?)__", "$2", "strong", "$1"),
    (r"~~([^\s~](?:[^\n]*?[^\s~])?)~~", "$1", "del", "$2"),
    (r"\*([^\s*](?:[^*\n]*[^\s*])?)\*", "$1", "em", "$2"),
    (r"(^|[^\p{L}\p{N}_])_([^\s_](?:[^_\n]*[^\s_])?)_", "$2", "em", "$1"),
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def extract(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def replaced(x: str, pattern: str, to: str) -> str:
    for k in "123":
        to = to.replace(f"${k}", f"\\{k}")
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def utf16(x: str) -> str:
    """Characters, and one more for each beyond the basic plane."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def n_cells(x: str) -> str:
    return f"len(string_split(regexp_replace(trim(replace({x}, '\\|', '')), '^\\||\\|$', '', 'g'), '|'))"


def whole_cases() -> str:
    return inputs.turns_sql("pos", tuple(c.replace("\\n", "' || chr(10) || '") for c in inputs.WHOLE_CASES))


QUOTED, MARKER = "regexp_replace(text, {}, '')", r"^[ \t]*(?:[-*+]|\d{1,9}[.)])"

#: Documents as lines, with kind and block; what inputs.markdown_documents and markdown.line_kinds make.
LINES = rf"""{inputs.LINES}, docs AS (
  SELECT doc, string_agg(out, chr(10) ORDER BY pos) AS source FROM (SELECT doc, pos, {whole_cases()} AS out FROM lines) GROUP BY doc),
raws AS (SELECT doc, unnest(string_split(source, chr(10))) AS raw, generate_subscripts(string_split(source, chr(10)), 1) - 1 AS pos FROM docs),
texts AS (
  SELECT doc, pos, CAST(coalesce(sum({utf16("raw")} + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS loc,
    regexp_replace(raw, '\r$', '') AS text, {utf16("regexp_replace(raw, '\r$', '')")} AS len FROM raws),
cands AS (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM (SELECT doc, pos, {extract("text", markdown.FENCE, 1)} AS mark, {extract("text", markdown.FENCE, 2)} = '' AS bare FROM texts) WHERE mark <> ''),
fold AS (
  SELECT doc, k, pos, mark AS state, 'open' AS role FROM cands WHERE k = 1
  UNION ALL
  SELECT c.doc, c.k, c.pos, CASE WHEN f.state = '' THEN c.mark WHEN c.bare AND starts_with(c.mark, f.state) THEN '' ELSE f.state END,
    CASE WHEN f.state = '' THEN 'open' WHEN c.bare AND starts_with(c.mark, f.state) THEN 'close' END
  FROM fold f JOIN cands c ON c.doc = f.doc AND c.k = f.k + 1),
insides AS (
  SELECT t.*, role, coalesce(sum(CAST(role = 'open' AS INT)) OVER w, 0) > coalesce(sum(CAST(role = 'close' AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside, lead(text) OVER w AS following
  FROM texts t LEFT JOIN fold USING (doc, pos) WINDOW w AS (PARTITION BY t.doc ORDER BY pos)),
firsts AS (
  SELECT *, CASE WHEN inside THEN 'code' WHEN {matches("text", r"^[ \t]*$")} THEN 'blank' WHEN {matches("text", markdown.HEADING)} THEN 'heading' WHEN {matches("text", markdown.RULE)} THEN 'rule'
    WHEN {matches("text", markdown.QUOTE)} THEN 'quote' WHEN {matches("text", markdown.ITEM)} THEN 'item'
    WHEN contains(text, '|') AND NOT {matches("text", markdown.SEPARATOR)} AND coalesce({matches("following", markdown.SEPARATOR)} AND contains(following, '|') AND {n_cells("text")} = {n_cells("following")}, false) THEN 'table'
    WHEN {matches("text", markdown.HTML)} THEN 'html' ELSE 'paragraph' END AS first_kind FROM insides),
lazies AS (
  SELECT *, last_value(CASE WHEN first_kind <> 'paragraph' THEN first_kind END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_kind FROM firsts),
resolveds AS (
  SELECT *, first_kind = 'paragraph' AND coalesce(last_kind IN ('item', 'quote', 'table', 'html'), false) AS lazy FROM lazies),
kinded AS (
  SELECT *, CASE WHEN lazy THEN last_kind ELSE first_kind END AS resolved FROM resolveds),
kinds AS (
  SELECT *, CASE WHEN {matches("text", markdown.UNDERLINE)} AND NOT inside AND coalesce(lag(resolved) OVER (PARTITION BY doc ORDER BY pos) = 'paragraph', false) THEN 'underline' ELSE resolved END AS kind FROM kinded),
contents AS (
  SELECT *, CASE WHEN kind = 'quote' AND NOT lazy THEN length(regexp_replace({extract("text", markdown.QUOTE, 1)}, '[^>]', '', 'g')) ELSE 0 END AS quote_depth,
    CASE WHEN kind = 'item' AND NOT lazy THEN {extract("text", markdown.ITEM, 4)} WHEN kind = 'quote' AND NOT lazy THEN regexp_replace(text, {lit(markdown.QUOTE)}, '')
      WHEN kind = 'heading' THEN {replaced("text", r"^ {0,3}#+[ \t]*|[ \t]+#*[ \t]*$", "")} WHEN lazy AND kind <> 'html' OR kind = 'paragraph' THEN regexp_replace(text, '^[ \t]+', '') ELSE text END AS content FROM kinds),
steps AS (
  SELECT *, kind = 'quote' AND coalesce(lag(kind) OVER w = 'quote', false) AS quote_goes_on, coalesce(CASE WHEN kind = 'underline' THEN true WHEN kind <> lag(kind) OVER w THEN false
      WHEN kind = 'code' THEN coalesce(role, '') <> 'open' AND coalesce(lag(role) OVER w, '') <> 'close'
      WHEN kind = 'quote' THEN lazy OR quote_depth = lag(quote_depth) OVER w AND trim(content) <> '' AND trim(lag(content) OVER w) <> ''
      WHEN kind = 'item' THEN lazy ELSE lag(kind) OVER w IS NOT NULL AND kind IN ('table', 'html', 'paragraph') END, false) AS goes_on
  FROM contents WINDOW w AS (PARTITION BY doc ORDER BY pos)),
parts AS (
  SELECT *, sum(CAST(NOT goes_on AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS block,
    CASE WHEN kind = 'heading' THEN length({extract("text", markdown.HEADING, 1)}) WHEN kind = 'underline' THEN CASE WHEN contains(text, '=') THEN 1 ELSE 2 END END AS level,
    CASE WHEN role = 'open' THEN lower({extract("text", markdown.FENCE, 2)}) END AS language,
    CASE WHEN kind = 'item' AND NOT lazy THEN length({extract("text", markdown.ITEM, 1)}) END AS indent, CASE WHEN kind = 'item' AND NOT lazy THEN {extract("text", markdown.ITEM, 2)} END AS marker,
    CASE WHEN kind = 'item' AND NOT lazy AND {extract("text", markdown.ITEM, 3)} <> '' THEN {extract("text", markdown.ITEM, 3)} <> ' ' END AS checked FROM steps)"""

BLOCKS = rf"""{LINES}, blocks AS (
  SELECT doc, CAST(block AS BIGINT) AS block, CASE WHEN bool_or(kind = 'underline') THEN 'heading' ELSE min(kind) END AS kind, CAST(max(level) AS INTEGER) AS level, max(language) AS language, min(loc) AS loc,
    CAST(max(loc + len) - min(loc) AS BIGINT) AS len, CAST(max(quote_depth) AS INTEGER) AS quote_depth, arg_min(quote_goes_on, pos) AS quote_goes_on, CAST(max(indent) AS INTEGER) AS indent, min(kind) = 'item' AS is_item_start,
    max(marker) AS marker, CAST(max(CAST(checked AS INT)) AS BOOLEAN) AS checked, count(*) AS n_lines, coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (role IS NULL AND kind <> 'underline'), '') AS body
  FROM parts WHERE kind <> 'blank' GROUP BY doc, block),
trimmed AS (SELECT * EXCLUDE (body), CASE WHEN kind = 'code' THEN body ELSE regexp_replace(body, '[ \t]+\z', '') END AS text FROM blocks)"""

MARKERS = rf"""WITH RECURSIVE {LINES}, marked AS (
  SELECT *, CASE WHEN role IS NOT NULL OR kind = 'underline' THEN text WHEN kind = 'heading' THEN {extract("text", r"^( {0,3}#+[ \t]*)", 1)} WHEN kind = 'quote' THEN {extract("text", markdown.QUOTE, 1)}
      ELSE {extract("text", rf"({MARKER}(?:[ \t]|$))".replace("(^", "^("), 1)} END AS lead, length({extract("text", rf"({MARKER}[ \t]+)\[[ xX]\]".replace("(^", "^("), 1)}) AS prefix
  FROM parts WHERE kind IN ('heading', 'underline', 'quote', 'item') AND NOT lazy OR role IS NOT NULL)
SELECT * FROM (
  SELECT doc, loc, CAST(CASE WHEN checked IS NOT NULL THEN prefix ELSE {utf16("lead")} END AS BIGINT) AS len,
    CASE WHEN kind <> 'item' OR checked IS NOT NULL THEN 'hidden' WHEN regexp_matches(marker, '^[0-9]') THEN 'dimmed' ELSE 'bullet' END AS presentation FROM marked
  UNION ALL
  SELECT doc, loc + prefix, 3, 'checkbox' FROM marked WHERE checked IS NOT NULL) WHERE len > 0"""


def each_match(s: str, pattern: str, to: str) -> str:
    """to is SQL over m, a match."""
    return f"CASE WHEN {s} IS NULL THEN NULL ELSE list_reduce(list_prepend({s}, regexp_extract_all({s}, {lit(pattern)})), lambda acc, m: replace(acc, m, {to})) END"


def nested(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


PROTECT = [("\\" + m, h) for m, h in zip(MARKS, HIDDEN, strict=True)]
INSIDE = f"translate({nested('replace(substring(m, 2, length(m) - 2), chr(10), chr(32))', [(h, HIDDEN[0] + h) for h in HIDDEN])}, {lit(MARKS)}, {lit(HIDDEN)})"
ESCAPE = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
TAG = "&lt;(?:/?[A-Za-z][^&<>\x1f]*(?:&quot;[^&<>\x1f]*)*|!--[^<>\x1f]*?--)&gt;"
LINK = WORDS + TARGET


def spans(x: str, tagged: bool) -> str:
    for pattern, inner, tag, lead in SPANS:
        before = lead if lead == "$1" else ""
        x = replaced(x, pattern, f"{before}<{tag}>{inner}</{tag}>" if tagged else f"{before}{inner}")
    return x


def html_steps() -> list[str]:
    quoted, words, target = TITLED.replace("{q}", "&quot;"), WORDS, TARGET
    return [
        nested("s", PROTECT + ESCAPE),
        each_match("s", CODE, f"'\ue03ccode\ue03e' || {INSIDE} || '\ue03c/code\ue03e'"),
        replaced("s", f"&lt;{AUTOLINK}&gt;", '<a href="$1">$1</a>'),
        each_match("s", TAG, f"translate({nested('m', [('&lt;', '<'), ('&gt;', '>'), ('&quot;', chr(34))])}, '*_[]()~!<>\"', '\ue02a\ue05f\ue05b\ue05d\ue028\ue029\ue07e\ue021\ue001\ue002\ue003')"),
        replaced(replaced("s", "!" + words + quoted, '<img src="$2" alt="$1" title="$3">'), "!" + words + target, '<img src="$2" alt="$1">'),
        replaced(replaced("s", words + quoted, '<a href="$2" title="$3">$1</a>'), words + target, '<a href="$2">$1</a>'),
        spans("s", True),
        replaced("s", r"(?: {2,}|\\)\n", "<br>\n"),
        f"translate({nested(nested('s', [('\ue03ccode\ue03e', '<code>'), ('\ue03c/code\ue03e', '</code>')]), [(h, {'<': '&lt;', '>': '&gt;', '"': '&quot;'}.get(m, m)) for m, h in zip(MARKS, HIDDEN, strict=True)])}, '\ue001\ue002\ue003', '<>\"')",
    ]


def text_steps() -> list[str]:
    quoted, words, target = TITLED.replace("{q}", '"'), WORDS, TARGET
    shown = f"CASE WHEN {extract('m', LINK, 2)} = '' OR {extract('m', LINK, 1)} = {extract('m', LINK, 2)} THEN {extract('m', LINK, 1)} ELSE {extract('m', LINK, 1)} || ' \ue028' || {extract('m', LINK, 2)} || '\ue029' END"
    return [
        nested("s", PROTECT),
        each_match("s", CODE, INSIDE),
        replaced(replaced("s", f"<{AUTOLINK}>", "$1"), "</?[A-Za-z][^<>\x1f]*>|<!--[^<>\x1f]*?-->", ""),
        replaced("s", "(!?)" + words + quoted, "$1[$2]($3)"),
        replaced(replaced(replaced("s", r"!\[\]\(\)", ""), r"!\[\]" + target, "\ue05bimage: $1\ue05d"), "!" + words + r"\(\)", "\ue05bimage: $1\ue05d"),
        replaced("s", "!" + words + target, "\ue05bimage: $1 — $2\ue05d"),
        each_match("s", LINK, shown),
        spans("s", False),
        f"translate({replaced('s', r'(?: {2,}|\\)\n', chr(10))}, {lit(HIDDEN)}, {lit(MARKS)})",
    ]


def chain(name: str, source: str, steps: list[str]) -> str:
    """One query for each step; the last is name. source has the text in s."""
    out = [f"{name}_0 AS ({source})"]
    for k, step in enumerate(steps, 1):
        out.append(f"{name}{'' if k == len(steps) else f'_{k}'} AS (SELECT * REPLACE ({step} AS s) FROM {name}_{k - 1})")
    return ",\n".join(out)


SOURCE = f"SELECT *, CASE WHEN kind = 'table' THEN replace({nested('text', PROTECT)}, '|', {lit(CELL)}) WHEN kind NOT IN ('code', 'html', 'rule') THEN text END AS s FROM"
LEVELS = range(1, markdown.LEVELS + 1)
CLOSED = "string_split(regexp_replace(line, '^[ \t]*\x1f|\x1f[ \t]*$', '', 'g'), chr(31))"

LISTS = f"""runs AS (
  SELECT *, sum(CAST(is_item AND coalesce(was <> 'item', true) AS INT)) OVER (PARTITION BY doc ORDER BY block) AS run FROM (SELECT *, kind = 'item' AS is_item, lag(kind) OVER (PARTITION BY doc ORDER BY block) AS was FROM trimmed)),
deep AS (
  SELECT *, CASE WHEN is_item THEN least({markdown.LEVELS}, greatest(1, CAST(floor((indent - first(indent) OVER (PARTITION BY doc, run, is_item ORDER BY block)) / 2) AS INT) + 1)) END AS depth, right(marker, 1) AS mark FROM runs),
listed AS (
  SELECT *, [{", ".join(f"coalesce(last_value(CASE WHEN depth = {k} THEN mark END IGNORE NULLS) OVER w, '-')" for k in LEVELS)}] AS lists FROM deep WINDOW w AS (PARTITION BY doc, run, is_item ORDER BY block)),
lasts AS (
  SELECT *, coalesce(lag(depth) OVER w, 0) AS last_depth, lag(lists) OVER w AS last_lists, coalesce(lead(depth) OVER w, 0) AS next_depth FROM listed WINDOW w AS (PARTITION BY doc, run, is_item ORDER BY block)),
news AS (SELECT *, CASE WHEN is_item THEN depth > last_depth OR last_lists[depth] <> mark END AS new_list FROM lasts),
leads AS (
  SELECT *, lead(new_list) OVER (PARTITION BY doc, run, is_item ORDER BY block) AS next_new, sum(CAST(new_list AS INT)) OVER (PARTITION BY doc, run, is_item, depth ORDER BY block) AS list_id FROM news),
nested AS (
  SELECT *, first(try_cast(regexp_extract(marker, '^([0-9]+)', 1) AS BIGINT)) OVER w AS start, row_number() OVER w - 1 AS nth, bool_or(checked IS NOT NULL) OVER (PARTITION BY doc, run, is_item, depth, list_id) AS any_box
  FROM leads WINDOW w AS (PARTITION BY doc, run, is_item, depth, list_id ORDER BY block))"""

GRID = f"""gridded AS (
  SELECT *, list_transform(list_filter(string_split(replace(s, {lit(CELL)}, chr(31)), chr(10)), lambda x, i: i <> 2), lambda line: list_transform({CLOSED}, lambda c: regexp_replace(c, '^[ \t]+|[ \t]+$', '', 'g'))) AS g FROM inlined WHERE kind = 'table'),
filled AS (SELECT *, list_transform(g, lambda r: list_transform(range(1, len(g[1]) + 1), lambda k: coalesce(r[k], ''))) AS rows FROM gridded)"""


def tag(mark: str) -> str:
    return f"CASE WHEN {mark} IN ('.', ')') THEN 'ol' ELSE 'ul' END"


def token(lang: code.Language, x: str) -> str:
    first = f"left({x}, 1)"
    comment = "false" if lang.comment == "(?!)" else matches(x, f"^(?:{lang.comment})$")
    return (
        f"CASE WHEN {comment} THEN 'comment' WHEN {first} IN ({', '.join(map(lit, lang.strings))}) THEN 'string' WHEN {matches(first, r'^\p{N}$')} THEN 'number' "
        f"WHEN {x} IN ({', '.join(map(lit, lang.keywords.split()))}) THEN 'keyword' " + (f"WHEN {matches(first, r'^\p{Lu}$')} THEN 'type' " if lang.types else "") + "END"
    )


def lexemes(lang: code.Language) -> str:
    """An engine without lookahead reads a pattern that never matches as an error, so it is left out."""
    return f"regexp_extract_all(text, {lit(code.lexeme_pattern(lang).replace('(?:(?!))|', ''))})"


def names(of: str) -> str:
    return ", ".join(lit(alias) for alias, name in code.ALIASES.items() if name == of)


def highlighted() -> str:
    out = nested("text", ESCAPE)
    for name, lang in code.LANGUAGES.items():
        shown = f"coalesce(array_to_string(list_transform({lexemes(lang)}, lambda x: coalesce('<span class=\"tok-' || {token(lang, 'x')} || '\">' || {nested('x', ESCAPE)} || '</span>', {nested('x', ESCAPE)})), ''), '')"
        out = f"CASE WHEN language IN ({names(name)}) THEN {shown} ELSE {out} END"
    return out


def tokens_query(source: str, columns: str, before: str = "WITH") -> str:
    """Tokens of code: source gives doc (and block), language, start and text."""
    by = " ".join(f"WHEN lower(language) IN ({names(n)}) THEN {lexemes(lang)}" for n, lang in code.LANGUAGES.items())
    kinds = " ".join(f"WHEN lower(language) IN ({names(n)}) THEN {token(lang, 'lexeme')}" for n, lang in code.LANGUAGES.items())
    return f"""{before} snippets AS ({source}),
cut AS (SELECT *, CASE {by} END AS l, row_number() OVER () AS snippet FROM snippets),
pieces AS (SELECT * EXCLUDE (l, text), unnest(l) AS lexeme, generate_subscripts(l, 1) - 1 AS ord FROM cut),
places AS (SELECT *, CAST(start + coalesce(sum({utf16("lexeme")}) OVER (PARTITION BY snippet ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS loc, CAST({utf16("lexeme")} AS BIGINT) AS len, CASE {kinds} END AS token FROM pieces)
SELECT {columns} FROM places WHERE token IS NOT NULL"""


SNIPPETS = "SELECT p_partkey AS doc, CAST(0 AS BIGINT) AS start, CASE p_partkey % {n} {languages} END AS language, CASE p_partkey % {n} {texts} END AS text FROM part".format(
    n=len(inputs.SNIPPETS),
    languages=" ".join(f"WHEN {k} THEN {lit(name)}" for k, (name, _) in enumerate(inputs.SNIPPETS)),
    texts=" ".join(f"WHEN {k} THEN replace(replace(replace({lit(x.replace('{{', '{').replace('}}', '}'))}, '{{n}}', p_name), '{{b}}', p_brand), '{{k}}', CAST(p_partkey AS VARCHAR))" for k, (_, x) in enumerate(inputs.SNIPPETS)).replace("{{", "{").replace("}}", "}"),
)


CSS = "CASE WHEN kinds[i] IN ('left', 'center', 'right') THEN ' style=\"text-align:' || kinds[i] || '\"' ELSE '' END"
SEP = "list_transform(string_split(regexp_replace(trim(string_split(text, chr(10))[2]), '^\\||\\|$', '', 'g'), '|'), lambda x: CASE WHEN trim(x) LIKE ':%:' THEN 'center' WHEN trim(x) LIKE ':%' THEN 'left' WHEN trim(x) LIKE '%:' THEN 'right' ELSE 'none' END)"


def row_html(row: str, name: str) -> str:
    return f"'<tr>' || chr(10) || array_to_string(list_transform({row}, lambda c, i: '<{name}' || {CSS} || '>' || c || '</{name}>' || chr(10)), '') || '</tr>' || chr(10)"


HTML = rf"""WITH RECURSIVE {BLOCKS},
{LISTS},
{chain("inlined", f"{SOURCE} nested", html_steps())},
{chain("titled", "SELECT doc, loc, text AS s FROM trimmed WHERE kind = 'heading'", text_steps())},
slugs AS (SELECT doc, loc, trim(regexp_replace(lower(s), '[^\p{{L}}\p{{M}}\p{{N}}]+', '-', 'g'), '-') AS slug FROM titled),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY loc) AS n FROM slugs),
anchors AS (SELECT doc, loc, CASE WHEN n > 1 THEN slug || '-' || n WHEN slug = '' THEN 'section' ELSE slug END AS anchor FROM counted),
{GRID},
aligned AS (SELECT doc, block, rows, {SEP} AS kinds FROM filled),
tables AS (
  SELECT doc, block, '<table>' || chr(10) || '<thead>' || chr(10) || {row_html("rows[1]", "th")} || '</thead>' || chr(10) || CASE WHEN len(rows) > 1 THEN '<tbody>' || chr(10) || array_to_string(list_transform(rows[2:], lambda r: {row_html("r", "td")}), '') || '</tbody>' || chr(10) ELSE '' END || '</table>' || chr(10) AS table_out
  FROM aligned),
quoting AS (
  SELECT *, CASE WHEN quote_goes_on THEN lag(quote_depth) OVER w ELSE 0 END AS q_was, CASE WHEN lead(quote_goes_on) OVER w THEN lead(quote_depth) OVER w ELSE 0 END AS q_next FROM inlined WINDOW w AS (PARTITION BY doc ORDER BY block)),
outs AS (
  SELECT q.doc, q.block, CASE
    WHEN kind = 'heading' THEN '<h' || level || ' id="' || {nested("anchor", [*ESCAPE, ("'", "&#39;")])} || '">' || s || '</h' || level || '>' || chr(10)
    WHEN kind = 'code' THEN '<pre><code' || CASE WHEN coalesce(language, '') = '' THEN '' ELSE ' class="language-' || {nested("language", [*ESCAPE, ("'", "&#39;")])} || '"' END || '>' || {highlighted()} || '</code></pre>' || chr(10)
    WHEN kind = 'rule' THEN '<hr>' || chr(10)
    WHEN kind = 'quote' THEN repeat('<blockquote>' || chr(10), greatest(0, quote_depth - q_was)) || CASE WHEN text = '' THEN '' ELSE '<p>' || s || '</p>' || chr(10) END || repeat('</blockquote>' || chr(10), greatest(0, quote_depth - q_next))
    WHEN kind = 'table' THEN table_out
    WHEN kind = 'html' THEN text || chr(10)
    WHEN kind = 'item' THEN
      CASE WHEN new_list THEN
        CASE WHEN depth > last_depth THEN array_to_string(list_transform(list_slice(lists, last_depth + 1, depth - 1), lambda m: '<' || {tag("m")} || '>' || chr(10) || '<li>'), '') ELSE '</' || {tag("last_lists[depth]")} || '>' || chr(10) END
        || CASE WHEN {tag("mark")} = 'ol' THEN '<ol' || CASE WHEN start <> 1 THEN ' start="' || start || '"' ELSE '' END || '>' || chr(10) WHEN any_box THEN '<ul class="task-list">' || chr(10) ELSE '<ul>' || chr(10) END ELSE '' END
      || CASE WHEN checked IS NULL THEN '<li>' WHEN checked THEN '<li class="task-item"><input type="checkbox" disabled checked> ' ELSE '<li class="task-item"><input type="checkbox" disabled> ' END
      || CASE WHEN next_depth > depth THEN '<p>' || s || '</p>' || chr(10) ELSE s END
      || CASE WHEN next_depth > depth THEN '' ELSE '</li>' || chr(10) || array_to_string(list_transform(list_reverse(list_slice(lists, next_depth + 1, depth)), lambda m, i: '</' || {tag("m")} || '>' || chr(10) || CASE WHEN depth - i > 0 THEN '</li>' || chr(10) ELSE '' END), '') END
    ELSE '<p>' || s || '</p>' || chr(10) END AS out
  FROM quoting q LEFT JOIN anchors a ON q.doc = a.doc AND q.loc = a.loc LEFT JOIN tables t ON q.doc = t.doc AND q.block = t.block)
SELECT doc, coalesce(data, '') AS data FROM (SELECT doc FROM docs) LEFT JOIN (SELECT doc, string_agg(out, '' ORDER BY block) AS data FROM outs GROUP BY doc) USING (doc)"""


def prefixed(text: str, first: str, rest: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x, i: CASE WHEN x = '' THEN '' WHEN i = 1 THEN {first} || x ELSE {rest} || x END), chr(10))"


ITEM_MARK = f"CASE WHEN checked THEN '[x] ' WHEN checked IS NOT NULL THEN '[ ] ' WHEN {tag('mark')} = 'ol' THEN (start + nth) || '. ' ELSE '•  ' END"

TEXT = rf"""WITH RECURSIVE {BLOCKS},
{LISTS},
{chain("inlined", f"{SOURCE} nested", text_steps())},
{GRID},
widths AS (SELECT doc, block, rows, list_transform(range(1, len(rows[1]) + 1), lambda k: list_max(list_transform(rows, lambda r: length_grapheme(r[k])))) AS wide FROM filled),
padded AS (
  SELECT doc, block, wide, list_transform(rows, lambda r: rtrim(array_to_string(list_transform(r, lambda c, k: c || repeat(' ', wide[k] - length_grapheme(c))), '  '), ' ')) AS l FROM widths),
tables AS (
  SELECT doc, block, array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN x || chr(10) || array_to_string(list_transform(wide, lambda n: repeat('─', n)), '  ') ELSE x END), chr(10)) AS table_out FROM padded),
outs AS (
  SELECT i.doc, i.block, CASE
    WHEN kind = 'heading' THEN s || CASE WHEN level <= 2 THEN chr(10) || repeat(CASE level WHEN 1 THEN '=' ELSE '-' END, greatest(3, length_grapheme(s))) ELSE '' END || chr(10) || chr(10)
    WHEN kind = 'code' THEN {prefixed("text", "'    '", "'    '")} || chr(10) || chr(10)
    WHEN kind = 'rule' THEN repeat('─', 40) || chr(10) || chr(10)
    WHEN kind = 'html' OR kind = 'quote' AND text = '' THEN ''
    WHEN kind = 'quote' THEN {prefixed("s", "repeat('> ', quote_depth)", "repeat('> ', quote_depth)")} || chr(10) || chr(10)
    WHEN kind = 'table' THEN table_out || chr(10) || chr(10)
    WHEN kind = 'item' THEN CASE WHEN s = '' THEN repeat('   ', depth - 1) || rtrim({ITEM_MARK}) ELSE {prefixed("s", f"repeat('   ', depth - 1) || {ITEM_MARK}", "repeat('   ', depth)")} END
      || CASE WHEN next_depth = 0 OR coalesce(next_new AND next_depth <= depth, false) THEN chr(10) ELSE '' END || chr(10) || chr(10)
    ELSE s || chr(10) || chr(10) END AS out
  FROM inlined i LEFT JOIN tables t ON i.doc = t.doc AND i.block = t.block),
joined AS (SELECT doc, regexp_replace(string_agg(out, '' ORDER BY block), '^\n+|[\n \t]+\z', '', 'g') AS data FROM outs GROUP BY doc)
SELECT doc, CASE WHEN coalesce(data, '') = '' THEN '' ELSE data || chr(10) END AS data FROM (SELECT doc FROM docs) LEFT JOIN joined USING (doc)"""

BLOCKS_QUERY = f"WITH RECURSIVE {BLOCKS} SELECT * FROM trimmed"

ANCHORS = rf"""WITH RECURSIVE {BLOCKS},
slugs AS (SELECT doc, loc, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+', '-', 'g'), '-') AS slug FROM trimmed WHERE kind = 'heading' AND text <> ''),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY loc) AS n FROM slugs)
SELECT doc, loc, CASE WHEN n > 1 THEN slug || '-' || n WHEN slug = '' THEN 'section' ELSE slug END AS anchor FROM counted"""

TITLES = rf"""WITH RECURSIVE {BLOCKS}, heads AS (SELECT doc, arg_min(text, loc) AS s FROM trimmed WHERE kind = 'heading' AND text <> '' GROUP BY doc),
{chain("titled", "SELECT * FROM heads", text_steps())}
SELECT doc, coalesce(s, 'Untitled') AS title FROM (SELECT doc FROM docs) LEFT JOIN titled USING (doc)"""

TASK_LISTS = f"WITH RECURSIVE {BLOCKS}, {LISTS} SELECT doc, block, depth, new_list, start AS first_number, nth, any_box AS is_task_list FROM nested WHERE is_item"

#: A line that ended in CRLF keeps a blank in place of CR.
FENCED_TOKENS = tokens_query(
    "SELECT doc, CAST(block AS BIGINT) AS block, max(language) AS language, min(loc) FILTER (role IS NULL) AS start, string_agg(text || repeat(' ', CAST(coalesce(gap, 0) AS BIGINT)), chr(10) ORDER BY pos) FILTER (role IS NULL) AS text FROM fenced GROUP BY doc, block",
    "doc, block, language, CAST(ord AS INTEGER) AS ord, loc, len, token, lexeme",
    f"WITH RECURSIVE {LINES}, fenced AS (SELECT *, lead(loc) OVER (PARTITION BY doc, block ORDER BY pos) - loc - len - 1 AS gap FROM parts WHERE kind = 'code'),",
)
