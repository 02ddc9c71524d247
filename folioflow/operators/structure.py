"""Nested Markdown: which quotes, lists and items every line of a document stands in, and the blocks its lines make.

Documents are dealt out by their key; a document's lines go through an automaton that keeps only the open containers (quotes, and
items with the column their content begins at) and what kind of block is open in the innermost one; beside its source, a document
of any length takes little memory. What a line says depends on the lines before it, never on
later ones, but for a table's head, which its separator tells: one line is held back for that.

Paragraphs go on lazily within quotes and items; fences end with their container or with their own mark; text four columns
in is code. Lines that could define a reference are read before a document's others, so that references are known wherever
they are defined; such lines at a paragraph's start are none of its text. A definition is one line, and one that stands in
code counts too.

Cases: a null source has no lines; empty documents have no blocks; containers that hold nothing have a block of kind
`empty`; the same doc twice is one document of all their lines; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.inlines import PIECE, PIECE_TYPE, beyond, definition, row_cells, said, units_of

NODE = "struct<id:int,kind:string,start:bigint,nth:int,checked:boolean>"
BLOCK = (
    "doc {}, block int, kind string, level int, language string, loc bigint, len bigint, n_lines int, text string, lines array<struct<at:bigint,text:string>>, "
    f"path array<{NODE}>, leads boolean, anchor string, pieces array<array<{PIECE}>>, verbatim string"
)
#: Characters of text, with some for each block and piece, that a task gathers before it hands them on.
BATCH = 1_000_000

TAB = 4
#: Lines that could define a reference, and lines behind which one can.
DEFINING = re.compile(r"[ \t>]*(?:(?:[-*+]|[0-9]{1,9}[.)])[ \t>]+)*\[.+\]:[ \t]*\S")
FREE = re.compile(r"[ \t>]*$|[ \t>]*(?:#|`{3}|~{3}|-{3}|={3}|\*{3})")
CONTAINED = re.compile(r"^[ \t>]*(?:(?:[-*+]|\d{1,9}[.)])[ \t>]+)*")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
MARKER = re.compile(r"([-+*])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)")
BOX = re.compile(r"\[([ xX])\](?=[ \t]+\S)")
#: What a line begins with, beside digits, that may begin a block other than a paragraph. Fixed values of the format.
BEGINS = frozenset(">#`~<=-+*_")
SEPARATOR = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: How raw HTML begins, what ends it (None: a blank line), and whether it may follow a paragraph's line. Fixed values of the format.
HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (
        re.compile(
            r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|"
            r"h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s>]|/>|$)",
            re.I,
        ),
        None,
        True,
    ),
    (re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$"), None, False),
)


def heading_text(rest: str) -> str:
    """A heading's text without the blanks and the closing marks at its end."""
    shown = rest.rstrip(" \t")
    words = shown.rstrip("#")
    return shown if words and words[-1] not in " \t" else words.rstrip(" \t")


class Cursor:
    """What is left of a line, with its column; blanks are taken by columns, and a tab may be taken in part."""

    def __init__(self, line: str):
        self.line, self.at, self.column, self.owed = line, 0, 0, 0

    def indent(self) -> int:
        line, at = self.line, self.at
        if not self.owed and (c := line[at : at + 1]) != "\t":
            if c != " ":
                return 0
            rest = line[at:]
            shown = rest.lstrip(" ")
            if shown[:1] != "\t":
                return len(rest) - len(shown)
        column = self.column + self.owed
        for c in line[at:]:
            if c == " ":
                column += 1
            elif c == "\t":
                column += TAB - column % TAB
            else:
                break
        return column - self.column

    def blank(self) -> bool:
        return not self.line[self.at :].strip(" \t")

    def take(self, columns: int) -> None:
        """Take so many columns of blanks, or all there are."""
        if columns > 0 and not self.owed and self.line.startswith(" " * columns, self.at):
            self.at, self.column = self.at + columns, self.column + columns
            return
        while columns > 0:
            if self.owed:
                self.owed, self.column, columns = self.owed - 1, self.column + 1, columns - 1
                continue
            c = self.line[self.at : self.at + 1]
            if c == "\t":
                self.owed, self.at = TAB - self.column % TAB, self.at + 1
            elif c == " ":
                self.at, self.column, columns = self.at + 1, self.column + 1, columns - 1
            else:
                return

    def skip(self, characters: int) -> None:
        self.at, self.column = self.at + characters, self.column + characters

    def rest(self) -> str:
        return " " * self.owed + self.line[self.at :]


class Containers:
    """The automaton of one document: feed it lines, take rows."""

    def __init__(self) -> None:
        self.stack: list[dict] = []
        self.leaf: dict | None = None
        self.ids = self.blocks = self.numbered = 0
        #: The list that the last item at each level belongs to; other blocks end it.
        self.lists: list[list | None] = [None]
        self.rows: list[dict] = []

    def place(self, at: int) -> int:
        """A place in the current line as UTF-16 units of the document."""
        return self.base + at + (beyond(self.text[:at]) if self.wide else 0)

    def fresh(self) -> int:
        self.ids += 1
        return self.ids

    def path(self) -> list[tuple]:
        out = []
        for c in self.stack:
            if c["kind"] == "item":
                ident, ordered, _, start, _, nth = c["list"]
                out.append((ident, "ol" if ordered else "ul", start, nth, None))
            out.append((c["id"], c["kind"], None, c.get("nth"), c.get("checked")))
        return out

    def begin(self, kind: str, **more) -> None:
        """A new block in the innermost container."""
        self.blocks += 1
        self.lists[-1] = None
        leads = False
        if kind not in ("html", "empty"):
            items = [c for c in self.stack if c["kind"] == "item"]
            leads = bool(items) and items[-1]["waits"]
            for c in items:
                c["waits"] = False
        for c in self.stack:
            c["filled"] = True
        self.leaf = {"kind": kind, "block": self.blocks, "path": self.path(), "leads": leads, **more}

    def emit(self, role: str | None, text: str, start: int, at: int, level: int | None = None) -> None:
        """A row of the open block for the current line: its range from start on, and the place its text begins at."""
        leaf, loc = self.leaf, self.place(start)
        self.rows.append({
            "pos": self.pos, "block": leaf["block"], "kind": leaf["kind"], "role": role, "level": level or leaf.get("level"), "language": leaf.get("language"),
            "loc": loc, "len": self.place(len(self.text)) - loc, "text": text, "at": self.place(at), "path": leaf["path"], "leads": leaf["leads"],
        })

    def close(self, depth: int) -> None:
        """Close all containers beyond a depth; one that holds nothing gets an empty block."""
        while len(self.stack) > depth:
            top = self.stack[-1]
            if not top["filled"]:
                self.begin("empty")
                self.rows.append({"pos": top["pos"], "block": self.blocks, "kind": "empty", "loc": top["loc"], "len": 0, "text": "", "at": top["loc"], "path": self.leaf["path"], "leads": top.get("waits", False)})
            self.stack.pop()
            self.lists.pop()
            self.leaf = None

    def push(self, kind: str, start: int, **more) -> None:
        for c in self.stack:
            c["filled"] = True
        self.leaf = None
        self.stack.append({"id": self.fresh(), "kind": kind, "pos": self.pos, "loc": self.place(start), "filled": False, **more})
        self.lists.append(None)

    def line(self, pos: int, base: int, text: str) -> None:
        self.pos, self.base, self.text, self.wide = pos, base, text, beyond(text) > 0
        cur, matched = Cursor(text), 0
        for c in self.stack:
            if c["kind"] == "quote":
                if not cur.owed and text.startswith("> ", cur.at):
                    cur.skip(2)
                    matched += 1
                    continue
                if cur.indent() > 3 or cur.line[cur.at :].lstrip(" \t")[:1] != ">":
                    break
                self.take_quote(cur)
            elif cur.blank():
                if not c["filled"]:
                    break
            elif cur.indent() >= c["width"]:
                cur.take(c["width"])
            else:
                break
            matched += 1
        leaf = self.leaf
        if leaf and matched == len(self.stack) and "fence" in leaf:
            self.fenced(cur, leaf)
        elif leaf and matched == len(self.stack) and leaf["kind"] == "html":
            self.raw(cur, leaf)
        else:
            self.opened(cur, matched)

    def take_quote(self, cur: Cursor) -> None:
        cur.take(cur.indent())
        cur.skip(1)
        cur.take(1)

    def fenced(self, cur: Cursor, leaf: dict) -> None:
        mark, size, inset = leaf["fence"]
        shown = cur.rest().strip(" \t")
        if cur.indent() <= 3 and len(shown) >= size and shown == mark * len(shown):
            at = len(cur.line) - len(cur.line[cur.at :].lstrip(" \t"))
            self.emit("close", "", at, at)
            self.leaf = None
            return
        cur.take(min(inset, cur.indent()))
        self.emit(None, cur.rest(), cur.at, cur.at)

    def raw(self, cur: Cursor, leaf: dict) -> None:
        if leaf["ends"] is None and cur.blank():
            self.leaf = None
            return
        self.emit(None, cur.rest(), cur.at, cur.at)
        if leaf["ends"] is not None and leaf["ends"].search(cur.rest()):
            self.leaf = None

    def opened(self, cur: Cursor, depth: int) -> None:
        """What a line says behind the containers that go on: new containers, then a block."""
        kept = depth == len(self.stack)
        paragraph = self.leaf is not None and self.leaf["kind"] == "paragraph"
        while rest := cur.line[cur.at :].lstrip(" \t"):
            inset = cur.indent()
            if inset >= TAB:
                if paragraph:
                    break
                return self.indented(cur, depth)
            start = len(cur.line) - len(rest)
            if rest[0] not in BEGINS and not rest[0].isdecimal() and (self.leaf is None or self.leaf["kind"] != "table"):
                break
            if rest[0] == ">":
                self.close(depth)
                self.lists[-1] = None
                self.push("quote", start)
                self.take_quote(cur)
            elif (m := MARKER.match(rest)) and not RULE.match(rest) and not (paragraph and kept and (not rest[m.end() :].strip(" \t") or m[2] not in (None, "1"))):
                self.item(cur, depth, m, start, inset)
            else:
                if self.begun(cur, depth, rest, start, inset, paragraph, kept):
                    return None
                break
            depth, kept, paragraph = depth + 1, True, False
        return self.said(cur, depth, kept, paragraph) if rest else self.empty_line(cur, depth, kept)

    def begun(self, cur: Cursor, depth: int, rest: str, start: int, inset: int, paragraph: bool, kept: bool) -> bool:
        """Whether a line begins a block other than a paragraph, or goes on with a table; then it is taken."""
        if m := HEADING.match(rest):
            self.close(depth)
            self.begin("heading", level=len(m[1]))
            self.emit(None, heading_text(rest[m.end() :]), start, start + m.end())
            self.leaf = None
        elif m := FENCE.match(rest):
            self.close(depth)
            mark, info = m[1] or m[3], (m[2] or m[4] or "").split()
            self.begin("code", fence=(mark[0], len(mark), inset), language=info[0].lower() if info else "")
            self.emit("open", "", start, start)
        elif rest[0] == "<" and (html := next((h for h in HTML if h[0].match(rest) and (h[2] or not paragraph)), None)):
            self.close(depth)
            self.begin("html", ends=html[1])
            self.emit(None, cur.rest(), start, cur.at)
            if html[1] is not None and html[1].search(rest):
                self.leaf = None
        elif (m := UNDERLINE.match(rest)) and paragraph and kept:
            self.emit("underline", "", start, start, level=1 if m[1][0] == "=" else 2)
            self.leaf = None
        elif RULE.match(rest):
            self.close(depth)
            self.begin("rule")
            self.emit(None, "", start, start)
            self.leaf = None
        elif self.leaf is not None and self.leaf["kind"] == "table" and kept:
            self.emit(None, rest.rstrip(" \t"), start, start)
        else:
            return False
        return True

    def item(self, cur: Cursor, depth: int, m: re.Match, start: int, inset: int) -> None:
        kind, going = [m[2] is not None, m[1] or m[3]], self.lists[depth]
        self.close(depth)
        if going is None or going[1:3] != kind:
            going = [self.fresh(), *kind, int(m[2]) if m[2] else None, 0, self.numbered if m[2] else None]
            self.numbered += m[2] is not None
        self.lists[depth] = going
        cur.take(inset)
        cur.skip(m.end())
        step = 1 if cur.blank() or cur.indent() > TAB else cur.indent()
        cur.take(step)
        checked = None
        if (box := BOX.match(cur.line, cur.at)) and not cur.owed:
            checked = box[1] != " "
            cur.skip(3)
            cur.take(cur.indent())
        self.push("item", start, width=inset + m.end() + step, list=going, nth=going[4], checked=checked, waits=True)
        going[4] += 1

    def empty_line(self, cur: Cursor, depth: int, kept: bool) -> None:
        self.close(depth)
        if kept and self.leaf is not None and self.leaf["kind"] == "code":
            cur.take(min(TAB, cur.indent()))
            self.emit("blank", cur.rest(), cur.at, cur.at)
        else:
            self.leaf = None

    def indented(self, cur: Cursor, depth: int) -> None:
        if self.leaf is None or self.leaf["kind"] != "code" or depth < len(self.stack):
            self.close(depth)
            self.begin("code")
        cur.take(TAB)
        self.emit(None, cur.rest(), cur.at, cur.at)

    def said(self, cur: Cursor, depth: int, kept: bool, paragraph: bool) -> None:
        """A line of text: it goes on with a paragraph, makes its last line a table's head, or begins one."""
        rest = cur.line[cur.at :].lstrip(" \t")
        start = len(cur.line) - len(rest)
        if not paragraph:
            self.close(depth)
            self.begin("paragraph", lines=0)
        elif kept and SEPARATOR.match(rest) and "|" in rest + (head := self.rows[-1])["text"] and len(row_cells(head["text"])) == len(row_cells(rest)):
            alone = self.leaf["lines"] == 1
            self.blocks += not alone
            self.leaf = {**self.leaf, "kind": "table", "block": self.blocks, "leads": self.leaf["leads"] and alone}
            head.update(kind="table", block=self.blocks, leads=self.leaf["leads"], text=head["text"].rstrip(" \t"))
            self.emit("separator", rest.rstrip(" \t"), start, start)
            return
        self.leaf["lines"] += 1
        self.emit(None, rest, start, start)


NODE_TYPE = pa.list_(pa.struct([("id", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("nth", pa.int32()), ("checked", pa.bool_())]))
BLOCK_TYPES = {
    "block": pa.int32(), "kind": pa.string(), "level": pa.int32(), "language": pa.string(), "loc": pa.int64(), "len": pa.int64(), "n_lines": pa.int32(), "text": pa.string(),
    "lines": pa.list_(pa.struct([("at", pa.int64()), ("text", pa.string())])), "path": NODE_TYPE, "leads": pa.bool_(), "anchor": pa.string(), "pieces": pa.list_(pa.list_(PIECE_TYPE)),
    "verbatim": pa.string(),
}


def block_of(rows: list[dict]) -> dict | None:
    """One block of its lines' rows; blank lines at the end of indented code are none of it, nor definitions at a paragraph's start; None if nothing is left."""
    while rows[-1].get("role") == "blank":
        rows.pop()
    whole = rows[:]
    while rows and rows[0]["kind"] == "paragraph" and definition(rows[0]["text"]):
        rows.pop(0)
    if not rows or rows[0].get("role") == "underline":
        # a container that holds nothing else is one still
        return {**whole[0], "kind": "empty", "level": None, "len": 0, "n_lines": len(whole), "text": "", "lines": []} if whole[0]["path"] else None
    first, kind = rows[0], "heading" if rows[-1].get("role") == "underline" else rows[0]["kind"]
    lines = [{"at": r["at"], "text": r["text"]} for r in rows if r.get("role") in (None, "blank", "separator")]
    text = "\n".join(x["text"] for x in lines)
    verbatim = None
    if kind in ("paragraph", "heading"):
        text = text.rstrip(" \t")
    elif kind in ("code", "html"):
        verbatim = text
    elif kind == "table":
        verbatim = lines[1]["text"]
    return {**first, "kind": kind, "level": rows[-1].get("level"), "len": rows[-1]["loc"] + rows[-1]["len"] - first["loc"], "n_lines": len(rows), "text": text, "lines": lines, "verbatim": verbatim}


class Dashes(dict):
    """What stands in an anchor for each character, worked out at its first use."""

    def __missing__(self, code: int) -> int:
        self[code] = out = code if unicodedata.category(chr(code))[0] in "LMN" else ord("-")
        return out


DASHES = Dashes()


def slug_of(title: str) -> str:
    """A heading's anchor: lower case, runs of characters other than letters, marks and numbers become one dash."""
    return "-".join(x for x in title.lower().translate(DASHES).split("-") if x)


class Anchors:
    """Anchors of a document's headings: a slug's later headings take the first free number."""

    def __init__(self) -> None:
        self.used: set[str] = set()
        self.last: dict[str, int] = {}

    def of(self, title: str) -> str:
        slug = slug_of(title)
        n, name = self.last.get(slug, 1), slug or "section"
        while name in self.used:
            n += 1
            name = f"{slug}-{n}"
        self.last[slug] = n
        self.used.add(name)
        return name


def lines_of(sources: list[str]) -> Iterator[tuple[int, str]]:
    """Place (in UTF-16 units) and text of a document's lines; several sources are one document of all their lines, by their numbers."""
    rows = [x.split("\n") for x in sources]
    base = 0
    for raw in rows[0] if len(rows) == 1 else (x for row in zip_longest(*rows) for x in row if x is not None):
        yield base, raw.removesuffix("\r")
        base += len(raw) + 1 + beyond(raw)


def references(sources: list[str]) -> dict[str, tuple[str, str | None]]:
    """The links and titles of a document's labels, by their first definition."""
    refs: dict[str, tuple[str, str | None]] = {}
    if not any("]:" in x for x in sources):
        return refs
    before = None
    for _, text in lines_of(sources):
        # a definition follows no line of text; where one does by its container's rules, the automaton still tells
        if DEFINING.match(text) and (before is None or FREE.match(before) or DEFINING.match(before)) and (told := definition(CONTAINED.sub("", text))):
            refs.setdefault(*told)
        before = text
    return refs


def titles_of(blocks: Iterator[dict]) -> Iterator[dict]:
    """Blocks with pieces up to the first one that has words; later ones name no document."""
    for b in blocks:
        yield b
        if any(said(unit) for unit in b["pieces"]):
            return


def document_blocks(sources: list[str], inline: bool, kinds: tuple[str, ...] | None) -> Iterator[dict]:
    """A document's blocks, of some kinds only where kinds are given, with anchor and pieces if inline."""
    refs, state, anchors, held = references(sources) if inline else {}, Containers(), Anchors(), []

    def closed() -> Iterator[dict]:
        found = block_of(held) if held else None
        held.clear()
        if found is None or kinds and found["kind"] not in kinds:
            return
        if inline:
            found["pieces"] = units_of(found["kind"], found["text"], found["lines"], refs)
            if found["kind"] == "heading":
                found["anchor"] = anchors.of(said(found["pieces"][0]))
        yield found

    def taken(rows: list[dict]) -> Iterator[dict]:
        for r in rows:
            if held and held[0]["block"] != r["block"]:
                yield from closed()
            held.append(r)

    for pos, (base, text) in enumerate(lines_of(sources)):
        state.line(pos, base, text)
        if len(state.rows) > 1:
            # the last row may still become a table's head
            yield from taken(state.rows[:-1])
            del state.rows[:-1]
    state.close(0)
    yield from taken(state.rows)
    yield from closed()


def streamed(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = tuple(BLOCK_TYPES), inline: bool = True, kinds: tuple[str, ...] | None = None, to_title: bool = False, ends: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc, source) that come sorted by doc; with ends, also a row without a block for each row of them."""
    docs, blocks, of, size = [], [], None, 0

    def gathered() -> pa.RecordBatch:
        arrays = [pa.array(docs, of), *(pa.array([b.get(name) for b in blocks], BLOCK_TYPES[name]) for name in columns)]
        docs.clear()
        blocks.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["doc", *columns])

    def documents() -> Iterator[tuple[object, list[str], int]]:
        nonlocal of
        doc, sources, n = None, [], 0
        for batch in batches:
            of = batch.schema.field("doc").type
            texts = batch.column("source")
            for k, d in enumerate(batch.column("doc").to_pylist()):
                if n and d != doc:
                    yield doc, sorted(sources), n
                    sources, n = [], 0
                doc, n = d, n + 1
                if (source := texts[k].as_py()) is not None:
                    sources.append(source)
        if n:
            yield doc, sorted(sources), n

    for doc, sources, n in documents():
        found = document_blocks(sources, inline, kinds) if sources else iter(())
        for b in titles_of(found) if to_title else found:
            docs.append(doc)
            blocks.append(b)
            # a piece weighs more than its text
            size += len(b["text"]) + 50 + 200 * sum(map(len, b.get("pieces", ())))
            if size > BATCH:
                yield gathered()
                size = 0
        if ends:
            docs.extend([doc] * n)
            blocks.extend([{}] * n)
            size += 50 * n
    if docs:
        yield gathered()


def structure(docs: DataFrame, columns: tuple[str, ...] | None = None, inline: bool = True, kinds: tuple[str, ...] | None = None, to_title: bool = False, ends: bool = False) -> DataFrame:
    """The blocks of docs (doc, source), in order: doc, block, kind, level, language, loc, len, n_lines, text, lines, path, leads, anchor, pieces, verbatim.

    kind is heading, paragraph, code, table, rule, html or empty. loc and len are a block's range from its first line's start
    behind its containers, in UTF-16 units of the document; text is its text behind containers and marks, lines the place
    and text of each line of it. path holds the containers from the outermost one, with the number that a numbered list begins with,
    which one of the document's numbered lists it is, and which one of its list an item (nth, from 0); leads says that the block is the first
    text of its innermost item. pieces are its inline marks, see inlines; verbatim is what has none: code, raw HTML, a table's separator.

    Where less is needed: columns beside doc, blocks of some kinds only, no anchor nor pieces (inline=False), and blocks up to
    the first one that has words (to_title); definitions of references are read to a document's end all the same. Where more is needed: a row
    without a block for each row of docs (ends), whatever its source, so that docs need not be made once more to be joined; a null doc has no blocks then.
    """
    names = tuple(BLOCK_TYPES) if columns is None else columns
    fields = {x.split(" ")[0]: x for x in BLOCK.split(", ")}
    rows = docs.select("doc", F.when(F.col("doc").isNotNull(), F.col("source")).alias("source")) if ends else docs.where("source IS NOT NULL").select("doc", "source")
    schema = ", ".join((fields["doc"].format(rows.schema["doc"].dataType.simpleString()), *(fields[x] for x in names)))
    # work goes by lines and marks, not by bytes, so partitions are not put together by their size; dealt by doc itself, documents
    # that were made by doc would stay in the partitions they were made in, which Spark puts together
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.xxhash64("doc")).sortWithinPartitions("doc").mapInArrow(lambda batches: streamed(batches, names, inline, kinds, to_title, ends), schema)
