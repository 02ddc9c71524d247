"""Inline marks of Markdown as a list of pieces with places: what opens, closes, is said, and where.

A block's text is cut into pieces once; HTML, plain text, Word runs, delimiter ranges and traits are all read off the same
pieces. Code spans, automatic links, raw tags, escapes and character references are found from left to right; brackets are
matched with their targets by a stack; runs of stars, underscores and tildes are matched by a stack of openers, within a
link's words first, as many marks at a time as both sides have.

A piece has a kind (text, code, html, soft, break, open, close, image), its text, tag (em, strong, del, code, a), link and
title, traits (bits of the marks it stands in, see TRAITS), and its range in UTF-16 units of the document: of the
delimiter for `open` and `close`, else of what it says. `open` pieces have the length of all they mark, delimiters included,
as span; `close` pieces of links hold the words of the link.

Cases: a null or empty text has no pieces; marks that match nothing are text; texts of any length are read whole, in time
that grows with their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the marks that a text stands in.
TRAITS = {"strong": 1, "em": 2, "del": 4, "code": 8, "a": 16}
PIECE = "struct<kind:string,text:string,tag:string,link:string,title:string,traits:int,loc:bigint,len:bigint,span:bigint>"
#: Columns of blocks that the functions of pieces read.
MARKED = ("block", "kind", "n_lines", "pieces")
PIECE_TYPE = pa.struct([("kind", pa.string()), ("text", pa.string()), ("tag", pa.string()), ("link", pa.string()), ("title", pa.string()), ("traits", pa.int32()), ("loc", pa.int64()), ("len", pa.int64()), ("span", pa.int64())])

TOKEN = re.compile(
    r"""(?P<break>[ ]{2,}\n|\\\n)|(?P<soft>[ ]?\n)|\\(?P<escape>[!-/:-@\[-`{-~])|(?P<ticks>`+)
    |<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<(?P<mail>[\w.!\#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>
    |(?P<html><[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!---?>)
    |(?P<raw><!--|<\?|<!\[CDATA\[|<![A-Za-z])
    |(?P<ref>&(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)
    |(?P<run>\*+|_+|~+)|(?P<open>!?\[)|(?P<shut>\])""",
    re.X | re.S,
)
#: What a token begins with, but for the blanks before a line's end.
SPECIAL = re.compile(r"[\n\\`<&*_~!\[\]]")
#: What ends raw tags that may hold anything. Fixed values of the format.
RAW_ENDS = {"<!--": "-->", "<?": "?>", "<![CDATA[": "]]>"}
#: How deep parentheses may stand in a link's target. Fixed value of the format.
PARENTHESES = 32
PIPE = re.compile(r"(?<!\\)\|")
TITLE = re.compile(r"""[ \t\n]+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\))""", re.S)
#: A reference's label behind a link's words, and a line that defines what a label links to.
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
DEFINITION = re.compile(r"\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*(\S.*)$")
REFERENCE = re.compile(r"\\([!-/:-@\[-`{-~])|&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def referred(name: str) -> str | None:
    """The characters of a reference's name, without & and semicolon; None if there are none of that name."""
    if name[0] != "#":
        return html5.get(f"{name};")
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def unescaped(text: str) -> str:
    return REFERENCE.sub(lambda m: m[1] or referred(m[2]) or m[0], text)


def target(text: str, at: int) -> tuple[str, str | None, int] | None:
    """Link and title in the parentheses that begin at a place, and where they end."""
    n, i = len(text), at + 1
    while i < n and text[i] in " \t\n":
        i += 1
    if text[i : i + 1] == "<":
        j = i + 1
        while j < n and text[j] not in "<>\n":
            j += 2 if text[j] == "\\" else 1
        if text[j : j + 1] != ">":
            return None
        link, i = text[i + 1 : j], j + 1
    else:
        j, deep = i, 0
        while j < n and text[j] > " " and text[j] != "\x7f":
            if text[j] == "\\" and j + 1 < n and not text[j + 1].isspace():
                j += 1
            elif text[j] == "(":
                deep += 1
                if deep > PARENTHESES:
                    return None
            elif text[j] == ")":
                if not deep:
                    break
                deep -= 1
            j += 1
        if deep:
            return None
        link, i = text[i:j], j
    title = None
    if m := TITLE.match(text, i):
        title, i = unescaped(next(g for g in m.groups() if g is not None)), m.end()
    while i < n and text[i] in " \t\n":
        i += 1
    return (unescaped(link), title, i + 1) if text[i : i + 1] == ")" else None


def label_of(text: str) -> str:
    return " ".join(text.split()).casefold()


def definition(line: str) -> tuple[str, tuple[str, str | None]] | None:
    """The label that a line defines, with its link and title."""
    m = DEFINITION.match(line)
    if not m or not m[1].strip():
        return None
    inner = f"({m[2].rstrip()})"
    found = target(inner, 0)
    return (label_of(m[1]), found[:2]) if found and found[2] == len(inner) else None


def linked(text: str, at: int, words: tuple[int, int], refs: dict[str, tuple[str, str | None]]) -> tuple[str, str | None, int] | None:
    """Link, title and end of what follows a link's words: a target in parentheses, a label, or nothing where the words are one."""
    if text[at : at + 1] == "(" and (found := target(text, at)):
        return found
    if not refs:
        return None
    m = LABEL.match(text, at)
    label = m[1] if m and m[1].strip() else text[words[0] : min(words[1], words[0] + 999)]
    to = refs.get(label_of(label))
    return (*to, m.end() if m else at) if to else None


def beyond(text: str) -> int:
    """How many characters of a text take two UTF-16 units."""
    return 0 if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2 - len(text)


@cache
def punctuation(c: str) -> bool:
    return bool(c) and unicodedata.category(c)[0] in "PS"


class Run:
    """A run of one delimiter: what is left of it, and the marks it gave to the left and right."""

    __slots__ = ("mark", "at", "left", "size", "used", "opens", "closes", "opened", "closed", "slot")

    def __init__(self, text: str, at: int, size: int, slot: int):
        mark, before, after = text[at], text[at - 1 : at], text[at + size : at + size + 1]
        tight_after, tight_before = not (not after or after.isspace()), not (not before or before.isspace())
        right_of = tight_after and (not punctuation(after) or not tight_before or punctuation(before))
        left_of = tight_before and (not punctuation(before) or not tight_after or punctuation(after))
        self.mark, self.at, self.left, self.size, self.used, self.slot = mark, at, size, size, 0, slot
        self.opens = right_of and (mark != "_" or not left_of or punctuation(before))
        self.closes = left_of and (mark != "_" or not right_of or punctuation(after))
        if mark == "~" and size > 2:
            self.opens = self.closes = False
        self.opened: list[tuple] = []
        self.closed: list[tuple] = []


def matched(runs: list[Run]) -> None:
    """Match closers with the nearest opener, from left to right; what is between them stays as it is."""
    stack: list[Run] = []
    #: How low the stack has been searched in vain, by what was sought.
    floors: dict[tuple, int] = {}
    for run in runs:
        while run.closes and run.left:
            key = (run.mark, run.opens, run.size % 3 if run.mark != "~" else run.left)
            floor, k = floors.get(key, 0), len(stack) - 1
            while k >= floor:
                o = stack[k]
                odd = (o.closes or run.opens) and (o.size + run.size) % 3 == 0 and (o.size % 3 or run.size % 3)
                if o.mark == run.mark and (o.left == run.left if run.mark == "~" else not odd):
                    break
                k -= 1
            if k < floor:
                floors[key] = len(stack)
                break
            o = stack[k]
            n = run.left if run.mark == "~" else 2 if min(o.left, run.left) > 1 else 1
            tag = "del" if run.mark == "~" else "strong" if n == 2 else "em"
            o.left -= n
            o.opened.append((tag, o.at + o.left, n))
            run.closed.append((tag, run.at + run.used, n))
            run.used, run.left = run.used + n, run.left - n
            del stack[k + (o.left > 0) :]
            for other, low in floors.items():
                floors[other] = min(low, len(stack))
        if run.opens and run.left:
            stack.append(run)


def token(text: str, at: int) -> re.Match | None:
    """The first token from a place on; what can't begin one is skipped."""
    while special := SPECIAL.search(text, at):
        start = special.start()
        if text[start] == "\n":
            while start > at and text[start - 1] == " ":
                start -= 1
        if m := TOKEN.match(text, start):
            return m
        at = special.end()
    return None


def pieces(text: str, places: Sequence[int] | None = None, refs: dict[str, tuple[str, str | None]] | None = None) -> list[dict]:
    """The pieces of a text, in order; places are those of its characters, the text's own if none are given; refs are the labels' links and titles."""
    if text and not SPECIAL.search(text):
        places = unit_places(text, [(0, 0)]) if places is None else places
        stop = places[len(text) - 1] + (1 if text[-1] <= "\uffff" else 2)
        return [{"kind": "text", "text": text, "link": None, "traits": 0, "loc": places[0], "len": stop - places[0], "span": None}]
    out: list = []
    brackets: list[tuple[int, int, bool]] = []  # slot in out, place behind, whether an image's
    dead = -1  # brackets below this one can't be links
    at, end = 0, len(text)
    absent: set = set()  # what no longer comes in the rest of the text

    def say(kind: str, shown: str, start: int, stop: int, **more) -> None:
        if stop > start:
            out.append({"kind": kind, "text": shown, "loc": start, "len": stop - start, **more})

    while at < end:
        m = token(text, at)
        if not m:
            say("text", text[at:], at, end)
            break
        say("text", text[at : m.start()], at, m.start())
        start, at, kind = m.start(), m.end(), m.lastgroup
        if kind in ("break", "soft"):
            say(kind, "\n", start, at)
        elif kind == "escape":
            say("text", m["escape"], start, at)
        elif kind == "ticks":
            size = at - start
            shut = None if size in absent else re.compile(rf"(?<!`)`{{{size}}}(?!`)").search(text, at)
            if not shut:
                absent.add(size)
            if shut:
                inner = text[at : shut.start()].replace("\n", " ")
                shown = inner[1:-1] if inner[0] == inner[-1] == " " and inner.strip(" ") else inner
                out.append({"kind": "open", "tag": "code", "loc": start, "len": size})
                say("code", shown, at, shut.start())
                out.append({"kind": "close", "tag": "code", "loc": shut.start(), "len": size})
                at = shut.end()
            else:
                say("text", m[0], start, at)
        elif kind in ("auto", "mail"):
            link = m[kind] if kind == "auto" else f"mailto:{m[kind]}"
            out.append({"kind": "open", "tag": "a", "link": link, "loc": start, "len": 1})
            say("text", m[kind], start + 1, at - 1)
            out.append({"kind": "close", "tag": "a", "link": link, "text": m[kind], "loc": at - 1, "len": 1})
        elif kind == "html":
            say("html", m[0], start, at)
        elif kind == "raw":
            ends = RAW_ENDS.get(m[0], ">")
            stop = -1 if ends in absent else text.find(ends, at)
            if stop < 0:
                absent.add(ends)
                say("text", m[0], start, at)
            else:
                at = stop + len(ends)
                say("html", text[start:at], start, at)
        elif kind == "ref":
            say("text", referred(m[0][1:-1]) or m[0], start, at)
        elif kind == "run":
            out.append(Run(text, start, at - start, len(out)))
        elif kind == "open":
            brackets.append((len(out), at, m[0] == "!["))
            say("text", m[0], start, at)
        elif brackets and (found := linked(text, at, (brackets[-1][1], start), refs or {})) and (brackets[-1][2] or len(brackets) - 1 > dead):
            slot, behind, image = brackets.pop()
            inner = out[slot + 1 :]
            matched([x for x in inner if isinstance(x, Run)])
            link, title, stop = found
            first = behind - (2 if image else 1)
            if image:
                del out[slot:]
                out.append({"kind": "image", "text": said(inner), "link": link, "title": title, "loc": first, "len": stop - first})
            else:
                out[slot : slot + 1] = [{"kind": "open", "tag": "a", "link": link, "title": title, "loc": first, "len": 1}]
                out[slot + 1 :] = [frozen(x) for x in inner]
                out.append({"kind": "close", "tag": "a", "link": link, "text": said(inner), "loc": start, "len": stop - start})
                dead = max(dead, len(brackets) - 1)
            at = stop
        else:
            if brackets:
                brackets.pop()
                dead = min(dead, len(brackets) - 1)
            say("text", "]", start, at)
    matched([x for x in out if isinstance(x, Run)])
    return placed([p for x in out for p in ((x,) if type(x) is dict and x["kind"] != "group" else flat(x))], text, unit_places(text, [(0, 0)]) if places is None else places)


def frozen(x: dict | Run) -> dict | list:
    """A run within a link's words, which later marks no longer see."""
    return {"kind": "group", "pieces": flat(x)} if isinstance(x, Run) else x


def flat(x: dict | Run) -> list[dict]:
    """What a run gave: its closing marks, what is left of it, its opening marks, the outermost first."""
    if not isinstance(x, Run):
        return x["pieces"] if x["kind"] == "group" else [x]
    closes = [{"kind": "close", "tag": tag, "loc": at, "len": n} for tag, at, n in x.closed]
    left = [{"kind": "text", "text": x.mark * x.left, "loc": x.at + x.used, "len": x.left}] if x.left else []
    return closes + left + [{"kind": "open", "tag": tag, "loc": at, "len": n} for tag, at, n in reversed(x.opened)]


def said(inner: list) -> str:
    """The words of some pieces, without marks and tags."""
    return "".join(p["text"] for x in inner for p in flat(x) if p["kind"] in ("text", "code", "soft", "break", "image"))


def placed(found: list[dict], text: str, places: Sequence[int]) -> list[dict]:
    """Pieces with traits and places; neighbouring texts are one piece, and opening marks know how far they reach."""
    deep, traits = dict.fromkeys(TRAITS, 0), 0
    opened: list[dict] = []
    out: list[dict] = []
    last = None
    for p in found:
        kind, stop = p["kind"], p["loc"] + p["len"]
        if kind == "text" and last and last["kind"] == "text" and last["end"] == p["loc"]:
            last["text"] += p["text"]
            last["end"] = stop
            continue
        around = opened[-1]["link"] if opened else None
        if kind == "close":
            deep[p["tag"]] -= 1
            if not deep[p["tag"]]:
                traits -= TRAITS[p["tag"]]
            opened.pop()["reach"] = stop
        p.setdefault("link", around)
        p["traits"], p["end"] = traits, stop
        out.append(p)
        last = p
        if kind == "open":
            if not deep[p["tag"]]:
                traits += TRAITS[p["tag"]]
            deep[p["tag"]] += 1
            opened.append(p)

    def ends(at: int) -> int:
        """Behind a character, which the prefix of a line may part from the next one."""
        return places[at - 1] + (1 if text[at - 1] <= "\uffff" else 2)

    for p in out:
        start = places[p["loc"]]
        p["len"] = ends(p["end"]) - start
        p["span"] = ends(p["reach"]) - start if "reach" in p else None
        p["loc"] = start
    return out


def unit_places(text: str, starts: list[tuple[int, int]]) -> Sequence[int]:
    """UTF-16 place in the document of each character of a text and its end; starts gives where its lines begin, in it and in the document."""
    wide = beyond(text) > 0
    if len(starts) == 1 and not wide:
        return range(starts[0][1], starts[0][1] + len(text) + 1)
    out: list[int] = []
    for k, (at, loc) in enumerate(starts):
        line = text[at : starts[k + 1][0] if k + 1 < len(starts) else len(text)]
        if not wide:
            out.extend(range(loc, loc + len(line)))
            loc += len(line)
            continue
        for c in line:
            out.append(loc)
            loc += 1 if c <= "\uffff" else 2
    out.append(loc if starts else 0)
    return out


def row_cells(line: str) -> list[tuple[int, str]]:
    """Place and text of a table row's cells, blanks at their edges left out; pipes at the row's edges part nothing."""
    cuts = [-1, *(m.start() for m in PIPE.finditer(line)), len(line)]
    cells = [(a + 1, line[a + 1 : b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if len(cells) > 1 and not cells[0][1].strip(" \t"):
        cells = cells[1:]
    if len(cells) > 1 and not cells[-1][1].strip(" \t"):
        cells = cells[:-1]
    return [(at + len(x) - len(x.lstrip(" \t")), x.strip(" \t")) for at, x in cells]


def units_of(kind: str, text: str, lines: list[dict], refs: dict[str, tuple[str, str | None]]) -> list[list[dict]]:
    """The pieces of a block, as one list, or one for each cell of a table, row by row, as many a row as its head has."""
    if kind in ("heading", "paragraph"):
        starts, at = [], 0
        for x in lines:
            starts.append((at, x["at"]))
            at += len(x["text"]) + 1
        return [pieces(text, unit_places(text, starts), refs)]
    if kind != "table":
        return []
    rows = [(x["at"], row_cells(x["text"])) for k, x in enumerate(lines) if k != 1]
    out, width = [], len(rows[0][1])
    for base, cells in rows:
        for k in range(width):
            at, cell = cells[k] if k < len(cells) else (0, "")
            places = unit_places(cell, [(0, base + at)])
            # an escaped pipe is a pipe even in code
            if "\\|" in cell:
                places = list(places)
            for m in reversed(list(re.finditer(r"\\\|", cell))):
                del places[m.start()]
            out.append(pieces(cell.replace("\\|", "|"), places, refs))
    return out


def marked(found: DataFrame) -> DataFrame:
    """Each inline piece of blocks (doc and MARKED): doc, block, is_header (of a table's head), and the piece as p."""
    head = (F.col("kind") == "table") & (F.col("unit") < F.size("pieces") / (F.col("n_lines") - 1))
    units = found.select("doc", "block", "kind", "n_lines", "pieces", F.posexplode("pieces").alias("unit", "ps"))
    return units.select("doc", "block", head.alias("is_header"), F.explode("ps").alias("p"))


def delimiters(found: DataFrame) -> DataFrame:
    """doc, loc, len, kind of the inline delimiters in blocks: both sides of strong, em, del, code and a."""
    return marked(found).where("p.kind IN ('open', 'close')").select("doc", "p.loc", "p.len", F.col("p.tag").alias("kind"))


def spans(found: DataFrame) -> DataFrame:
    """doc, loc, len, traits, link of the marked stretches in blocks, delimiters included.

    Marks add to those around them, and header cells are strong. Texts without marks in a header cell are stretches too.
    """
    rows = marked(found)
    bits = F.create_map(*(F.lit(x) for pair in TRAITS.items() for x in pair))
    own = F.when(F.col("p.kind") == "open", bits[F.col("p.tag")]).when(F.col("p.kind") == "image", TRAITS["code"]).otherwise(0)
    head = F.when(F.col("is_header"), TRAITS["strong"]).otherwise(0)
    kept = rows.where("p.kind IN ('open', 'image') OR is_header AND p.kind IN ('text', 'code')")
    outer = F.when(F.col("p.kind") == "image", 0).otherwise(F.col("p.traits"))
    return kept.select("doc", "p.loc", F.coalesce("p.span", "p.len").alias("len"), outer.bitwiseOR(own).bitwiseOR(head).alias("traits"), "p.link")


def images(found: DataFrame) -> DataFrame:
    """doc, loc, len, src, alt of the images in blocks."""
    return marked(found).where("p.kind = 'image'").select("doc", "p.loc", "p.len", F.coalesce("p.link", F.lit("")).alias("src"), F.col("p.text").alias("alt"))
