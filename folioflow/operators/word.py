"""Word documents as flat packages: one XML text a document that holds all parts, built by column expressions.

The parts of a package (document, styles, numbering, pictures and their relationships) stand in one XML file, the flat form
of the Office package format, which needs no archive. Runs come from the inline pieces of `structure`, each with all marks it
stands in; links and pictures are relations of the document, each target and file once.

Cases: null and empty sources give packages without a body; raw HTML is left out; links without a target are words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.geometry import column_twips
from folioflow.functions.text import xml_escape
from folioflow.operators.inlines import TRAITS
from folioflow.operators.rendering import copies, each_copy
from folioflow.operators.structure import structure

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Run properties by mark. Fixed values of the format.
PROPERTIES = {"bold": "<w:b/>", "italic": "<w:i/>", "strike": "<w:strike/>", "code": '<w:rStyle w:val="InlineCode"/>', "link": '<w:rStyle w:val="Hyperlink"/>'}
PICTURE = "http://schemas.openxmlformats.org/drawingml/2006/picture"
DRAWN = f'xmlns:r="{OFFICE}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="{PICTURE}"'
#: Half-points of the heading styles.
HEADING_SIZES = (40, 32, 28, 26, 24, 22)
#: Fixed values of the lists: glyph, numeral and indent of each three levels, in twentieths of a point.
GLYPHS, NUMERALS, INDENT, LIST_LEVELS = "•◦▪", ("decimal", "lowerLetter", "lowerRoman"), 360, 9


def run(properties: Column, text: Column) -> Column:
    shown = F.when(properties == "", "").otherwise(F.concat(F.lit("<w:rPr>"), properties, F.lit("</w:rPr>")))
    return F.when(text == "", "").otherwise(F.concat(F.lit("<w:r>"), shown, F.lit('<w:t xml:space="preserve">'), xml_escape(text), F.lit("</w:t></w:r>")))


def link_id(link: Column) -> Column:
    return F.concat(F.lit("link"), F.md5(link))


def drawing(p: Column, picture: Column) -> Column:
    """A picture in the text, by the relation of its file; its place in the document is its number."""
    number, name = (p["loc"] + 1).cast("string"), xml_escape(picture["name"])
    size = F.concat(F.lit('cx="'), picture["cx"].cast("string"), F.lit('" cy="'), picture["cy"].cast("string"), F.lit('"'))
    parts = (
        "<w:r><w:drawing><wp:inline><wp:extent ", size, '/><wp:docPr id="', number, '" name="', name, '" descr="', xml_escape(p["text"]),
        f'"/><a:graphic><a:graphicData uri="{PICTURE}"><pic:pic><pic:nvPicPr><pic:cNvPr id="', number, '" name="', name, '"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="', picture["relation"],
        '"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext ', size, '/></a:xfrm><a:prstGeom prst="rect"/></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>',
    )
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def unit_runs(unit: Column, head: Column) -> Column:
    """Runs of the pieces of one text: each has all marks that it stands in, cells of a head are bold, and neighbouring words with one target are one link."""

    def one(p: Column, i: Column) -> Column:
        has = lambda tag: p["traits"].bitwiseAND(F.lit(TRAITS[tag])) != 0
        linked = has("a") & (F.coalesce(p["link"], F.lit("")) != "")
        marks = [(has("code"), PROPERTIES["code"]), (linked & ~has("code"), PROPERTIES["link"]), (has("strong") | head, PROPERTIES["bold"]), (has("em"), PROPERTIES["italic"]), (has("del"), PROPERTIES["strike"])]
        properties = F.concat(*(F.when(of, xml).otherwise("") for of, xml in marks))
        picture = F.get(F.filter("pictures", lambda x: x["source"] == p["link"]), F.lit(0))
        is_link = (p["tag"] == "a") & (p["link"] != "")
        same = lambda other, kind: F.coalesce((other["kind"] == kind) & (other["tag"] == "a") & (other["link"] == p["link"]), F.lit(False))
        return (
            F.when(p["kind"].isin("text", "code"), run(properties, p["text"]))
            .when(p["kind"] == "soft", run(properties, F.lit(" ")))
            .when(p["kind"] == "break", "<w:r><w:br/></w:r>")
            .when((p["kind"] == "open") & is_link & ~same(F.get(unit, i - 1), "close"), F.concat(F.lit('<w:hyperlink r:id="'), link_id(p["link"]), F.lit('">')))
            .when((p["kind"] == "close") & is_link & ~same(F.get(unit, i + 1), "open"), "</w:hyperlink>")
            .when((p["kind"] == "image") & picture.isNotNull(), drawing(p, picture))
            .when(p["kind"] == "image", run(F.lit(PROPERTIES["italic"]), F.concat(F.lit("["), F.when(p["text"] != "", p["text"]).otherwise(p["link"]), F.lit("]"))))
            .otherwise("")
        )

    return F.array_join(F.transform(unit, one), "")


def paragraph(style: Column | str, content: Column, numbering: Column | None = None) -> Column:
    name = F.lit(style) if isinstance(style, str) else style
    return F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), name, F.lit('"/>'), F.lit("") if numbering is None else numbering, F.lit("</w:pPr>"), content, F.lit("</w:p>"))


def block_word() -> Column:
    """A block's paragraphs. The first text of an item has its list's number or glyph, later ones only its indent."""
    text, runs, path = F.col("verbatim"), F.get("units", F.lit(0)), F.col("path")
    held = F.filter(path, lambda n: n["kind"].isin("item", "ul", "ol"))
    item, of = F.element_at(held, -1), F.get(held, F.size(held) - 2)
    level = F.least(F.size(held) / 2 - 1, F.lit(LIST_LEVELS - 1)).cast("int").cast("string")
    number = F.concat(F.lit('<w:numPr><w:ilvl w:val="'), level, F.lit('"/><w:numId w:val="'), F.when(of["kind"] == "ol", (of["nth"] + 2).cast("string")).otherwise("1"), F.lit('"/></w:numPr>'))
    inset = F.concat(F.lit('<w:ind w:left="'), (INDENT * (F.size(held) / 2 + 1)).cast("int").cast("string"), F.lit('"/>'))
    placed = F.when(F.size(held) == 0, "").when(F.col("leads") & item["checked"].isNull(), number).otherwise(inset)
    box = F.when((F.size(held) > 0) & F.col("leads") & item["checked"].isNotNull(), run(F.lit(""), F.when(item["checked"], "☑ ").otherwise("☐ "))).otherwise("")
    quoted = F.exists(path, lambda n: n["kind"] == "quote")
    style = F.when(F.size(held) > 0, "ListParagraph").when(quoted, "Quote").otherwise("Normal")
    code = F.array_join(F.transform(F.split(text, "\n"), lambda x: paragraph("SourceCode", run(F.lit(""), x))), "")
    rows = F.col("n_lines") - 1
    columns = (F.size("units") / F.greatest(F.lit(1), rows)).cast("int")
    width = column_twips(columns).cast("string")
    cell = lambda x: F.concat(F.lit('<w:tc><w:tcPr><w:tcW w:w="'), width, F.lit('" w:type="dxa"/></w:tcPr>'), paragraph("Normal", x), F.lit("</w:tc>"))
    row = lambda k: F.concat(F.lit("<w:tr>"), F.array_join(F.transform(F.slice("units", k * columns + 1, columns), cell), ""), F.lit("</w:tr>"))
    grid = F.array_join(F.array_repeat(F.concat(F.lit('<w:gridCol w:w="'), width, F.lit('"/>')), columns), "")
    table = F.concat(F.lit('<w:tbl><w:tblPr><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>'), grid, F.lit("</w:tblGrid>"), F.array_join(F.transform(F.sequence(F.lit(0), rows - 1), row), ""), F.lit("</w:tbl>"))
    return (
        F.when(F.col("kind") == "heading", paragraph(F.concat(F.lit("Heading"), F.col("level").cast("string")), runs))
        .when(F.col("kind") == "code", code)
        .when(F.col("kind") == "rule", F.lit('<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr></w:pPr></w:p>'))
        .when(F.col("kind") == "table", table)
        .when(F.col("kind") == "paragraph", paragraph(style, F.concat(box, runs), placed))
        .otherwise("")
    )


def styles() -> str:
    one = lambda name, run="", para="", kind="paragraph": f'<w:style w:type="{kind}" w:styleId="{name}"><w:name w:val="{name}"/><w:pPr>{para}</w:pPr><w:rPr>{run}</w:rPr></w:style>' if kind == "paragraph" else f'<w:style w:type="{kind}" w:styleId="{name}"><w:name w:val="{name}"/><w:rPr>{run}</w:rPr></w:style>'
    mono = '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>'
    heads = "".join(one(f"Heading{k}", f'<w:b/><w:sz w:val="{size}"/>', f'<w:outlineLvl w:val="{k - 1}"/>') for k, size in enumerate(HEADING_SIZES, 1))
    return f"<w:styles {W}>{one('Normal')}{heads}{one('Quote', '<w:i/>', '<w:ind w:left=\"720\"/>')}{one('SourceCode', mono)}{one('ListParagraph')}{one('InlineCode', mono, kind='character')}{one('Hyperlink', '<w:u w:val=\"single\"/>', kind='character')}</w:styles>"




def abstract_lists() -> str:
    """What bullets (0) and numbers (1) look like at each level."""
    out = []
    for ident, shown in enumerate((lambda k: ("bullet", GLYPHS[k % 3]), lambda k: (NUMERALS[k % 3], f"%{k + 1}."))):
        levels = []
        for k in range(LIST_LEVELS):
            kind, label = shown(k)
            place = f'<w:pPr><w:ind w:left="{INDENT * (k + 2)}" w:hanging="{INDENT}"/></w:pPr>'
            levels.append(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{label}"/>{place}</w:lvl>')
        out.append(f'<w:abstractNum w:abstractNumId="{ident}">{"".join(levels)}</w:abstractNum>')
    return "".join(out)


def numbering(numbers: Column) -> Column:
    """The numbering part: bullets share list 1; numbers holds (num, level, start) of each numbered list, which begins anew."""
    one = lambda x: F.concat(F.lit('<w:num w:numId="'), x["num"].cast("string"), F.lit('"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="'), x["level"].cast("string"), F.lit('"><w:startOverride w:val="'), x["start"].cast("string"), F.lit('"/></w:lvlOverride></w:num>'))
    head = f'<w:numbering {W}>{abstract_lists()}<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    return F.concat(F.lit(head), F.array_join(F.transform(numbers, one), ""), F.lit("</w:numbering>"))


def package(body: Column, numbers: Column, links: Column, pictures: Column) -> Column:
    """The flat package around a document's body, its lists, link targets and pictures."""
    part = lambda name, kind, content: f'<pkg:part pkg:name="{name}" pkg:contentType="application/vnd.openxmlformats-{kind}+xml"><pkg:xmlData>{content}</pkg:xmlData></pkg:part>'
    relation = lambda ident, kind, to: f'<Relationship Id="{ident}" Type="{OFFICE}/{kind}" Target="{to}"/>'
    relations = lambda inner: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
    word = "officedocument.wordprocessingml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><?mso-application progid="Word.Document"?><pkg:package xmlns:pkg="http://schemas.microsoft.com/office/2006/xmlPackage">' + part("/_rels/.rels", "package.relationships", relations(relation("rId1", "officeDocument", "word/document.xml")))
    document = part("/word/document.xml", f"{word}.document.main", f"<w:document {W} {DRAWN}><w:body>\x00<w:sectPr/></w:body></w:document>")
    fixed = relation("rId1", "styles", "styles.xml") + relation("rId2", "numbering", "numbering.xml")
    rest = part("/word/_rels/document.xml.rels", "package.relationships", relations(fixed + "\x00")) + part("/word/styles.xml", f"{word}.styles", styles()) + part("/word/numbering.xml", f"{word}.numbering", "\x00") + "\x00</pkg:package>"
    one, two, three, four, five = (head + document + rest).split("\x00")
    targets = F.transform(links, lambda x: F.concat(F.lit('<Relationship Id="'), link_id(x), F.lit(f'" Type="{OFFICE}/hyperlink" Target="'), xml_escape(x), F.lit('" TargetMode="External"/>')))
    media = F.transform(pictures, lambda x: F.concat(F.lit('<Relationship Id="'), x["relation"], F.lit(f'" Type="{OFFICE}/image" Target="media/'), xml_escape(x["name"]), F.lit('"/>')))
    files = F.transform(pictures, lambda x: F.concat(F.lit('<pkg:part pkg:name="/word/media/'), xml_escape(x["name"]), F.lit('" pkg:contentType="'), x["mime"], F.lit('" pkg:compression="store"><pkg:binaryData>'), F.base64(x["content"]), F.lit("</pkg:binaryData></pkg:part>")))
    return F.concat(F.lit(one), body, F.lit(two), F.array_join(targets, ""), F.array_join(media, ""), F.lit(three), numbering(numbers), F.lit(four), F.array_join(files, ""), F.lit(five))


PICTURES = "array<struct<source:string,name:string,relation:string,mime:string,cx:bigint,cy:bigint,content:binary>>"
#: Columns of blocks that packages are made from.
SHOWN = ("block", "kind", "level", "n_lines", "path", "leads", "pieces", "verbatim")
NUMBERS = "array<struct<num:int,level:int,start:bigint>>"


def to_word(docs: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """doc, data: docs (doc, source) as flat Word packages.

    pictures (doc, source, name, relation, mime, cx, cy, content) are the files that a document's images show, each once;
    images without one are named in brackets.
    """
    found = structure(docs, SHOWN, ends=True)
    if pictures is None:
        files, rows = None, found.withColumn("pictures", F.array().cast(PICTURES))
    else:
        fields = ("source", "name", "relation", "mime", "cx", "cy", "content")
        # one part and relation a file, whatever sources show it
        once = pictures.groupBy("doc", "name").agg(*(F.first(c).alias(c) for c in fields if c != "name")).select("doc", *fields)
        files = once.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("files"))
        # blocks need only the pictures' sizes and names
        sizes = pictures.groupBy("doc").agg(F.collect_list(F.struct(*fields[:6], F.lit(None).cast("binary").alias("content"))).alias("pictures"))
        rows = found.join(sizes.hint("merge"), "doc", "left").withColumn("pictures", F.coalesce("pictures", F.array().cast(PICTURES)))
    wide = F.when(F.col("kind") == "table", F.size("pieces") / F.greatest(F.lit(1), F.col("n_lines") - 1)).otherwise(0)
    # one list for each numbered list of a document; bullets share the first
    begun = F.transform("path", lambda n, i: F.when(n["kind"] == "ol", F.struct((n["nth"] + 2).alias("num"), F.least(F.size(F.filter(F.slice("path", 1, i), lambda m: m["kind"] == "item")), F.lit(LIST_LEVELS - 1)).alias("level"), n["start"].alias("start"))))
    targets = F.filter(F.transform(F.flatten("pieces"), lambda p: F.when((p["kind"] == "open") & (p["link"] != ""), p["link"])), lambda x: x.isNotNull())
    rows = rows.withColumn("lists", F.filter(begun, lambda x: x.isNotNull())).withColumn("links", F.array_distinct(targets))
    shown = rows.withColumn("units", F.transform("pieces", lambda unit, i: unit_runs(unit, i < wide))).withColumn("out", block_word())
    parts = shown.groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "out")))), lambda x: x["out"]), "").alias("body"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("numbers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("links")))).alias("targets"),
        copies(),
    )
    made = each_copy(parts, "body", "numbers", "targets")
    # Spark takes files for smaller than they are, and would send them to the driver
    made = made.withColumn("files", F.array().cast(PICTURES)) if files is None else made.join(files.hint("merge"), "doc", "left")
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    return made.select("doc", package(F.coalesce("body", F.lit("")), empty("numbers", NUMBERS), empty("targets", "array<string>"), empty("files", PICTURES)).alias("data"))
