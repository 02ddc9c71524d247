"""Files as rows: text with an encoding policy, kinds of input, image headers, and conversion with quarantine."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioflow.functions.geometry import emu_size
from folioflow.functions.text import css_variables, extension, has_scheme, percent_decoded, standalone, suggested_name
from folioflow.operators.inlines import MARKED, images
from folioflow.operators.rendering import rendered, titles
from folioflow.operators.structure import structure
from folioflow.operators.word import to_word

#: Extensions by kind of input, MIME types by extension, extensions of the outputs.
KINDS = {"markdown": "md markdown mdown mkd mdtext text txt", "pdf": "pdf", "image": "png jpg jpeg heic heif tiff tif gif bmp webp"}
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "heic": "image/heic", "tiff": "image/tiff", "tif": "image/tiff"}
OUTPUTS = {"markdown": "md", "html": "html", "text": "txt", "word": "xml"}
#: MIME types of the pictures that Word documents hold, and the outputs that an input may become.
WORD_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "tiff": "image/tiff", "tif": "image/tiff", "bmp": "image/bmp"}
CHOICES = {"markdown": ("word", "html", "text"), "pdf": ("markdown", "word", "html", "text"), "image": ("markdown", "word", "html", "text")}
INLINE_BYTES = 8 * 1024 * 1024


def input_kind(path: Column) -> Column:
    out, ext = F.lit(None).cast("string"), extension(path)
    for kind, names in KINDS.items():
        out = F.when(ext.isin(*names.split()), kind).otherwise(out)
    return out


def mime_type(ext: Column) -> Column:
    out = F.lit("application/octet-stream")
    for name, mime in MIME.items():
        out = F.when(F.lower(ext) == name, mime).otherwise(out)
    return out


def word_mime_type(ext: Column) -> Column:
    """Null for what Word documents don't hold."""
    out = F.lit(None).cast("string")
    for name, mime in WORD_MIME.items():
        out = F.when(F.lower(ext) == name, mime).otherwise(out)
    return out


def output_choices(inputs: DataFrame) -> DataFrame:
    """inputs (path, ...) with kind, output and is_converted (whether a drop converts it, where others are opened); a row for each allowed output."""
    pairs = inputs.sparkSession.createDataFrame([(k, o) for k, outs in CHOICES.items() for o in outs], "kind string, output string")
    rows = inputs.withColumn("kind", input_kind(F.col("path")))
    return rows.join(F.broadcast(pairs), "kind").withColumn("is_converted", F.col("kind").isin("pdf", "image"))


def word_media(images: DataFrame) -> DataFrame:
    """doc, ord, name, relation, drawing, mime of images (doc, pos, src) that a Word document can hold, numbered in order; relations begin at 3."""
    ext = F.lower(extension(F.col("src")))
    held = images.withColumn("ext", ext).withColumn("mime", word_mime_type(ext)).where("mime IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    return held.withColumn("ord", n).select("doc", "ord", F.concat(F.lit("image"), F.col("ord").cast("string"), F.lit("."), F.col("ext")).alias("name"), F.concat(F.lit("rId"), (F.col("ord") + 2).cast("string")).alias("relation"), F.col("ord").alias("drawing"), "mime")


def placed_pictures(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """doc, source, name, relation, mime, cx, cy, content: the files of stored (path, content) that images of docs (doc, source) show, each once a document.

    doc is a document's path; sources are looked up from its folder, without . and .. steps. Files of kinds that Word documents
    don't hold, and without a size in their header, are left out. Sizes are in EMU, at most a page wide.
    """
    found = images(structure(docs, MARKED)).select("doc", "src").distinct()
    ext = F.lower(extension(F.col("src")))
    wanted = found.withColumn("ext", ext).withColumn("mime", word_mime_type(ext)).where("mime IS NOT NULL AND src <> ''")
    wanted = wanted.withColumn("path", resolved_path(F.regexp_replace("doc", "/?[^/]*$", ""), F.col("src")))
    # sizes come before the join, so that documents are read once and a file's header is read once, however many show it
    sized = image_sizes(stored).where("width > 0 AND height > 0")
    cx, cy = emu_size(F.col("width"), F.col("height"))
    rows = wanted.join(sized.select("path", "content", cx.alias("cx"), cy.alias("cy")).hint("merge"), "path")
    # one file may be shown by several sources; it is one part of the document
    nth = F.dense_rank().over(Window.partitionBy("doc").orderBy("path")).cast("string")
    named = rows.withColumn("name", F.concat(F.lit("image"), nth, F.lit("."), "ext")).withColumn("relation", F.concat(F.lit("picture"), nth))
    return named.select("doc", F.col("src").alias("source"), "name", "relation", "mime", "cx", "cy", "content")


def word_documents(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """doc, data: docs (doc, source) as Word packages that hold the pictures their images show; see placed_pictures."""
    return to_word(docs, placed_pictures(docs, stored))


def content_types(media: DataFrame) -> DataFrame:
    """doc, types: the extensions of a document's media, each once and in order, with their MIME types."""
    pair = F.concat(extension(F.col("name")), F.lit("="), F.col("mime"))
    return media.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set(pair)), ";").alias("types"))


def resolved_path(folder: Column, src: Column) -> Column:
    """The path of a local source, without . and .. steps; null for remote and empty ones."""
    plain = F.coalesce(percent_decoded(src), src)
    whole = F.when(src.startswith("file://"), F.substring(plain, F.lit(8), F.length(plain))).when(has_scheme(src), F.lit(None)).when(plain.startswith("/"), plain).otherwise(F.concat(folder, F.lit("/"), plain))
    steps = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x))))
    return F.when(src != "", F.concat(F.lit("/"), F.array_join(kept, "/")))


def decoded(content: Column, policy: str = "strict") -> Column:
    """Bytes as text: UTF-8, null where it isn't; the policy `latin1` falls back to ISO-8859-1."""
    strict = F.try_validate_utf8(content.cast("string"))
    return strict if policy == "strict" else F.coalesce(strict, F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, path: str, policy: str = "strict") -> DataFrame:
    """path, kind, source, error_code of the files below path; unreadable and unsupported ones are rows with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = input_kind(F.col("path"))
    text = F.when(kind == "markdown", decoded(F.col("content"), policy))
    error = F.when(kind.isNull(), "unsupportedInput").when(kind != "markdown", "unsupportedConversion").when(text.isNull(), "unreadableFile")
    return files.select("path", kind.alias("kind"), text.alias("source"), error.alias("error_code"))


def convert_files(files: DataFrame, to: str) -> DataFrame:
    """path, suggested_name, data, error_code: files (path, source, error_code) in another format; errors pass through."""
    made = convert_text(files.where("error_code IS NULL").select(F.col("path").alias("doc"), "source"), to).withColumnRenamed("doc", "path")
    return files.select("path", "error_code").join(made.hint("merge"), "path", "left").select("path", suggested_name(F.col("path"), OUTPUTS[to]).alias("suggested_name"), "data", "error_code")


def convert_text(docs: DataFrame, to: str) -> DataFrame:
    """doc, data: docs (doc, source) as markdown, html, text or word."""
    return to_word(docs) if to == "word" else rendered(docs, to)


def extract_markdown(files: DataFrame) -> DataFrame:
    """path, markdown, error_code: what files (path, source, error_code) hold as Markdown; empty ones are an error."""
    empty = F.coalesce(F.regexp_replace("source", r"\s", ""), F.lit("")) == ""
    error = F.coalesce("error_code", F.when(empty, "noTextFound"))
    return files.select("path", F.when(error.isNull(), F.col("source")).alias("markdown"), error.alias("error_code"))


@dataclass(frozen=True)
class Converter:
    """How documents are shown: theme tokens, drawn diagrams (source, svg), and whether raw HTML passes."""

    theme: dict[str, str]
    diagrams: DataFrame | None = None
    raw_html: bool = True

    def pages(self, docs: DataFrame) -> DataFrame:
        """doc, data: standalone pages of docs (doc, source), named by their first heading."""
        body = rendered(docs, "html", self.raw_html, self.diagrams)
        return body.join(titles(docs).hint("merge"), "doc").select("doc", standalone(F.col("title"), F.col("data"), css_variables(self.theme)).alias("data"))

    def previews(self, docs: DataFrame) -> DataFrame:
        """Pages of docs (doc, source) named by their file, doc, without raw HTML."""
        name = F.regexp_extract("doc", r"([^/]*)$", 1)
        return rendered(docs, "html", False, self.diagrams).select("doc", standalone(name, F.col("data"), css_variables(self.theme)).alias("data"))


def inlined_images(images: DataFrame, files: DataFrame) -> DataFrame:
    """images (doc, src) with href: local files of bounded size as data URIs, all others as they are.

    files (path, content) holds what may be inlined; a relative source is looked up below its document's folder (doc), and
    paths that leave it are not followed.
    """
    local = ~F.col("src").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.col("src").rlike(r"(^|/)\.\.(/|$)|^/")
    below = F.regexp_replace(F.coalesce(percent_decoded(F.col("src")), F.col("src")), r"^\./", "")
    local = local & ~below.rlike(r"(^|/)\.\.(/|$)|^/")
    wanted = images.withColumn("path", F.when(local, F.concat(F.regexp_replace("doc", "[^/]*$", ""), below)))
    small = files.where(F.octet_length("content") <= INLINE_BYTES)
    uri = F.concat(F.lit("data:"), mime_type(extension(F.col("path"))), F.lit(";base64,"), F.base64("content"))
    return wanted.join(small.hint("merge"), "path", "left").select("doc", "src", F.coalesce(uri, F.col("src")).alias("href"))


def _frame_size(raw: bytes | None) -> tuple[int | None, int | None]:
    """Width and height of a JPEG's first frame or a TIFF's first directory."""
    raw = raw or b""
    try:
        if raw[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(raw):
                kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
                at += 2 + size
        if raw[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if raw[:1] == b"I" else ">"
            (start,) = struct.unpack_from(order + "I", raw, 4)
            (n,) = struct.unpack_from(order + "H", raw, start)
            found = {}
            for k in range(n):
                tag, kind = struct.unpack_from(order + "HH", raw, start + 2 + 12 * k)
                (found[tag],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw, start + 10 + 12 * k)
            return found.get(256), found.get(257)
    except struct.error:
        pass
    return None, None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def frame_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(map(_frame_size, content), columns=["width", "height"], dtype="Int32")


# else Spark takes the walk over to the other side of a join by path, into the tasks that read documents, where each has a second worker for it
frame_size = frame_size.asNondeterministic()


def image_sizes(images: DataFrame, content_col: str = "content") -> DataFrame:
    """images with width and height from the header: PNG, GIF and BMP by expressions, JPEG and TIFF by a walk over their segments."""
    head = F.hex(F.substring(content_col, 1, 4))
    walked = F.coalesce(head.startswith("FFD8") | head.isin("49492A00", "4D4D002A"), F.lit(False))
    # images are read once: the walk gets nulls for all others
    size = F.when(walked, F.col("walked")).otherwise(image_size(F.col(content_col)))
    return images.withColumn("walked", frame_size(F.when(walked, F.col(content_col)))).withColumn("size", size).withColumn("width", F.col("size.width")).withColumn("height", F.col("size.height")).drop("size", "walked")


def image_size(content: Column) -> Column:
    """Width and height from a PNG, GIF or BMP header, as a struct; nulls for other bytes."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    little = lambda at: number(at, 1) + 256 * number(at + 1, 1)
    # four bytes with a sign: pictures from the top down have a negative height
    signed = lambda at: F.abs(little(at) + F.shiftleft(number(at + 2, 1), 16) + F.shiftleft(number(at + 3, 1), 24)).cast("int")
    png, gif = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.hex(F.substring(content, 1, 4)) == "47494638"
    bmp = F.hex(F.substring(content, 1, 2)) == "424D"
    return F.struct(F.when(png, number(17, 4)).when(gif, little(7)).when(bmp, signed(19)).alias("width"), F.when(png, number(21, 4)).when(gif, little(9)).when(bmp, signed(23)).alias("height"))
