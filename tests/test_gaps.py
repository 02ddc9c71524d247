"""Cases of the smaller operators that no table of the queries holds."""

import struct
import zlib

from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import pages, ranges
from folioflow.sources import files
from folioflow.streaming import edits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers_and_sizes(spark):
    for x in (0.0, 7.0, -3.0, 0.5, 1 / 3, 1e-5, 0.30000000000000004, 123456.7, 1234567.5, 2.5e-7, 130200.4, 99999.97, 1e-4):
        assert one(spark, text.number_text(F.lit(x))) == (str(int(x)) if x == int(x) else "%g" % x), x
    sizes = {0: "", 1: "1 byte", 999: "999 bytes", 1000: "1 kB", 2_400_000: "2.4 MB", 3_000_000: "3 MB", 1_250_000_000: "1.25 GB", 1_500_000_000_000: "1.5 TB"}
    for n, shown in sizes.items():
        assert one(spark, text.size_text(F.lit(n).cast("long"))) == shown
    assert one(spark, text.percent_text(F.lit(0.426))) == "43%" and one(spark, text.queue_text(F.lit(1), F.lit(1))) is None
    assert one(spark, F.hex(F.crc32(F.lit("123456789").cast("binary")))) == "CBF43926"


def test_paths_are_resolved_within_reason(spark):
    cases = {"a.png": "/d/e/a.png", "./x/../a%20b.png": "/d/e/a b.png", "../../../../a": "/a", "/abs//b/.": "/abs/b", "http://h/a": None, "file:///f/g.png": "/f/g.png", "": None, "100%": "/d/e/100%"}
    rows = spark.createDataFrame([(k,) for k in cases], "src string").select("src", files.resolved_path(F.lit("/d/e"), F.col("src")).alias("p")).collect()
    assert {r.src: r.p for r in rows} == cases


def test_image_headers(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 400, 200)
    gif, bmp = b"GIF89a" + struct.pack("<HH", 300, 500), b"BM" + bytes(16) + struct.pack("<II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc4" + struct.pack(">H", 4) + bytes(2) + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 77, 99) + bytes(12)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 31, 0) + struct.pack("<HHII", 257, 4, 1, 41)
    big = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 2) + struct.pack(">HHIHH", 256, 3, 1, 32, 0) + struct.pack(">HHII", 257, 4, 1, 42)
    cases = [("png", png, (400, 200)), ("gif", gif, (300, 500)), ("bmp", bmp, (640, 480)), ("jpeg", jpeg, (99, 77)), ("tiff", tiff, (31, 41)), ("big", big, (32, 42)), ("cut", jpeg[:20], (None, None)), ("bad", b"II*\0\xff\xff\xff\xff", (None, None)), ("text", b"hello", (None, None)), ("none", None, (None, None)), ("empty", b"", (None, None))]
    got = files.image_sizes(spark.createDataFrame([(n, c) for n, c, _ in cases], "name string, content binary")).collect()
    assert {r["name"]: (r.width, r.height) for r in got} == {n: size for n, _, size in cases}


def test_converter(spark):
    docs = spark.createDataFrame([("/d/a.md", "# T *x*\n\n<b>raw</b>"), ("/d/b.md", "plain")], "doc string, source string")
    pages_of = {r.doc: r.data for r in files.Converter({"text": "#111"}).pages(docs).collect()}
    assert "<title>T x</title>" in pages_of["/d/a.md"] and "<b>raw</b>" in pages_of["/d/a.md"] and "--text:#111;" in pages_of["/d/a.md"] and "<title>Untitled</title>" in pages_of["/d/b.md"]
    seen = {r.doc: r.data for r in files.Converter({}).previews(docs).collect()}
    assert "<title>a.md</title>" in seen["/d/a.md"] and "&lt;b&gt;raw&lt;/b&gt;" in seen["/d/a.md"]
    assert files.convert_text(docs, "word").count() == 2
    read = spark.createDataFrame([("a", "x", None), ("b", " \n", None), ("c", None, "unreadableFile")], "path string, source string, error_code string")
    assert {tuple(r) for r in files.extract_markdown(read).collect()} == {("a", "x", None), ("b", None, "noTextFound"), ("c", None, "unreadableFile")}


def test_numbered_lists_begin_anew_in_word(spark):
    source = "3. a\n4. b\n\ntext\n\n1. c\n   1) d\n- e"
    data = files.convert_text(spark.createDataFrame([(1, source)], "doc long, source string"), "word").first().data
    numbers = [x.split('"')[0] for x in data.split('<w:num w:numId="')[1:]]
    starts = [x.split('"')[0] for x in data.split('<w:startOverride w:val="')[1:]]
    used = [x.split('"')[0] for x in data.split("<w:body>")[1].split("</w:body>")[0].split('<w:numId w:val="')[1:]]
    assert numbers == ["1", "2", "3", "4"] and starts == ["3", "1", "1"] and used == ["2", "2", "3", "4", "1"]


def test_ranges(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 1), (1, 5, 0), (1, 5, 2), (1, 6, 9), (2, 6, 9)], "doc long, loc long, len long")
    assert sorted(map(tuple, ranges.in_order(spans).collect())) == [(1, 0, 5), (1, 5, 0), (1, 5, 2), (2, 6, 9)]
    points = spark.createDataFrame([(1, 5), (1, 8), (1, 99), (2, 15)], "doc long, at long")
    assert sorted(map(tuple, ranges.first_holding(points, spans).collect())) == [(1, 5, 0, 5), (1, 8, 6, 9), (2, 15, 6, 9)]


def test_pages_without_text_take_what_was_recognized(spark):
    lines = spark.createDataFrame([(1, 1, 0, "a", 9.0), (1, 2, 0, " ", None), (2, 1, 0, None, None)], "doc long, page long, pos long, text string, size double")
    found = spark.createDataFrame([(1, 1, 0, "no"), (1, 2, 0, "b"), (3, 1, 0, "c")], "doc long, page long, pos long, text string")
    assert sorted((r.doc, r.page, r.text) for r in pages.with_recognized(lines, found).collect()) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")]


def test_width_changes_and_import_queue(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "view string, seq long, width double"
    out = []
    for k, rows in enumerate(([("a", 1, 300.0), ("a", 2, 310.0), ("b", 1, 0.4)], [("a", 3, 310.4)], [("a", 4, 320.0), ("b", 2, 50.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = edits.width_changes(stream).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(out) == [("a", 310.0), ("a", 320.0), ("b", 50.0)]
    paths = str(tmp_path / "paths")
    spark.createDataFrame([("x.md", "hi", None), ("y.md", None, "unreadableFile")], "path string, source string, error_code string").coalesce(1).write.parquet(paths)
    stream = spark.readStream.schema("path string, source string, error_code string").parquet(paths)
    edits.import_queue(stream, lambda df: files.convert_files(df, "html"), str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "cq")).awaitTermination()
    done, failed = (spark.read.parquet(str(tmp_path / n / "v0")).collect() for n in ("done", "failed"))
    assert [(r.path, r.data) for r in done] == [("x.md", "<p>hi</p>\n")] and [(r.path, r.error_code) for r in failed] == [("y.md", "unreadableFile")]


def test_last_opened_is_pruned(spark, tmp_path):
    known = spark.createDataFrame([("a",)], "path string")
    source, schema = str(tmp_path / "in"), "path string, opened long"
    for k in range(4):
        spark.createDataFrame([("a", k), ("b", k)], schema).coalesce(1).write.mode("append").parquet(source)
        edits.keep_last_opened(spark.readStream.schema(schema).parquet(source), str(tmp_path / "t"), str(tmp_path / "c"), known).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v2", "v3"]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v3")).collect()] == [("a", 3)]


def test_crc(spark):
    assert one(spark, F.crc32(F.lit("é").cast("binary"))) == zlib.crc32("é".encode())
