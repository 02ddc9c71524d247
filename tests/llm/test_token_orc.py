import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import token_orc
from folioflow.llm.common import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (7, "Hello  world\nit's\tfine ok\x1cxx", "a"), (3, None, "b"), (3, "", None), (1, "É́ é ́x 's 'S ΑΣ ς", "c"),
    (9, "word " * 5000, "d"), (2, "a<|endoftext|>b 日本語 😀", "e"), (None, "null id", "f"), (4, "12345 !!?? don't", "g"), (4, "12345 !!?? don't", "g"),
]


def expected(spark, rows):
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    texts = spark.createDataFrame([(r[1],) for r in rows], "text string")
    key = {r.text: r.k for r in texts.select("text", F.xxhash64("text").alias("k")).collect()}
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]])):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("rows", [ROWS, []])
def test_digest_matches_whole_text_encoding(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    path = fresh_path(spark, "tokens")
    token_orc.write_tokens(docs, path, PATH, 2)
    got = token_orc.token_digest(spark, path)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(spark, rows)


def test_lookup_is_pushed_down(spark):
    path = fresh_path(spark, "tokens")
    token_orc.write_tokens(spark.createDataFrame(ROWS, "doc_id long, text string, x string"), path, PATH, 2)
    found = token_orc.find_documents(spark, path, [4])
    assert found.count() == 2
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "EqualTo(doc_id,4)" in found._jdf.queryExecution().toString()


def test_letters_that_become_marks_keep_their_punctuation():
    """Every letter before punctuation, and some words, have the ids of the whole text."""
    encoder = token_orc.WordEncoder(PATH)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    words = ["HEPS\u0130.", "\u0130STANBUL,", "\u0958.", "\ufb2a,", "ok.", "caf\u00e9!"] + [f"x{c}." for c in letters]
    want = Tokenizer.from_file(PATH).encode_batch(words, add_special_tokens=False)
    bad = [w for w, got, e in zip(words, encoder.encode(words, 2), want, strict=True) if got.tolist() != [*e.ids, 2]]
    assert not bad, bad[:10]


def test_files_have_row_indexes_and_bloom_filters_that_skip_rows(spark):
    path = fresh_path(spark, "tokens")
    docs = spark.range(20_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).repartition(3)
    token_orc.write_tokens(docs, path, PATH, 2)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [x.getPath() for x in folder.getFileSystem(conf).listStatus(folder) if x.getPath().getName().endswith(".orc")]
    kinds, encodings = set(), set()
    for file in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(file, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            encodings |= {footer.getColumns(c).getKind().toString() for c in (1, 4)}
    # column 1 is doc_id, column 4 and its element 5 the ids
    assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8"), (5, "DATA")} <= kinds and encodings == {"DIRECT_V2"}

    def rows_read(doc_id):
        found = token_orc.find_documents(spark, path, [doc_id])
        n = len(found.collect())
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, leaf.metrics().apply("numOutputRows").value()

    # a present id reads its row group, an absent one between two others none, or one that its filter takes for a hit
    n, read = rows_read(3 * 7777)
    assert n == 1 and 1 <= read <= 2000
    absent = [rows_read(3 * k + 1) for k in range(5000, 5020)]
    assert all(n == 0 for n, _ in absent) and sum(read for _, read in absent) <= 5000


def test_an_id_of_many_rows_fills_many_files(spark):
    path = fresh_path(spark, "tokens")
    rows = [(7, f"text {i}", "x") for i in range(3000)] + [(i, "other", "x") for i in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, x string"), path, PATH, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = token_orc.read_tokens(spark, path).where("doc_id = 7").groupBy("part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2500
    assert sorted(map(tuple, token_orc.token_digest(spark, path).collect()), key=lambda r: r[1]) == expected(spark, rows)
