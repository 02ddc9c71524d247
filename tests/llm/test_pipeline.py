"""The pipeline against a brute-force version, stage by stage, over the smallest documents table."""

import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from folioflow.llm import language_kernel, line_spread, sentencepiece_unigram
from tests.llm import test_ngram_join, test_source_mix

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, written as Parquet and read again, as the driver does it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        function(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:5]) and stages[5].columns == ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip", "ids"]


def test_language_stage(stages):
    model = language_kernel.train(stages[0])
    before = rows(stages[0])
    names, scores = language_kernel.predict(model, [r[1] for r in before])
    want = [r for r, name, score in zip(before, names, scores, strict=True) if name != "und" and score >= language_kernel.LEAST_SCORE]
    assert rows(stages[1]) == want and len(want) >= 0.97 * len(before)


def test_line_stage(stages):
    strip = lambda x: x.strip(" \t\r")
    sites, want = {}, []
    for _, text, _, source, _ in rows(stages[1]):
        for line in text.split("\n"):
            sites.setdefault(strip(line), set()).add(source)
    for doc_id, text, lang, source, n in rows(stages[1]):
        lines = text.split("\n")
        kept = [x for x in lines if not strip(x) or len(sites[strip(x)]) < line_spread.MIN_SITES]
        want.append((doc_id, "\n".join(kept), lang, source, n if len(kept) == len(lines) else len("\n".join(kept))))
    assert rows(stages[2]) == want


def test_near_duplicate_stage(stages):
    before = rows(stages[2])
    heads = {c for _, _, c in test_ngram_join.brute([(r[0], r[1]) for r in before])}
    assert rows(stages[3]) == [r for r in before if r[0] in heads] and len(heads) < len(before)


def test_mixing_stage(stages):
    before = rows(stages[3])
    taken = {d: n // size if size else 0 for d, size, _, _, n in test_source_mix.brute([(r[0], r[1], r[3]) for r in before])}
    assert rows(stages[4]) == sorted(r for r in before for _ in range(taken[r[0]]))


def test_token_stage(stages):
    encoder = sentencepiece_unigram.Encoder(sentencepiece_unigram.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    before = rows(stages[4])
    want = sorted((r[0], len(x), zlib.crc32(x.tobytes()), True, x.tolist()) for r, x in zip(before, encoder.encode([r[1] for r in before]), strict=True))
    assert sorted((r.doc_id, r.n_pieces, r.ids_crc32, r.round_trip, r.ids) for r in stages[5].collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.ids_crc32) for r in stages[5].collect())


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, h1 string, __size int, pos string, __lang double, __row int, __n_removed int"


def through(spark, data, tmp_path):
    docs = spark.createDataFrame(data, EXTRA)
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        yield name, docs


def test_stages_take_empty_tables(spark, tmp_path):
    for name, docs in through(spark, [], tmp_path):
        assert docs.count() == 0 and (name == "sentencepiece" or docs.columns == [c.split()[0] for c in EXTRA.split(", ")])


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and columns of the stages' own names."""
    said = ["the quick brown fox jumps over the lazy dog and runs away from it", "der schnelle braune fuchs springt weit hinweg dort"]
    rows = [(i, f"{said[i % 2]} {' '.join(chr(97 + i * k % 26) * 4 for k in range(1, 9))}", ["en", "de"][i % 2], f"s{i % 3}", 60) for i in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", "s0", 0), (None, rows[0][1] + " null id", None, None, None), (102, "1234 5678", "en", "s1", 9), (103, " ".join(f"word{i % 4000} and {said[0]}" for i in range(20_000)), "en", "s1", 1)]
    rows += [rows[5]] * 4
    data = [(*r, "x", 1, "y", 2, "z", 0.5, 7, 8) for r in rows]
    found = dict(through(spark, data, tmp_path))
    columns = [c.split()[0] for c in EXTRA.split(", ")]
    assert all(found[name].columns == columns for name in ("language_id", "line_dedup", "near_duplicates", "source_mixing"))
    ids = {name: [r.doc_id for r in df.collect()] for name, df in found.items()}
    assert {100, 101, 102}.isdisjoint(ids["language_id"]) and 103 in ids["language_id"] and ids["language_id"].count(5) == 5
    assert ids["near_duplicates"].count(5) == 1 and 103 in ids["near_duplicates"]
    assert all((r.row, r.node, r.h1, r["__size"], r.pos, r["__lang"], r["__row"], r["__n_removed"]) == ("x", 1, "y", 2, "z", 0.5, 7, 8) for r in found["source_mixing"].collect())
    assert all(r.round_trip for r in found["sentencepiece"].collect()) and set(ids["sentencepiece"]) <= set(ids["near_duplicates"])
