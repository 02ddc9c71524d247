import random
import zlib

import numpy as np
import regex

from folioflow.llm import language_kernel as lk

WORDS = {"en": "the and of to in that with from house water", "de": "der und die das nicht mit für über wasser haus", "fr": "le et la que dans avec pour être maison eau"}
SCHEMA = "doc_id long, text string, lang string, source string, score string, held_out int"


def rows(n=600):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 60))), lang, "s", "x", 1))
    return [*out, (n, None, "en", None, "x", 1), (n + 1, "", "en", "s", "x", 1), (n + 2, "12 ?! 34 _", "de", "s", "x", 1), (None, "der und die", "de", "s", "x", 1), (n + 3, "maison " * 30_000, None, "s", "x", 1), (5, out[5][1], out[5][2], "s", "x", 1)]


def test_held_out_accuracy_and_cases(spark):
    data = rows()
    got = lk.language_digest(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    truth = {d: lang for d, _, lang, *_ in data}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and np.mean(held) > 0.99
    special = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(special[600 + k] == ("und", 0.0) for k in range(3)) and special[603][0] == "fr"


def test_nothing_to_learn_and_empty(spark):
    none = spark.createDataFrame([(1, "abc", None, "s", "x", 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in lk.language_digest(none).collect()] == [("und", 0.0)]
    assert lk.language_digest(none.limit(0)).count() == 0


CASES = ["Hello, World!", "ab", "ÀB 9 c", "x", "½ ² Ⅷ", "①②③", "", None, "a½b", "e\u0301 x", "\u0301", "हिन्दी भाषा।", "ไทยที่นี่", "12_3", "İz", "ａ\U0001d400\U0001f600"]


def plain_letters(text):
    """The definition, by the regex module."""
    return f" {regex.sub(r'[^\p{L}\p{M}]+', ' ', text.lower()).strip()} " if text else "  "


def plain_cells(text):
    out = set()
    for n, factors in enumerate(lk.MULTIPLIERS, 1):
        for i in range(len(text) - n + 1):
            h = sum(ord(c) * f for c, f in zip(text[i : i + n], factors, strict=True)) % 2**32
            h ^= h >> 15
            out.add((h * 2246822519 % 2**32) >> 18)
    return out


def test_spectra_against_sets():
    points, row, known = lk.letters(CASES)
    flags = lk.spectra(points, row, len(CASES))
    assert known.tolist() == [bool(t and regex.search(r"\p{L}", t)) for t in CASES]
    for k, text in enumerate(CASES):
        if known[k]:
            assert "".join(map(chr, points[row == k])) == plain_letters(text)
            assert set(np.flatnonzero(flags[k])) == plain_cells(plain_letters(text))
    assert lk.letters([])[2].tolist() == []


def test_numerals_and_marks_are_no_letters(spark):
    data = [(i, t, lang, "s", "x", 1) for i, (t, lang) in enumerate([("der die das und", "de"), ("the and of to", "en")] * 30)]
    odd = [(1000 + i, t, None, "s", "x", 1) for i, t in enumerate(["½ ² Ⅷ", "①②③", "\u0301\u0302", "৪৫", "。、!"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lk.language_digest(spark.createDataFrame(data + odd, SCHEMA)).collect()}
    assert [got[1000 + i] for i in range(len(odd))] == [("und", 0.0)] * len(odd)
    assert "und" not in {got[i][0] for i in range(60)}


def test_scores_against_plain_kernel_ridge():
    """The definition on sets: weights w of the landmarks that minimise the weighted squares of Kw - y plus ridge w'K_mm w."""
    data = [(t, lang) for _, t, lang, *_ in rows(90) if t and lang][:90]
    texts, langs = [t for t, _ in data], [x for _, x in data]
    points, row, known = lk.letters(texts)
    assert known.all()
    model = lk.fit(lk.spectra(points, row, len(texts)), langs, landmarks=12)
    sets = [plain_cells(plain_letters(t)) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    names = sorted(set(langs))
    chosen = [i for name in names for i in [k for k, x in enumerate(langs) if x == name][: 12 // len(names)]]
    mm = np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen])
    nm = np.array([[kernel(s, sets[j]) for j in chosen] for s in sets])
    share = np.array([len(langs) / (len(names) * langs.count(x)) for x in langs])
    wanted = np.array([[1.0 if x == name else -1.0 for name in names] for x in langs])
    weights = np.linalg.solve(nm.T @ (nm * share[:, None]) + lk.RIDGE * len(langs) / 100 * mm, nm.T @ (wanted * share[:, None]))
    scores = np.clip(((nm @ weights).max(axis=1) + 1) / 2, 0, 1)
    got_names, got_scores = lk.predict(model, texts)
    assert got_names == [names[k] for k in (nm @ weights).argmax(axis=1)]
    assert np.allclose(got_scores, scores, atol=1e-3)


def test_spark_and_python_agree_on_thirds(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 3 for r in ids.select("doc_id", lk.in_thirds()).collect())


def test_many_languages_are_summed_up_by_tasks(spark):
    """Training over the table gives the model of all its rows at hand, and only landmarks come to the driver."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        own = "".join(rng.permutation(list(alphabet))[:6])
        rows += [(100 * k + i, " ".join("".join(rng.choice(list(own), 5)) for _ in range(30)), f"l{k:03d}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lk.train(docs, per_language=4, landmarks=240)
    assert len(model.languages) == 120 and model.landmarks.shape[1] <= 240
    told, scores = lk.predict(model, [t for _, t, _ in rows])
    assert sum(a == b for a, (_, _, b) in zip(told, rows, strict=True)) > 0.95 * len(rows)
    again = lk.train(docs.repartition(7), per_language=4, landmarks=240)
    assert (again.weights == model.weights).all() and (again.landmarks == model.landmarks).all()
