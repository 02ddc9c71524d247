import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from folioflow.llm import sentencepiece_unigram as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  Hello   world\n\tx é 😀  ", "a▁b", "日本語のテキスト 漢字仮名", "\x00\x7f͸ \U0010ffff", "The quick brown fox", "x" * 700, "trailing  ",
    "naïve — “quoted”", "<0x41> <s> </s> <unk>",
]


@pytest.fixture(scope="module")
def vocab():
    return sp.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    """The same pieces under the library's own unigram model: the model type is one byte of the file."""
    import sentencepiece

    raw = open(PATH, "rb").read()
    assert raw.count(b"tok_v0\x18\x02") == 1
    return sentencepiece.SentencePieceProcessor(model_proto=raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))


def test_double_array_holds_every_piece(vocab):
    def walk(word):
        at = 0
        for b in word:
            to = vocab.base[at] + b + 1
            if vocab.check[to] != at:
                return -1
            at = to
        return vocab.piece[at]

    plain = [(x.replace(b" ", sp.MARK.encode()), i) for i, x in enumerate(vocab.pieces) if i >= 259]
    assert all(walk(x) == i for x, i in plain[:: 7]) and walk(b"<s>") == -1 and walk(b"zzzzqq") == -1


def test_same_ids_as_the_library(library):
    vocab = sp.load_vocabulary(PATH, from_ranks=False)
    rng = random.Random(3)
    alphabet = "abcdethe in\n  éß日😀'.,A1"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    encoder = sp.Encoder(vocab)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        if len(text) < 60 and "<" not in text and not set(text) & {"\x00", "͸", "\U0010ffff"}:
            want = library.encode(text)
            # the library adds up single-precision scores over the whole text, so paths of equal score may differ
            assert ids.tolist() == want or np.isclose(vocab.scores[ids].sum(), vocab.scores[want].sum(), rtol=1e-6), text
        assert encoder.decode(ids) == text.replace(sp.MARK, " ")


def brute(names, scores, text):
    best = {0: (0.0, [])}
    for i in range(len(text)):
        if i not in best:
            continue
        hits = [(k, x) for k, x in enumerate(names) if text.startswith(x, i)]
        if not any(len(x) == 1 for _, x in hits):
            hits.append((-1, text[i]))
        for k, x in hits:
            score = best[i][0] + (scores[k] if k >= 0 else min(scores[3:]) - 10)
            if i + len(x) not in best or score > best[i + len(x)][0]:
                best[i + len(x)] = (score, [*best[i][1], (k, x)])
    return best[len(text)][1]


def test_small_vocabularies_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        pool = {"".join(rng.choice(f"{sp.MARK}abé") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        names = ["<unk>", "<s>", "</s>", *sorted(pool)]
        scores = np.array([0, 0, 0, *(-rng.randint(1, 60) / 4 for _ in pool)], np.float32)
        v = sp.vocabulary(names, scores, {0, 1, 2}, {}, 0)
        for _ in range(10):
            text = "".join(rng.choice(" abéz") for _ in range(rng.randint(1, 12)))
            want = [i for k, x in brute(names[3:], scores[3:].tolist() and [*scores[3:]], f" {text}".replace(" ", sp.MARK)) for i in ([k + 3] if k >= 0 else [0] * len(x.encode()))]
            got = sp.Encoder(v).encode([text])[0].tolist()
            total = lambda ids: sum(float(scores[i]) for i in ids)
            assert got == want or total(got) == total(want)


def test_tables(spark, vocab):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "null id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_pieces int")
    got = {r.doc_id: r for r in sp.encode_digest(docs, PATH).collect()}
    want = dict(enumerate(sp.Encoder(vocab).encode(TEXTS)))
    for i, ids in want.items():
        assert (got[i].n_pieces, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and got[i].round_trip == (sp.MARK not in (TEXTS[i] or ""))
    assert sp.encode_digest(docs, PATH, True).columns[-1] == "ids"
    back = sp.decode(sp.encode(docs, PATH, keep=("doc_id", "n_pieces")), PATH).collect()
    assert {(r.doc_id, r.text) for r in back} == {(r[0], (r[1] or "").replace(sp.MARK, " ")) for r in rows}
    assert sp.encode_digest(docs.limit(0), PATH).count() == 0


def test_scores_are_log_probabilities_by_rank(vocab):
    plain = np.arange(259, len(vocab.pieces))
    assert np.isclose(np.exp(vocab.scores[plain]).sum(), 1) 
    given = sp.load_vocabulary(PATH, from_ranks=False).scores[plain]
    order = np.argsort(-given, kind="stable")
    assert (np.diff(vocab.scores[plain][order]) < 0).all() and np.isclose(np.ptp(vocab.scores[plain]), np.log(len(plain)))
    logs = np.array([0.0, -1.5, -2.5, -2.25])
    assert sp.rank_scores(logs, np.arange(1, 4)) is logs


def test_long_chunks(vocab):
    rng = random.Random(5)
    encoder = sp.Encoder(vocab)
    for n in (1, 2, 3, 50, 400):
        chunk = "".join(rng.choice("abcdethe inlon  éß日😀'.,A1\u0378") for _ in range(n))
        assert encoder.viterbi_long(chunk).tolist() == encoder.viterbi([chunk])[0].tolist()
    text = "".join(rng.choice("abcdefgéß日") for _ in range(600_000))
    ids = encoder.encode([text])[0]
    assert encoder.decode(ids) == text


def test_double_array_grows():
    words = {bytes([a, b]): a * 256 + b for a in range(256) for b in range(0, 256, 1 + a % 3)}
    base, check, piece = sp.double_array(words)
    for (a, b), i in words.items():
        first = base[0] + a + 1
        assert check[first] == 0 and check[base[first] + b + 1] == first and piece[base[first] + b + 1] == i
