import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import quality_bayes as qb

SCHEMA = "doc_id long, text string, lang string, source string, quality string, evidence int"


def rows(n=900):
    rng = random.Random(3)
    out, labels = [], []
    for i in range(n):
        host = rng.choice(["good.org"] * 4 + ["bad.net"] * 2 + ["tiny.io"])
        good = rng.random() < {"good.org": 0.9, "bad.net": 0.2, "tiny.io": 0.5}[host]
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(30)) * 0 for _ in range(rng.randint(20, 60))] if good else ["spam!!!"] * rng.randint(5, 80)
        out.append((i, " ".join(words), f"p{i % 3}", host, "x", 1))
        if i % 2:
            labels.append((i, int(good), 0))
    return out, labels


def test_labels_are_recovered_and_sites_shrunk(spark):
    data, labels = rows()
    truth = {d: "spam" not in t for d, t, *_ in data}
    extra = [(9000, None, None, None, "x", 1), (9001, "", "p0", "good.org", "x", 1), (9002, "alpha beta " * 20_000, "p9", "new.host", "x", 1), data[4]]
    docs = spark.createDataFrame(data + extra, SCHEMA)
    got = qb.classify(docs, spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang")).collect()
    assert len(got) == len(data) + len(extra)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].keep == truth[i] for i in truth if i % 2 == 0]) > 0.98
    assert all(0 <= r.quality <= 1 and 0 < r.path_rate < 1 for r in got)
    rates = {r.doc_id: r.host_rate for r in got}
    hosts = {d: h for d, _, _, h, *_ in data}
    mean = lambda h: np.mean([rates[d] for d in hosts if hosts[d] == h])
    assert mean("good.org") > mean("tiny.io") > mean("bad.net") and mean("bad.net") < rates[9002] < mean("good.org")


def test_no_labels_and_empty(spark):
    data, _ = rows(40)
    docs, none = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.evidence, 9) for r in qb.classify(docs, none).collect()} == {0.0}
    assert qb.classify(docs.limit(0), none).count() == 0


def test_features_of_kinds():
    assert qb.features(None) == qb.features(" \n") == [0] * 8
    assert qb.features("a b c d")[1] == 10 and qb.features("a a a a")[6] > 10 and qb.features("A! B! C!")[3] > 10


def folds(spark, ids):
    return {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(qb.FOLDS))).collect()}


def plain(data, labels, fold):
    """classify(), one row at a time, without numpy or Spark."""
    given = defaultdict(list)
    for d, q, *_ in labels:
        if d is not None and q is not None:
            given[d].append(q)
    label = {d: sum(q) / len(q) for d, q in given.items()}
    docs = [(d, host or "", path or "", label.get(d), qb.features(t), qb.gram_cells([t])[0].tolist()) for d, t, path, host, *_ in data]
    counts, n = [Counter(), Counter()], [Counter(), Counter()]
    for d, _, _, y, bins, cells in docs:
        if y is not None:
            for k, share in enumerate((y, 1 - y)):
                n[k][fold[d]] += share
                for place in [*((f, b) for f, b in enumerate(bins)), *(("gram", c) for c in cells)]:
                    counts[k][fold[d], place] += share

    def ratio(place, without, kinds):
        of = [f for f in range(qb.FOLDS) if f != without]
        good, bad = (math.log(sum(counts[k][f, place] for f in of) + 1) - math.log(sum(n[k][f] for f in of) + kinds) for k in (0, 1))
        return good - bad

    raws = []
    for d, _, _, y, bins, cells in docs:
        out = None if y is None else fold[d]
        lexical = sum(ratio(("gram", c), out, 2) for c in cells) / math.sqrt(max(1, len(cells)))
        raws.append(sum(ratio((f, b), out, qb.BINS) for f, b in enumerate(bins)) + lexical)
    spans = [max(-20, min(19, math.floor(r))) for r in raws]
    held = [Counter(), Counter()]
    for (_, _, _, y, *_), x in zip(docs, spans, strict=True):
        if y is not None:
            held[0][x] += y
            held[1][x] += 1 - y
    good, bad = held[0].total(), held[1].total()
    evidence = [math.log((held[0][x] + 1) / (good + 40)) - math.log((held[1][x] + 1) / (bad + 40)) for x in spans]
    base = (good + 1) / (good + bad + 2)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    rate = [sigmoid(e + math.log(base / (1 - base))) if y is None else y for (_, _, _, y, *_), e in zip(docs, evidence, strict=True)]
    s, m, hs, hn = Counter(), Counter(), Counter(), Counter()
    for (_, h, p, *_), r in zip(docs, rate, strict=True):
        s[h, p] += r
        m[h, p] += 1
        hs[h] += r
        hn[h] += 1
    centre = sum(rate) / len(rate)

    def prior(groups):
        """groups: mean, number and centre of each."""
        total, squares = sum(g[1] for g in groups), sum(g[1] ** 2 for g in groups)
        v = sum(c * (1 - c) for _, _, c in groups) / len(groups)
        free = total - squares / total
        between = (sum(w * (x - c) ** 2 for x, w, c in groups) - sum(c * (1 - c) for _, _, c in groups)) / free if free > 0 else 0
        return min(1e6, max(1.0, v / between - 1)) if between > 0 else 1e6

    w = prior([(hs[h] / hn[h], hn[h], centre) for h in hn])
    shrunk = {h: (hs[h] + w * centre) / (hn[h] + w) for h in hn}
    w2 = prior([(s[k] / m[k], m[k], shrunk[k[0]]) for k in m])
    out = []
    for (d, h, p, *_), e, r in zip(docs, evidence, rate, strict=True):
        host = (hs[h] - r + w * centre) / (hn[h] - 1 + w)
        path = (s[h, p] - r + w2 * host) / (m[h, p] - 1 + w2)
        q = sigmoid(e + math.log(path / (1 - path)))
        out.append((d, e, host, path, q, q >= 0.5))
    return sorted(out, key=str)


def test_matches_plain_version(spark):
    data, labels = rows(300)
    data += [(9000, None, None, None, "x", 1), (9001, "", "p0", None, "x", 1), (9002, "alpha spam!!! beta", None, "good.org", "x", 1), data[5], (None, "gamma delta", "p1", "tiny.io", "x", 1)]
    labels += [(5, 0, 0), (9000, 1, 0), (None, 1, 1), (7, None, 0)]
    got = sorted((tuple(r) for r in qb.classify(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()), key=str)
    want = plain(data, labels, folds(spark, [d for d, *_ in data if d is not None]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[5] == w[5] and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(g[1:5], w[1:5], strict=True))


def test_gram_cells_are_those_of_each_text():
    texts = ["one two", None, "two one two one", "", "one", "One  TWO"]
    cells = [c.tolist() for c in qb.gram_cells(texts)]
    assert cells == [qb.gram_cells([t])[0].tolist() for t in texts]
    assert list(map(len, cells)) == [3, 0, 4, 0, 1, 3] and cells[0] == cells[5] and set(cells[4]) < set(cells[0]) < set(cells[2])
