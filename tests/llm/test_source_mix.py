import hashlib
import random
import re
from fractions import Fraction

import pytest

from folioflow.llm import source_mix

SCHEMA = "doc_id long, text string, source string, size string, target int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows(n=600):
    rng = random.Random(5)
    out = [(i, " ".join(["w x"] * rng.randint(0, 40)) + "\n", rng.choice(["b", "a", "é", "\U0001f600", None, "hot", "hot", "hot"]), "z", 0) for i in range(n)]
    return [*out, (n, None, "a", "z", 0), (n + 1, "one", "single", "z", 0), (3, "again and again", "hot", "z", 0), (None, "null id", "b", "z", 0)]


def brute(data):
    """Whole documents in the order of their MD5, as long as the running total stays nearest the target."""
    sizes = {}
    for _, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + words(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict.fromkeys(names)
    left, live = Fraction(3, 2) * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while True:
        over = [s for s in live if left * live[s] / sum(live.values()) > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            targets[s] = Fraction(2 * sizes[s])
        left -= sum(targets[s] for s in over)
        live = {s: w for s, w in live.items() if s not in over}
    for s in live:
        targets[s] = left * live[s] / sum(live.values())
    out = []
    for s in names:
        run, (copies, rest) = 0, divmod(round(targets[s]), sizes[s]) if sizes[s] else (0, 0)
        mine = sorted((hashlib.md5(":".join(["0", *([] if d is None else [str(d)]), *([] if t is None else [hashlib.md5(t.encode()).hexdigest()])]).encode()).hexdigest(), words(t), d) for d, t, x, *_ in data if x == s)
        for place in sorted({m for m, *_ in mine}):
            same = [(n, d) for m, n, d in mine if m == place]
            words_ = sum(n for n, _ in same)
            out += [(d, n, sizes[s], float(targets[s]), n * (copies + (2 * run + words_ <= 2 * rest))) for n, d in same]
            run += words_
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    data = rows()
    got = [tuple(r) for r in source_mix.mix(spark.createDataFrame(data, SCHEMA)).collect()]
    want = brute(data)
    assert [(*g[:3], g[4]) if g[1] else g[:2] for g in sorted(got, key=str)] == [(*w[:3], w[4]) if w[1] else w[:2] for w in want]
    taken = {}
    for _, size, source_size, target, n in got:
        assert 0 <= n <= 2 * size and target <= 2 * source_size
        taken[(source_size, target)] = taken.get((source_size, target), 0) + n
    assert all(abs(n - t) <= 45 for (_, t), n in taken.items())


def test_mixed_documents_repeat_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = sum(words(r.text) for r in out.collect())
    assert taken == sum(r.taken for r in source_mix.mix(docs).collect())


def test_empty(spark):
    assert source_mix.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert source_mix.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overlapping_sources(spark):
    data = [(i, "a b c d", ["x", "y"] if i % 2 else ["x"] if i % 4 else ["y"]) for i in range(400)] + [(400, "lost", [])]
    got = source_mix.mix(spark.createDataFrame(data, "doc_id long, text string, s array<string>"), "s").collect()
    assert {r.taken for r in got if r.doc_id == 400} == {0} and sum(r.taken for r in got) > 0


@pytest.mark.parametrize("seed", range(20))
def test_route_is_a_cheapest_maximum_flow(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 4)
    patterns = [(rng.randint(0, 9), rng.sample(range(n), rng.randint(1, n))) for _ in range(rng.randint(1, 5))]
    quotas = [rng.randint(0, 15) for _ in range(n)]
    flow = source_mix.route(patterns, quotas, 2)
    for s in range(n):
        assert sum(f.get(s, 0) for f in flow) <= quotas[s]
    used = [sum(f.values()) for f in flow]
    assert all(0 <= u <= 2 * size for u, (size, _) in zip(used, patterns, strict=True))

    def most(passes):  # by Hall's condition over the subsets of sources
        return min(sum(q for i, q in enumerate(quotas) if not m >> i & 1) + sum(passes * size for size, ss in patterns if any(m >> i & 1 for i in ss)) for m in range(1 << n))

    assert sum(used) == most(2) and sum(min(u, size) for u, (size, _) in zip(used, patterns, strict=True)) == most(1)


def test_any_number_of_sources_that_no_document_shares(spark, tmp_path):
    """200,000 sources, one of them with a third of all rows, against the SQL of the mix."""
    import duckdb
    from pyspark.sql import functions as F

    ids = spark.range(300_000, numPartitions=4)
    source = F.when(F.col("id") < 100_000, "hot").when(F.col("id") % 50_021 == 0, None).otherwise(F.concat(F.lit("h"), F.col("id").cast("string")))
    docs = ids.select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), source.alias("source"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    got = source_mix.mix(spark.read.parquet(f"{tmp_path}/documents")).withColumn("target", F.round("target", 6))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    want = con.execute(source_mix.SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 300_000


def test_connected_parts_are_solved_by_themselves(spark):
    """Sources that documents share in chains, hot ones and single ones: all flows are those of one network of everything."""
    rng = random.Random(9)
    data = []
    for i in range(900):
        part = rng.randrange(12)
        members = rng.sample([f"s{part}-{k}" for k in range(4)], rng.randint(1, 3)) if part else ["hot"]
        data.append((i, "w " * rng.randint(0, 9), [*members, None] if part == 5 and rng.random() < 0.2 else members))
    got = source_mix.mix(spark.createDataFrame(data, "doc_id long, text string, s array<string>"), "s").collect()
    order = lambda s: (s is None, s or "")
    patterns, sizes = {}, {}
    for _, text, members in data:
        key = tuple(sorted(members, key=order))
        patterns[key] = patterns.get(key, 0) + words(text)
        for m in key:
            sizes[m] = sizes.get(m, 0) + words(text)
    names = sorted(sizes, key=order)
    targets = {s: t for s, t in zip(names, plain_targets([sizes[s] for s in names]), strict=True)}
    assert {r.doc_id: (r.source_size, r.target) for r in got} == {i: (sizes[min(m, key=order)], pytest.approx(float(targets[min(m, key=order)]))) for i, _, m in data}
    listed = sorted(patterns, key=lambda p: "\x01".join("-" if m is None else f"={m}" for m in p))
    flows = source_mix.route([(patterns[p], [names.index(m) for m in p]) for p in listed], [round(targets[s]) for s in names], 2)
    taken = {}
    for r, (_, _, members) in zip(sorted(got, key=lambda r: r.doc_id), data, strict=True):
        key = tuple(sorted(members, key=order))
        taken[key] = taken.get(key, 0) + r.taken
    assert all(abs(taken[p] - sum(f.values())) <= 9 for p, f in zip(listed, flows, strict=True))


def plain_targets(sizes):
    """Weighted targets of listed sizes: those over twice their size are set aside, and the rest is shared anew."""
    out, left, live = [None] * len(sizes), Fraction(3, 2) * sum(sizes), {i: (5, 2, 1)[i % 3] for i in range(len(sizes))}
    while over := [i for i, w in live.items() if left * w / sum(live.values()) > 2 * sizes[i]]:
        for i in over:
            out[i] = Fraction(2 * sizes[i])
            del live[i]
        left -= sum(out[i] for i in over)
    for i, w in live.items():
        out[i] = left * w / sum(live.values())
    return out
