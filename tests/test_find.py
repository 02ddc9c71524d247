import random

import pytest

from folioflow.operators import find
from folioflow.sources.shared import fresh_folder

SCHEMA = "doc_id long, text string, id long, gram string, folder int"


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB éß😀") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "ab", "the end", "THE END THE END"]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(3, "the other", 1, "x", 2)], SCHEMA)
    path = fresh_folder(spark, "trigrams")
    find.build_index(docs, path, folders=8)
    return docs, path, [*enumerate(texts), (3, "the other")]


@pytest.mark.parametrize("needle", ["aba", "the", "The End", "é😀", "b", "ßa ", "nowhere", "abab", "  "])
def test_equals_a_search_of_all_texts(indexed, needle):
    docs, path, texts = indexed
    got = find.find(docs, path, needle, folders=8)
    assert got.columns == [*docs.columns, "first_at", "hits"]
    low = needle.lower()
    want = sorted((i, t.lower().index(low) + 1, t.lower().count(low)) for i, t in texts if t is not None and low in t.lower())
    assert sorted((r.doc_id, r.first_at, r.hits) for r in got.collect()) == want


def test_only_folders_of_the_text_are_read(indexed):
    docs, path, _ = indexed
    found = find.candidates(docs.sparkSession, path, "aba", 8)
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan
    assert scan.metrics().apply("numPartitions").value() == 1 if scan.metrics().contains("numPartitions") else True


def test_nothing_to_index(spark):
    docs, path = spark.createDataFrame([(1, None, 1, "x", 2), (2, "ab", 1, "x", 2)], SCHEMA), fresh_folder(spark, "trigrams")
    find.build_index(docs, path)
    assert find.find(docs, path, "abc").collect() == [] and [r.doc_id for r in find.find(docs, path, "b").collect()] == [2]
