import datetime as dt

from folioflow.streaming import edits

T0 = dt.datetime(2024, 1, 1)


def test_bursts_settle(spark, tmp_path):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    rows = [(1, 1, "a", at(0)), (1, 2, "ab", at(40)), (1, 3, "abc", at(90)), (1, 4, "abcd", at(500)), (2, 1, "x", at(10)), (3, 1, "end", at(60_000))]
    spark.createDataFrame(rows, "doc long, seq long, source string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc long, seq long, source string, ts timestamp").parquet(str(tmp_path / "in"))
    query = edits.settled_edits(stream).writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.doc, r.source, r.edits) for r in spark.table("settled").collect())
    assert got == [(1, "abc", 3), (1, "abcd", 1), (2, "x", 1)]


def test_progress_never_goes_back(spark, tmp_path):
    rows = [(1, 0.2), (1, 0.1), (1, 1.7), (2, -1.0), (2, 0.4)]
    spark.createDataFrame(rows, "import_id long, fraction double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("import_id long, fraction double").parquet(str(tmp_path / "in"))
    edits.import_progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {r.import_id: (r.fraction, r.done) for r in spark.table("progress").collect()} == {1: (1.0, True), 2: (0.4, False)}


def test_last_opened_merges(spark, tmp_path):
    schema = "path string, opened timestamp"
    for k, rows in enumerate([[("a", T0), ("b", T0)], [("a", T0 + dt.timedelta(1)), ("c", T0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        edits.keep_last_opened(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out" / f"v{k}")).count() == 2 + k
    assert {r.path: r.opened for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()} == {"a": T0 + dt.timedelta(1), "b": T0, "c": T0}


def revealed_by(changes, upto):
    """The blocks that are active once all changes up to a selection are added up."""
    total = {}
    for doc, seq, loc, size, change in changes:
        if seq <= upto:
            total[(doc, loc, size)] = total.get((doc, loc, size), 0) + change
    assert set(total.values()) <= {0, 1}
    return {k for k, n in total.items() if n}


def test_changes_of_a_stream_add_up_to_the_active_blocks(spark, tmp_path):
    import random

    from folioflow.operators import ranges

    rng = random.Random(4)
    layout = [(d, k * 10, rng.choice([0, 4, 9, 15])) for d in range(3) for k in range(30)] + [(0, None, 3), (7, 0, 5)]
    picks = [(d, seq, rng.randrange(-5, 330), rng.choice([0, 0, 3, 700])) for d in range(4) for seq in range(25)]
    blocks = spark.createDataFrame(layout, "doc long, loc long, len long")
    schema = "doc long, seq long, loc long, len long"
    for part in ([p for p in picks if p[1] < 12], [p for p in picks if p[1] >= 12]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = edits.reveal(stream, blocks).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    joined = sorted(map(tuple, ranges.reveal_changes(spark.createDataFrame(picks, schema), blocks).collect()))
    assert streamed == joined
    for seq in (0, 5, 11, 12, 24):
        want = {(d, b[1], b[2]) for d, s, loc, size in picks if s == seq for b in set(layout) if b[0] == d and b[1] is not None and b[1] <= loc + size and b[1] + b[2] >= loc}
        assert revealed_by(joined, seq) == want


def failing(path, source):
    if path.endswith("3") or source is None:
        raise ValueError(f"no {path}")
    return source.upper()


FILES = "path string, arrival long, source string"


def test_one_failing_file_of_ten_leaves_nine(spark, tmp_path):
    rows = [(f"f{i}", 10 - i, "text") for i in range(10)]
    spark.createDataFrame(rows, FILES).coalesce(1).write.parquet(str(tmp_path / "in"))
    imports = edits.Imports(spark.readStream.schema(FILES).parquet(str(tmp_path / "in")), failing, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert imports.wait(120)
    done, dead = imports.table("done").collect(), imports.table("dead").collect()
    assert sorted(r.path for r in done) == [f"f{i}" for i in range(10) if i != 3] and {r.data for r in done} == {"TEXT"}
    assert [(r.path, r.attempts, r.error) for r in dead] == [("f3", 3, "ValueError: no f3")]
    assert [r.arrival for r in spark.read.parquet(str(tmp_path / "out" / "done" / "v0")).coalesce(1).collect()] == sorted(r.arrival for r in done)
    assert imports.progress() == {"batches": 1, "files": 10}


def slow(path, source):
    import time

    time.sleep(1.5)
    return source


def test_cancelled_imports_keep_their_batches_and_go_on_later(spark, tmp_path):
    import time

    for i in range(6):
        spark.createDataFrame([(f"g{i}", i, "x")], FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    imports = edits.Imports(stream, slow, str(tmp_path / "out"), str(tmp_path / "cp"))
    until = time.monotonic() + 120
    while not imports.progress()["batches"] and time.monotonic() < until:
        time.sleep(0.1)
    imports.cancel()
    assert not imports.query.isActive
    kept = imports.numbers()
    assert 1 <= len(kept) < 6
    before = {r.path: r.data for r in imports.table("done").collect()}
    again = edits.Imports(stream, slow, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert again.wait(120)
    after = {r.path: r.data for r in again.table("done").collect()}
    assert len(after) == 6 and before.items() <= after.items()
    assert again.table("done").count() == 6
