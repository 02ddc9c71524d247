import os

import pytest
from pyspark.sql import functions as F

from folioflow.sources import sink


def shown(path):
    return {os.path.join(f, x).rsplit("/", 1)[1]: open(os.path.join(f, x), "rb").read() for f in sink.committed(path) for x in os.listdir(f)}


def write(spark, df, path):
    sink.register(spark)
    df.write.format("document_files").mode("append").option("path", path).save()


def test_a_commit_shows_one_file_a_document(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sink.committed(path) == []
    rows = [(f"n{i}.md", f"# {i} é", i) for i in range(20)] + [("none.md", None, 0)]
    write(spark, spark.createDataFrame(rows, "name string, data string, other int").repartition(3), path)
    first = shown(path)
    assert first == {n: (d or "").encode() for n, d, _ in rows}
    # a rerun shows the same and leaves no other folder
    write(spark, spark.createDataFrame(rows, "name string, data string, other int").repartition(2), path)
    assert shown(path) == first and len([x for x in os.listdir(path) if x.startswith("data-")]) == 1
    write(spark, spark.createDataFrame([("b", bytearray(b"\x00\xff"))], "name string, data binary"), path)
    assert shown(path) == {"b": b"\x00\xff"}
    write(spark, spark.createDataFrame([], "name string, data string"), path)
    assert shown(path) == {}


@pytest.mark.parametrize("bad", ["a/b", "", None, "n1"])
def test_a_failing_task_leaves_what_was_there(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    write(spark, spark.createDataFrame([("kept", "x")], "name string, data string"), path)
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("y").alias("data")).unionByName(spark.createDataFrame([("n1", "z"), (bad, "z")], "name string, data string").coalesce(1))
    with pytest.raises(Exception, match="no name of a file"):
        write(spark, rows, path)
    assert shown(path) == {"kept": b"x"}
    assert len([x for x in os.listdir(path) if x.startswith("data-")]) == 1


def test_rows_without_the_columns_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="lack data"):
        write(spark, spark.createDataFrame([("a",)], "name string"), str(tmp_path))
