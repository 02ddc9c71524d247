"""Helpers shared by the operators: staged tables, Arrow groups, stable hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python task handles at once; longer single texts are handled alone.
SLICE_BYTES = 1_000_000


#: A folder for sessions of one machine that name none, by application.
_local: dict[str, str] = {}
#: Paths made within each open scratch(), the innermost last.
_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a fresh one if it is unset and all run in one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="folioflow-")
    return _local[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged within, at the end. What is returned from within must not read it any more."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Hand Python tasks batches of about so many bytes in jobs that run within; what is returned from within is no such job."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, at path if it is given, and read it back: it cuts the lineage, and lost executors lose nothing."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most size bytes, or are one row."""
    sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array per row."""
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Call work on the rows of each key, as Arrow, and gather what it returns.

    One stream of sorted batches serves many small groups, so a group costs microseconds. The caller bounds the groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            cuts = boundaries(table, keys)
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                if (out := work(table.slice(a, b - a))) is not None and out.num_rows:
                    yield from out.to_batches()
            rest = table.slice(cuts[-2])
        if rest is not None and rest.num_rows and (out := work(rest.combine_chunks())) is not None and out.num_rows:
            yield from out.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def boundaries(table: pa.Table, keys: list[str]) -> list[int]:
    """Where the groups of a table sorted by integer keys begin, and its length."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return [0, *np.flatnonzero(new).tolist(), n]
