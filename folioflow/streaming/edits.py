"""Event-driven behaviour as Structured Streaming: bursts of edits, import progress, last-opened times."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def settled_edits(edits: DataFrame, pause: str = "60 milliseconds", late: str = "10 seconds") -> DataFrame:
    """doc, source, settled_at: the last edit (by seq) of each burst; a burst ends when a pause passes without one."""
    return (
        edits.withWatermark("ts", late)
        .groupBy("doc", F.session_window("ts", pause).alias("burst"))
        .agg(F.max_by("source", "seq").alias("source"), F.count("*").alias("edits"))
        .select("doc", "source", "edits", F.col("burst.end").alias("settled_at"))
    )


def import_progress(events: DataFrame) -> DataFrame:
    """import_id, fraction, done: progress never goes back."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    return events.groupBy("import_id").agg(F.max(held).alias("fraction")).withColumn("done", F.col("fraction") >= 1.0)


def width_changes(widths: DataFrame, least: float = 0.5) -> DataFrame:
    """view, width: the last width of each view in a micro-batch, where it moved by more than `least` since the one told before.

    widths has view, seq and width. A view's state is one number.
    """

    def step(key, frames, state: GroupState):
        last = None
        for frame in frames:
            row = frame.loc[frame["seq"].idxmax()]
            if last is None or row["seq"] > last["seq"]:
                last = row
        before = state.get[0] if state.exists else 0.0
        if last is not None and abs(last["width"] - before) > least:
            state.update((float(last["width"]),))
            yield pd.DataFrame({"view": [key[0]], "width": [float(last["width"])]})

    return widths.groupBy("view").applyInPandasWithState(step, "view string, width double", "width double", "append", GroupStateTimeout.NoTimeout)


BLOCKS = "array<struct<loc:bigint,len:bigint>>"


def reveal(selections: DataFrame, layout: DataFrame) -> DataFrame:
    """doc, seq, loc, len, change (1 or -1) for a stream of selections (doc, seq, loc, len): blocks of layout (doc, loc, len) that become active or no longer are.

    The state of a document is its last active blocks, and the number of the selection they belong to; selections of a
    micro-batch are taken in order, and those older than the state are passed over. Nothing is told where nothing changes.
    """
    blocks = layout.where("loc IS NOT NULL AND len >= 0").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("loc", "len"))).alias("blocks"))
    end = F.col("loc") + F.col("len")
    touched = F.filter("blocks", lambda b: (b["loc"] <= end) & (b["loc"] + b["len"] >= F.col("loc")))
    active = selections.join(blocks, "doc", "left").select("doc", "seq", F.coalesce(touched, F.array().cast(BLOCKS)).alias("active"))
    kind = selections.schema["doc"].dataType.simpleString()

    def step(key, frames, state: GroupState):
        last, before = state.get if state.exists else (None, [])
        before, out = {tuple(b) for b in before}, []
        rows = sorted((int(seq), {(int(b["loc"]), int(b["len"])) for b in found}) for frame in frames for seq, found in zip(frame["seq"], frame["active"], strict=True))
        for seq, now in rows:
            if last is not None and seq <= last:
                continue
            out += [(key[0], seq, *b, 1) for b in sorted(now - before)] + [(key[0], seq, *b, -1) for b in sorted(before - now)]
            last, before = seq, now
        state.update((last, [list(b) for b in sorted(before)]))
        if out:
            yield pd.DataFrame(out, columns=["doc", "seq", "loc", "len", "change"])

    return active.groupBy("doc").applyInPandasWithState(step, f"doc {kind}, seq long, loc long, len long, change int", "last long, active array<array<long>>", "append", GroupStateTimeout.NoTimeout)


ATTEMPTED = "path string, arrival long, source string, attempts int, data string, error string"


def attempted(files: DataFrame, convert: Callable[[str, str | None], str]) -> DataFrame:
    """files (path, arrival, source, attempts) with data, or the error that convert raised for that file; an error touches no other file."""

    def run(frames):
        for frame in frames:
            data, errors = [], []
            for path, source in zip(frame["path"], frame["source"], strict=True):
                try:
                    data.append(convert(path, source))
                    errors.append(None)
                except Exception as error:  # whatever a converter raises is this file's error
                    data.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield frame.assign(attempts=frame["attempts"] + 1, data=data, error=errors)

    return files.select("path", F.col("arrival").cast("long").alias("arrival"), "source", F.col("attempts").cast("int").alias("attempts")).mapInPandas(run, ATTEMPTED)


class Imports:
    """Imports of a stream of files, in micro-batches, that can be watched and cancelled.

    Each batch writes the folders done/v<batch>, retry/v<batch> and dead/v<batch> below a folder: what was converted, in order
    of arrival, what failed and will be tried again with the next batch, and what failed `attempts` times. A batch that runs
    again writes the same. Cancelling interrupts the running batch's jobs and starts no other; committed batches stay, and
    starting anew with the same checkpoint goes on where it stopped.
    """

    def __init__(self, files: DataFrame, convert: Callable[[str, str | None], str], folder: str, checkpoint: str, attempts: int = 3):
        self.spark, self.convert, self.folder, self.attempts = files.sparkSession, convert, folder, attempts
        self.tag, self.cancelled, self.told = f"imports-{uuid.uuid4().hex}", threading.Event(), {}
        watched = files.observe(self.tag, F.count(F.lit(1)).alias("files"), F.max("arrival").alias("arrival"))
        imports = self

        class Watch(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                row = event.progress.observedMetrics.get(imports.tag)
                if row is not None:
                    imports.told[event.progress.batchId] = row.asDict()

            def onQueryTerminated(self, event) -> None:
                pass

        self.watch = Watch()
        self.spark.streams.addListener(self.watch)
        self.query = watched.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def batch(self, rows: DataFrame, number: int) -> None:
        if self.cancelled.is_set():
            raise InterruptedError("imports were cancelled")
        session = rows.sparkSession
        session.addTag(self.tag)
        try:
            due = rows.select("path", "arrival", "source", F.lit(0).alias("attempts"))
            if number:
                due = due.unionByName(session.read.schema(ATTEMPTED).parquet(f"{self.folder}/retry/v{number - 1}").select(due.columns))
            self.write(due, number)
        finally:
            session.removeTag(self.tag)

    def write(self, due: DataFrame, number: int) -> None:
        """One attempt at each file; converted texts are kept once, so that no file is converted twice for its three outcomes."""
        path = f"{self.folder}/tried/v{number}"
        attempted(due, self.convert).write.mode("overwrite").parquet(path)
        tried = due.sparkSession.read.schema(ATTEMPTED).parquet(path)
        failed = F.col("error").isNotNull()
        ordered = lambda df, name: df.sortWithinPartitions("arrival").write.mode("overwrite").parquet(f"{self.folder}/{name}/v{number}")
        ordered(tried.where(failed & (F.col("attempts") >= self.attempts)), "dead")
        ordered(tried.where(failed & (F.col("attempts") < self.attempts)), "retry")
        ordered(tried.where(~failed), "done")

    def progress(self) -> dict:
        """Batches and files taken so far."""
        return {"batches": len(self.told), "files": sum(row["files"] for row in self.told.values())}

    def cancel(self) -> None:
        self.cancelled.set()
        self.spark.interruptTag(self.tag)
        self.query.stop()
        self.spark.streams.removeListener(self.watch)

    def wait(self, seconds: int) -> bool:
        """Whether all is imported in time; what still failed is tried again, batch by batch, as often as it may be."""
        if not self.query.awaitTermination(seconds):
            return False
        self.spark.streams.removeListener(self.watch)
        numbers = self.numbers()
        while numbers and not self.cancelled.is_set():
            left = self.spark.read.schema(ATTEMPTED).parquet(f"{self.folder}/retry/v{numbers[-1]}")
            if left.isEmpty():
                break
            self.write(left.select("path", "arrival", "source", "attempts"), numbers[-1] + 1)
            numbers.append(numbers[-1] + 1)
        return True

    def numbers(self) -> list[int]:
        """The batches that are done, in order."""
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        system = where.getFileSystem(context._jsc.hadoopConfiguration())
        if not system.exists(where):
            return []
        return sorted(int(x.getPath().getName()[1:]) for x in system.listStatus(where))

    def table(self, name: str) -> DataFrame:
        """done or dead: the rows of all batches."""
        return self.spark.read.schema(ATTEMPTED).parquet(*[f"{self.folder}/{name}/v{n}" for n in self.numbers()])


def import_queue(paths: DataFrame, convert: Callable[[DataFrame], DataFrame], done: str, failed: str, checkpoint: str) -> StreamingQuery:
    """Imports of files in micro-batches by a relational conversion, whose error rows go to the folder `failed` while the rest goes on; see Imports for converters that raise.

    convert makes path, data, error_code of a batch. Each batch has its own folder, so that one that runs again writes the
    same. Stopping the query (or interrupting its tag) cancels what has not begun.
    """

    def run(batch: DataFrame, number: int) -> None:
        made = convert(batch).persist()
        try:
            made.where("error_code IS NULL").write.mode("overwrite").parquet(f"{done}/v{number}")
            made.where("error_code IS NOT NULL").write.mode("overwrite").parquet(f"{failed}/v{number}")
        finally:
            made.unpersist()

    return paths.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_last_opened(opened: DataFrame, path: str, checkpoint: str, known: DataFrame | None = None, keep: int = 2) -> StreamingQuery:
    """A table of the last time each path was opened, as a Parquet folder a batch; with known (path), of those paths only.

    Every batch merges into a new folder, path/v<batch>, from the one before, so that a batch that runs again writes the
    same rows and readers never see half a table. The last `keep` folders stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("path").agg(F.max("opened").alias("opened"))
        if number:
            before = batch.sparkSession.read.parquet(f"{path}/v{number - 1}")
            rows = rows.unionByName(before).groupBy("path").agg(F.max("opened").alias("opened"))
        if known is not None:
            rows = rows.join(known.select("path").distinct(), "path", "left_semi")
        rows.write.mode("overwrite").parquet(f"{path}/v{number}")
        if number >= keep:
            context = batch.sparkSession.sparkContext
            old = context._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - keep}")
            old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)

    return opened.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
