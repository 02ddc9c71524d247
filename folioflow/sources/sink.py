"""A sink of one file a document, with a commit: `df.write.format("document_files").option("path", ...).save()`.

Rows have name and data (text or bytes). Each task writes its files to a folder of its own attempt, and its message names that
folder and how many files it holds. Only the commit makes them visible: it writes the manifest, a small file that lists the
tasks' folders, in one step, and then removes what it doesn't list, among it earlier writes and attempts that failed. A failed
job leaves the manifest, and thus the files that readers see, as they were. Messages are a line a task, whatever the number
of documents.

Any folder that Arrow's file systems reach can be the path; driver and executors must share it. Cases: a null or empty name,
one with a slash, and a name twice in one task are errors, which abort the job; a null data is an empty file; a table
without rows gives an empty manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MANIFEST = "_manifest.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"], schema)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        missing = {"name", "data"} - set(schema.names)
        if missing:
            raise ValueError(f"rows of document files lack {', '.join(sorted(missing))}")
        self.path, self.job = path.rstrip("/"), f"data-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        task = TaskContext.get()
        folder = f"{self.job}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        system, root = opened(f"{self.path}/{folder}")
        system.create_dir(root, recursive=True)
        names: set[str] = set()
        for row in rows:
            name, data = row["name"], row["data"]
            if not name or "/" in name or name in names or name in (".", ".."):
                raise ValueError(f"{name!r} is no name of a file, or is there twice")
            names.add(name)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write((data or "").encode() if isinstance(data, str | None) else bytes(data))
        return Written(folder, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        """Show this job's files, and only these."""
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        parts = sorted((m.folder, m.files) for m in messages if m is not None)
        with system.open_output_stream(f"{root}/.{self.job}.json") as out:
            out.write(json.dumps({"parts": parts}).encode())
        system.move(f"{root}/.{self.job}.json", f"{root}/{MANIFEST}")
        listed = {folder for folder, _ in parts}
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("data-") and info.base_name != self.job:
                system.delete_dir(info.path)
        for info in system.get_file_info(fs.FileSelector(f"{root}/{self.job}", allow_not_found=True)):
            if f"{self.job}/{info.base_name}" not in listed:
                system.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(f"{self.path}/{self.job}")
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


def committed(path: str) -> list[str]:
    """The folders of the files that the last commit shows; none if there was none."""
    system, root = opened(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{root}/{MANIFEST}") as got:
        return [f"{path.rstrip('/')}/{folder}" for folder, files in json.loads(got.read())["parts"] if files]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
