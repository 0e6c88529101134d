"""Files written by executors and put in place by one commit.

    df.write.format("inkspect_files").mode("append").save()

with the columns path and text.  A task writes each file beside its place, under a name of
the job and the attempt.  The commit moves all of them over the old files, each in one step,
when every task is done; a job that fails or is stopped leaves the files as they were.
Names that attempts which were lost have left are swept from the folders that were written.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "inkspect_files"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (where they are, where they belong)."""

    files: list[tuple[str, str]]


def local(path: str) -> str:
    """A path without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/")


class FileWriter(DataSourceArrowWriter):
    def __init__(self, job: str):
        self.job = job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context, done = TaskContext.get(), []
        try:
            for batch in iterator:
                for path, text in zip(batch.column("path").to_pylist(), batch.column("text")):
                    folder, name = os.path.split(local(path))
                    beside = os.path.join(folder, f".{name}.{self.job}.{context.taskAttemptId()}.new")
                    done.append((beside, os.path.join(folder, name)))
                    with open(beside, "xb") as f:
                        f.write((text.as_py() or "").encode())
                        f.flush()
                        os.fsync(f.fileno())
                    if os.path.exists(done[-1][1]):
                        shutil.copymode(done[-1][1], beside)
        except BaseException:
            self._remove(beside for beside, _ in done)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        moved = [pair for m in messages if m for pair in m.files]
        for beside, target in moved:
            os.replace(beside, target)
        self._sweep(moved)

    def abort(self, messages: list[Written | None]) -> None:
        there = [pair for m in messages if m for pair in m.files]
        self._remove(beside for beside, _ in there)
        self._sweep(there)

    @staticmethod
    def _remove(paths) -> None:
        for path in paths:
            if os.path.exists(path):
                os.remove(path)

    def _sweep(self, pairs: list[tuple[str, str]]) -> None:
        for folder in {os.path.dirname(target) for _, target in pairs}:
            self._remove(glob.glob(f"{glob.escape(folder)}/.*.{self.job}.*.new"))


class Files(DataSource):
    """The format; it is written only."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not {"path", "text"} <= set(schema.names):
            raise ValueError("files are written from the columns path and text")
        return FileWriter(uuid.uuid4().hex)


def write_files(rows: DataFrame) -> None:
    """Write each text of (path, text) to its path, on file systems that driver and executors have mounted; all or none.

    A null text is empty.  A path that comes twice gets one of its texts.
    """
    rows.sparkSession.dataSource.register(Files)
    rows.select("path", "text").write.format(FORMAT).mode("append").save()
