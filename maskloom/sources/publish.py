"""Publishing of files by a data source with two phases: all files appear, or none.

Executors write temporary files into the folder, and tell the driver their names and how many leaks they met. Only if
no task failed and nothing leaks do the files take their names, never over another file; else all temporary files go.
The folder must be one that the driver and the executors share.
"""

from __future__ import annotations

import contextlib
import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from maskloom.sources.sinks import free_path

SCHEMA = "output_name string, content binary, n_leaks long"


@dataclass
class Written(WriterCommitMessage):
    """The temporary files of a task with the names they are to take, and the leaks among its rows."""

    files: list[tuple[str, str]] = field(default_factory=list)
    leaks: int = 0


class _Files(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.run = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        out = Written()
        for row in iterator:
            if row[0] is None or row[1] is None:
                continue
            if row[2]:
                out.leaks += 1
                continue
            path = os.path.join(self.folder, f".{self.run}-{uuid.uuid4().hex}.part")
            with open(path, "xb") as f:
                f.write(bytes(row[1]))
                f.flush()
                os.fsync(f.fileno())
            out.files.append((path, row[0]))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        if leaks := sum(m.leaks for m in done):
            self._clear()
            raise RuntimeError(f"{leaks} files hold values that must not stand there: nothing was published")
        for path, name in sorted((f for m in done for f in m.files), key=lambda f: (f[1], f[0])):
            stem, dot, ext = name.rpartition(".")
            os.replace(path, free_path(self.folder, stem or ext, dot + ext if stem else ""))
        self._clear()  # what tasks left that ran twice

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for path in glob.glob(os.path.join(glob.escape(self.folder), f".{self.run}-*.part")):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)


class PublishedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "maskloom_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Files(self.options["path"])


def published(results: DataFrame, folder: str) -> None:
    """Publishes results that have content (output_name, content and, if there is one, n_leaks) in a folder: all of them, or none."""
    spark = results.sparkSession
    spark.dataSource.register(PublishedFiles)
    leaks = F.col("n_leaks") if "n_leaks" in results.columns else F.lit(0)
    results.where("content is not null").select("output_name", "content", F.coalesce(leaks, F.lit(0)).cast("long").alias("n_leaks")).write.format("maskloom_files").mode("append").save(folder)
