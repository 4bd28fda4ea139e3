"""A sink of texts that become files: executors write them, and a folder shows them only after every task has written all of its own.

    <folder>/_writing-<run>/<partition>-<attempt>/<name>     what a task wrote
    <folder>/_writing-<run>/_committed                       the folders of the tasks that count, as JSON, a line each

A task that fails takes its folder with it, and a write that fails takes all of them; nobody reads what an executor that is lost leaves there. Folders of a write that succeeded are moved to their
place by executors, a task folder at a time. A move that dies can be run again: what was moved stays, the rest follows.
"""

from __future__ import annotations

import json
import os
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_texts"
COMMITTED = "_committed"


def file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a URI or a path, and the path in it."""
    return pa_fs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


def _put(files: pa_fs.FileSystem, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as f:
        f.write(data)


def _remove(files: pa_fs.FileSystem, folder: str, tries: int = 20) -> None:
    """Deletes a folder into which other tasks may still write."""
    for _ in range(tries):
        if files.get_file_info(folder).type == pa_fs.FileType.NotFound:
            return
        try:
            files.delete_dir(folder)
        except OSError:
            time.sleep(0.1)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class NamedTexts(DataSource):
    """``df.write.format("named_texts").mode("append").save(folder)`` for rows of a name and a text; ``folder`` is one write's own."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string", "string"]:
            raise ValueError("rows are a name and a text")
        files, root = file_system(self.options["path"])
        files.create_dir(root, recursive=True)
        return TextWriter(self.options["path"])


class TextWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        files, root = file_system(self.folder)
        mine, seen = f"{task.partitionId()}-{task.taskAttemptId()}", set()
        at = posixpath.join(root, mine)
        files.create_dir(at, recursive=False)  # not where the write has been given up in the meantime
        try:
            for name, text in iterator:
                if name is None or text is None or name in ("", ".", "..") or "/" in name:
                    raise ValueError(f"not the name and text of a file: {name!r}")
                if name in seen:
                    raise ValueError(f"several rows have one name: {name}")
                seen.add(name)
                _put(files, posixpath.join(at, name), text.encode())
        except BaseException:
            _remove(files, at)
            raise
        return Written(mine, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.folder)
        lines = [json.dumps([m.folder, m.files]) for m in messages if m is not None]
        _put(files, posixpath.join(root, f"{COMMITTED}.part"), "\n".join(lines).encode())
        files.move(posixpath.join(root, f"{COMMITTED}.part"), posixpath.join(root, COMMITTED))

    def abort(self, messages: list[Written | None]) -> None:
        _remove(*file_system(self.folder))


def _publish(written: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, source = file_system(written)
        place = file_system(target)[1]
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for info in files.get_file_info(pa_fs.FileSelector(posixpath.join(source, folder), allow_not_found=True)):
                    to = posixpath.join(place, info.base_name)
                    try:
                        files.move(info.path, to)
                    except OSError:  # a file system that does not move onto a name that is taken
                        if files.get_file_info(info.path).type == pa_fs.FileType.NotFound:
                            continue  # another attempt has moved it
                        if files.get_file_info(to).type == pa_fs.FileType.NotFound:
                            raise
                        files.delete_file(to)
                        files.move(info.path, to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def _listed(written: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, source = file_system(written)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                names = [info.base_name for info in files.get_file_info(pa_fs.FileSelector(posixpath.join(source, folder), allow_not_found=True))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return run


def publish(spark: SparkSession, written: str, target: str) -> int:
    """Moves the files of a committed write to ``target``, each whole under its name, and returns their number. Can be run again. A name that two
    rows have is an error before anything is moved."""
    files, root = file_system(written)
    with files.open_input_stream(posixpath.join(root, COMMITTED)) as f:
        done = [json.loads(line) for line in f.read().decode().splitlines()]  # a line a task
    if done:
        folders = spark.createDataFrame(done, "folder string, files long").repartition(min(len(done), 1024))
        twice = folders.mapInArrow(_listed(written), "name string").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if names := sorted(r["name"] for r in twice.limit(5).collect()):
            _remove(files, root)
            raise ValueError(f"several rows have one name: {', '.join(names)}")
        folders.mapInArrow(_publish(written, target), "n long").agg(F.sum("n")).collect()
    _remove(files, root)
    return sum(n for _, n in done)


def write_texts(texts: DataFrame, folder: str) -> int:
    """Writes the (name, text) rows as files of ``folder``, which executors must share, and returns their number. Names that a folder holds
    already already are replaced. Two rows of one name, a row without a name or text, and a name that is a path are errors that leave the folder as it was.
    """
    spark = texts.sparkSession
    spark.dataSource.register(NamedTexts)
    written = posixpath.join(folder if ":/" in folder else os.path.abspath(folder), f"_writing-{uuid.uuid4().hex}")
    texts.write.format(FORMAT).mode("append").save(written)
    return publish(spark, written, folder)
