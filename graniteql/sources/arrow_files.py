"""A data source and sink in Python: folders of Arrow files, read batch by batch and written in tasks.

A task writes one file under a name of its own; the driver makes the files of a successful write visible by a list beside
them, and what a failed or repeated task left is in no list. A reader's partition is a run of batches of a file, of about
PART rows. Paths are those of any file system that pyarrow knows; the schema comes from the first file. Filters are not
taken over: Spark 4.1 keeps what a reader was last asked for and would ask it again for a plan without filters.

Defined cases: an empty table is written as files without rows, and read as that; overwriting
replaces the list last, so a reader sees the old rows or the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import from_arrow_schema

#: Rows of a partition, about.
PART = 1_000_000
LIST = "_files.json"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[dict]:
    system, folder = _place(path)
    with system.open_input_stream(f"{folder}/{LIST}") as f:
        return json.loads(f.read())


@dataclass
class Batches(ds.InputPartition):
    file: str
    first: int
    last: int


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[Batches]:
        out = []
        for f in _files(self.path):
            first, rows = 0, 0
            for i, n in enumerate(f["batches"]):
                rows += n
                if rows >= PART or i + 1 == len(f["batches"]):
                    out.append(Batches(f["name"], first, i + 1))
                    first, rows = i + 1, 0
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, folder = _place(self.path)
        with system.open_input_file(f"{folder}/{partition.file}") as f, ipc.open_file(f) as file:
            for i in range(partition.first, partition.last):
                yield file.get_batch(i).select(self.names)


@dataclass
class Written(ds.WriterCommitMessage):
    file: dict | None


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        name, sizes, out = f"part-{uuid.uuid4().hex}.arrow", [], None
        for batch in batches:
            out = out or ipc.new_file(sink := system.open_output_stream(f"{folder}/{name}"), batch.schema)
            out.write_batch(batch)
            sizes.append(batch.num_rows)
        if out is None:
            return Written(None)
        out.close()
        sink.close()
        return Written({"name": name, "batches": sizes})

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        new = [m.file for m in messages if m and m.file]
        old = [] if system.get_file_info(f"{folder}/{LIST}").type == fs.FileType.NotFound else _files(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{LIST}.new") as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        system.move(f"{folder}/{LIST}.new", f"{folder}/{LIST}")
        for f in old if self.overwrite else []:
            system.delete_file(f"{folder}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{folder}/{m.file['name']}")


class ArrowFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrowfiles"

    def schema(self):
        system, folder = _place(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise ValueError("no file to take the schema from; give one")
        with system.open_input_file(f"{folder}/{files[0]['name']}") as f, ipc.open_file(f) as file:
            return from_arrow_schema(file.schema)

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format `arrowfiles` known."""
    spark.dataSource.register(ArrowFiles)
