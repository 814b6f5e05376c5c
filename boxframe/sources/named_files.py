"""A Spark data sink of named files: one row is one file, and a failed job leaves none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from boxframe.sources.containers import uri

#: Files that are being written stand below a folder whose name begins so; readers pass it over.
STAGED = "_staged-"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedFileWriter(DataSourceArrowWriter):
    """Tasks write below a staging folder of the job. Only when all are done are their files moved
    to their names, each replacing an older one whole; files of tasks that failed or ran twice are
    named by no message and go with the folder."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        _, root = fs.FileSystem.from_uri(self.path)
        self.root, self.job = root.rstrip("/"), f"{STAGED}{uuid.uuid4().hex}"

    def store(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.path)[0]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder, names, made = self.store(), f"{self.root}/{self.job}/{uuid.uuid4().hex}", [], set()
        for batch in iterator:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name of a file: {name!r}")
                parent = f"{folder}/{name}".rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write(value.encode() if isinstance(value, str) else value or b"")
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, made, kept = self.store(), set(), set()
        store.create_dir(self.root, recursive=True)
        for message in filter(None, messages):
            for name in message.names:
                if name in kept:
                    self.abort(messages)
                    raise ValueError(f"two rows are named {name!r}")
                kept.add(name)
        for message in filter(None, messages):
            for name in message.names:
                parent = f"{self.root}/{name}".rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                store.move(f"{message.folder}/{name}", f"{self.root}/{name}")
        self.abort(messages)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(self.root, recursive=True)):
                if info.is_file and info.path[len(self.root) + 1 :] not in kept:
                    store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self.store(), f"{self.root}/{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class NamedFiles(DataSource):
    """`rows.write.format("named_files").mode("append").save(folder)` of rows (name, value): text or
    bytes, a file each. append replaces files of the same names; overwrite also removes all others.
    A name may hold folders."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, value binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFileWriter(uri(self.options), overwrite)


def write_named(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (name, value) as files; the driver moves each into its place, so they are as many as
    clips or people, not as boxes."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "value").write.format("named_files").mode(mode).save(path)
