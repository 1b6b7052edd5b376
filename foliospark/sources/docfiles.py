"""A sink of one file a document: ``df.write.format("document_files")``.

Rows are ``name, content`` (text); options: ``path`` (any address that Arrow's file systems know) and ``flat``. Executors write
their rows into a folder of their own attempt below ``.staging``. The driver publishes: it moves the folders of the
attempts that Spark has committed, one move a partition (with ``flat`` one a file, for few documents), and drops the rest. So a
task that fails and is repeated, or runs twice, leaves neither half a file nor a second one, and a failed job leaves nothing.

A null name or content writes nothing. Names must be unique; slashes in them become underscores. ``overwrite``
empties the folder when the new files are complete, ``append`` adds to it (of one name the later file counts where ``flat`` is set).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = ".staging"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentFilesWriter:
        return DocumentFilesWriter(self.options["path"], self.options.get("flat", "false").lower() == "true", overwrite)


class DocumentFilesWriter(DataSourceWriter):
    def __init__(self, path: str, flat: bool, overwrite: bool):
        self.path, self.flat, self.overwrite, self.job = path, flat, overwrite, uuid.uuid4().hex
        system, root = self._at()
        system.create_dir(f"{root}/{STAGING}/{self.job}", recursive=True)

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Attempt:
        system, root = self._at()
        folder, n = f"{STAGING}/{self.job}/{uuid.uuid4().hex}", 0
        for row in iterator:
            name, content = row
            if name is None or content is None:
                continue
            if not n:
                system.create_dir(f"{root}/{folder}", recursive=False)  # fails for a task that outlives its aborted job
            with system.open_output_stream(f"{root}/{folder}/{name.replace('/', '_')}") as out:
                out.write(content.encode())
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, root = self._at()
        if self.overwrite:
            old = [i.path for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not i.path.endswith(f"/{STAGING}")]
            for path in old:
                system.delete_dir(path) if system.get_file_info(path).type == fs.FileType.Directory else system.delete_file(path)
        for number, attempt in enumerate(m for m in messages if m is not None and m.files):
            source = f"{root}/{attempt.folder}"
            if self.flat:
                for info in system.get_file_info(fs.FileSelector(source)):
                    system.move(info.path, f"{root}/{info.base_name}")
            else:
                system.move(source, f"{root}/part-{number:05d}-{self.job[:12]}")
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = self._at()
        staged = f"{root}/{STAGING}/{self.job}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)
        left = f"{root}/{STAGING}"
        if system.get_file_info(left).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(left)):
            system.delete_dir(left)
