"""A sink of whole files under given names: format("named_files").

Rows (name string, content binary) become files root/<name>; folders in names are made. Tasks write into a staging
folder beside the root under names of their own and report a manifest; the driver moves the files to their names when
the job commits, and removes the staging folder when it aborts (readers pass over its name in any case). So a failed job leaves nothing, an
attempt that is lost or runs twice does no harm, and files of other names stay as they are. The root is a path or
URI of a store that all executors reach (pyarrow.fs).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Characters of a manifest that the driver reads at a time.
PIECE = 1 << 20


def store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    root = root.rstrip("/")
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(root, safe=":/%@")) if ":" in root.split("/", 1)[0] else (pafs.LocalFileSystem(), root)


def checked(name: str | None) -> str:
    """A relative name that stays below the root."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"no name for a file: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """A task's manifest: a file with a line "staged name" <tab> "name" for each file."""

    manifest: str
    n: int


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.root = options["path"]
        self.stage = f"_staging-{uuid.uuid4().hex}"

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = store(self.root)
        return fs, root, f"{root}/{self.stage}"

    def write(self, rows: Iterator) -> Written:
        fs, _, staging = self._staging()
        fs.create_dir(staging, recursive=True)
        own, n = uuid.uuid4().hex, 0
        manifest = f"{staging}/{own}.manifest"
        with fs.open_output_stream(manifest) as lines:
            for name, content in rows:
                staged = f"{own}-{n}"
                with fs.open_output_stream(f"{staging}/{staged}") as out:
                    out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
                lines.write(f"{staged}\t{checked(name)}\n".encode())
                n += 1
        return Written(manifest, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root, staging = self._staging()
        made = set()

        def place(line: str) -> None:
            staged, name = line.split("\t", 1)
            folder = f"{root}/{name}".rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            fs.move(f"{staging}/{staged}", f"{root}/{name}")

        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is None:
                    continue
                with fs.open_input_stream(m.manifest) as f:
                    rest = b""
                    while piece := f.read(PIECE):
                        *lines, rest = (rest + piece).split(b"\n")
                        list(pool.map(place, (x.decode() for x in lines)))
        self._remove(fs, staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, staging = self._staging()
        self._remove(fs, staging)

    @staticmethod
    def _remove(fs: pafs.FileSystem, staging: str, tries: int = 50) -> None:
        """Tasks that are being stopped may still write there for a moment."""
        for _ in range(tries):
            try:
                if fs.get_file_info(staging).type == pafs.FileType.NotFound:
                    return
                fs.delete_dir(staging)
            except OSError:
                time.sleep(0.1)


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(self.options)


def write(rows: DataFrame, root: str) -> None:
    """Rows (name, content: text or bytes) as files root/<name>, all of them or none. A file that is there
    is replaced; of rows of one name any one stays."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.selectExpr("name", "cast(content as binary) AS content").write.format("named_files").mode("append").save(root)
