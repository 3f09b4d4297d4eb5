"""Recorded files, one report or summary each, as a Spark data source that reads and writes them in tasks.

A row is a file: ``folder`` (below the root, "" for the root itself), ``name`` and ``text``. Reading deals the files to partitions
of about equal bytes; conditions on folder and name are applied to the listing, so other files are not opened.
Writing puts each row into the file it names; a task that runs again writes the same files again.

Millions of small reports cost a block, a directory entry and a round trip each. They can be written as packs: zip archives named
``*.files.zip``, each in the folder its files are below, that readers take for the files in them, loose ones and packs alike.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith,
    StringStartsWith, WriterCommitMessage,
)

FILES = "folder string, name string, text string"
# Bytes of the files a task reads.
PARTITION_BYTES = 16 << 20
PACK = ".files.zip"
# Most files of a pack and bytes of their texts, and bytes of texts handed to Spark at a time.
PACK_FILES, PACK_BYTES, BATCH_BYTES = 20_000, 16 << 20, 4 << 20


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _fits(filter_: Filter, value: dict[str, str]) -> bool:
    held = value[filter_.attribute[0]]
    if isinstance(filter_, EqualTo):
        return held == filter_.value
    if isinstance(filter_, In):
        return held in filter_.value
    return held.startswith(filter_.value) if isinstance(filter_, StringStartsWith) else held.endswith(filter_.value)


class _Reader(DataSourceReader):
    def __init__(self, root: str, partition_bytes: int):
        self.root, self.bytes, self.filters = root, partition_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = (EqualTo, In, StringStartsWith, StringEndsWith)
        for f in filters:
            if isinstance(f, kinds) and f.attribute in (("folder",), ("name",)):
                self.filters.append(f)
            else:
                yield f

    def _place(self, base: str, path: str) -> dict[str, str]:
        folder, _, name = path[len(base) :].strip("/").rpartition("/")
        return {"folder": folder, "name": name}

    def _may_hold(self, folder: str) -> bool:
        """Whether a file that fits the conditions may be in or below a folder."""
        below = lambda v: not folder or v == folder or v.startswith(folder + "/")
        for f in self.filters:
            if f.attribute == ("folder",) and (
                (isinstance(f, EqualTo) and not below(f.value))
                or (isinstance(f, In) and not any(below(v) for v in f.value))
                or (isinstance(f, StringStartsWith) and not folder.startswith(f.value) and not f.value.startswith(folder))
            ):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = _file_system(self.root)
        found = [i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]

        def wanted(path: str) -> bool:
            at = self._place(base, path)
            return self._may_hold(at["folder"]) if path.endswith(PACK) else all(_fits(f, at) for f in self.filters)

        found = [i for i in found if i.base_name[0] not in "._" and wanted(i.path)]
        parts, size = [], self.bytes
        for i in sorted(found, key=lambda i: i.path):
            if size >= self.bytes:
                parts.append([])
                size = 0
            parts[-1].append(i.path)
            # small texts take a tenth of their bytes in a pack
            size += (i.size or 1) * (10 if i.path.endswith(PACK) else 1)
        return [_Files(p) for p in parts] or [_Files([])]

    def _texts(self, paths: list[str]) -> Iterator[tuple]:
        system, base = _file_system(self.root)
        for path in paths:
            at = self._place(base, path)
            if not path.endswith(PACK):
                with system.open_input_stream(path) as f:
                    yield at["folder"], at["name"], f.read().decode("utf-8", "replace")
                continue
            with system.open_input_stream(path) as f:
                whole = io.BytesIO(f.read())  # at most about PACK_BYTES and the names
            with zipfile.ZipFile(whole) as pack:
                for member in pack.infolist():
                    inside = self._place("", f"{at['folder']}/{member.filename}")
                    if all(_fits(c, inside) for c in self.filters):
                        yield inside["folder"], inside["name"], pack.read(member).decode("utf-8", "replace")

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._texts(partition.paths):
            rows.append(row)
            size += len(row[2]) + 100
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["folder", "name", "text"])


def _checked(folder: str, name: str) -> None:
    if ".." in f"{folder}/{name}".split("/") or not name:
        raise ValueError(f"{folder}/{name} is no place below the root")


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, base = _file_system(self.root)
        for row in rows:
            folder = f"{base}/{row['folder']}" if row["folder"] else base
            _checked(folder, row["name"])
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{row['name']}") as f:
                f.write((row["text"] or "").encode())
        return _Written()


@dataclass
class _Packed(WriterCommitMessage):
    hidden: list[str]


class _PackWriter(DataSourceArrowWriter):
    """Packs stay hidden until all tasks are done, so none of a task that failed is read."""

    def __init__(self, root: str, depth: int):
        self.root, self.depth = root, depth

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = _file_system(self.root)
        hidden, at, pack, held, n, size = [], None, None, None, 0, 0

        def close():
            pack.close()
            folder = f"{base}/{at}" if at else base
            system.create_dir(folder, recursive=True)
            hidden.append(f"{folder}/_{uuid.uuid4().hex}{PACK}")
            with system.open_output_stream(hidden[-1]) as f:
                f.write(held.getbuffer())

        for batch in batches:
            for folder, name, text in zip(*[batch.column(c).to_pylist() for c in ("folder", "name", "text")]):
                folder = (folder or "").strip("/")
                _checked(folder, name)
                parts = folder.split("/") if folder else []
                of, inside = "/".join(parts[: self.depth]), "/".join([*parts[self.depth :], name])
                if pack and (of != at or n >= PACK_FILES or size >= PACK_BYTES):
                    close()
                    pack = None
                if not pack:
                    at, held, n, size = of, io.BytesIO(), 0, 0
                    pack = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                data = (text or "").encode()
                # a fixed date: the same rows give the same bytes
                pack.writestr(zipfile.ZipInfo(inside), data, zipfile.ZIP_DEFLATED)
                n, size = n + 1, size + len(data)
        if pack:
            close()
        return _Packed(hidden)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, _ = _file_system(self.root)
        for path in [p for m in messages if m for p in m.hidden]:
            folder, _, name = path.rpartition("/")
            system.move(path, f"{folder}/{name[1:]}")

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, _ = _file_system(self.root)
        for path in [p for m in messages if m for p in m.hidden]:
            system.delete_file(path)


class RecordedFiles(DataSource):
    """``spark.read.format("recorded_files").load(root)`` and ``df.write.format("recorded_files").mode("append").save(root)``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        # Spark gives option names in lower case
        depth = self.options.get("packdepth", self.options.get("packDepth"))
        return _Writer(self.options["path"]) if depth is None else _PackWriter(self.options["path"], int(depth))


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedFiles)


def read_recorded(spark: SparkSession, root: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """folder, name and text of every file below ``root`` but hidden ones."""
    _register(spark)
    return spark.read.format("recorded_files").option("partitionBytes", partition_bytes).load(root)


def write_recorded(files: DataFrame, root: str, pack_depth: int | None = None) -> None:
    """Each row (folder, name, text) as a file below ``root``, written by the tasks. Places must differ between rows.

    ``pack_depth`` writes packs, for many small files: 0 puts them at the root, 1 one or more in each top folder, so that
    conditions on these folders leave the packs of others unopened, and so on. What is read back is the same.
    """
    _register(files.sparkSession)
    rows = files.select("folder", "name", "text")
    if pack_depth is None:
        rows.write.format("recorded_files").mode("append").save(root)
        return
    # small texts: a shuffle would leave them to one task
    spark = files.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, "folder", "name").sortWithinPartitions("folder")
    dealt.write.format("recorded_files").option("packDepth", pack_depth).mode("append").save(root)
