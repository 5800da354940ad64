"""A data source for folders of design files: lines of files as rows, and rows as files, one a design.

    register(spark)
    spark.read.format("design_files").option("ending", ".rev").load(folder)      # design_id, path, file_size, line_no, line, error
    lines.write.format("design_files").option("ending", ".csv").mode("append").save(folder)   # design_id, part, ord, line

Reading, files are dealt out by size, the largest first, each to the partition with the fewest bytes so far, so one large
file has a partition to itself and does not hold up the others. A file that cannot be read is a row with an error.

Writing, a design's rows are in one task and in order (write_files sees to that). A task writes to a folder of its own below
``_temporary``; only when all tasks have succeeded are their files moved to their names. A failed task, or a second file for
one design, leaves none.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.contact_map import ID
from ..session import find_library

FORMAT = "design_files"
#: Bytes of a partition, about, if the number of partitions is not given.
PARTITION_BYTES = 4 << 20
READS = f"{ID} string, path string, file_size long, line_no int, line string, error string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def _name(path: str) -> str:
    """A file's name without its last ending."""
    base = path.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base else base


@dataclass
class Files(InputPartition):
    """Files (path, size) of a partition."""

    files: list[tuple[str, int]] = field(default_factory=list)


def balanced(files: list[tuple[str, int]], parts: int) -> list[list[tuple[str, int]]]:
    """Files (path, size) dealt to so many lists: the largest first, each to the one with the fewest bytes, then the fewest files."""
    out: list[list[tuple[str, int]]] = [[] for _ in range(max(1, min(parts, len(files))))]
    load = [(0, 0, k) for k in range(len(out))]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        at = min(load)
        out[at[2]].append((path, size))
        load[at[2]] = (at[0] + size, at[1] + 1, at[2])
    return out


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.ending = options["path"], options.get("ending", "")
        self.parts = int(options.get("partitions", "0"))

    def partitions(self) -> list[Files]:
        store, base = _store(self.path)
        found = [store.get_file_info(base)] if store.get_file_info(base).is_file else store.get_file_info(fs.FileSelector(base, recursive=False))
        files = [(f.path, f.size) for f in found if f.is_file and f.path.endswith(self.ending) and not f.base_name.startswith(("_", "."))]
        parts = self.parts or -(-sum(size for _, size in files) // PARTITION_BYTES)
        return [Files(files=some) for some in balanced(files, parts)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, size in partition.files:
            name = _name(path)
            try:
                with store.open_input_stream(path) as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError) as e:
                yield name, path, size, None, None, f"{type(e).__name__}: {e}"[:300]
                continue
            lines = text.replace("\r\n", "\n").replace("\r", "\n")
            for k, line in enumerate((lines[:-1] if lines.endswith("\n") else lines).split("\n"), 1):
                yield name, path, size, k, line, None


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: (temporary path, final path)."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool) -> None:
        self.path, self.ending = options["path"], options.get("ending", ".txt")
        self.at, self.job, self.overwrite = {c: k for k, c in enumerate(columns)}, uuid.uuid4().hex, overwrite
        missing = [c for c in (ID, "part", "ord", "line") if c not in self.at]
        if missing:
            raise ValueError(f"rows to write lack {', '.join(missing)}")

    def _temporary(self, base: str) -> str:
        return f"{base.rstrip('/')}/_temporary/{self.job}"

    def write(self, rows: Iterator) -> Written:
        store, base = _store(self.path)
        mine = f"{self._temporary(base)}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        done: list[tuple[str, str]] = []
        seen: set = set()
        out, design, place = None, None, None
        try:
            for row in rows:
                name, now = row[self.at[ID]], (row[self.at["part"]], row[self.at["ord"]])
                if out is None or name != design:
                    if out is not None:
                        out.close()
                    if name is None or name in seen or "/" in str(name):
                        raise ValueError(f"no file can be written for design {name!r}: its rows are apart, or it has no name")
                    seen.add(name)
                    done.append((f"{mine}/{len(done)}", f"{base.rstrip('/')}/{name}{self.ending}"))
                    out, design = store.open_output_stream(done[-1][0]), name
                elif now < place:
                    raise ValueError(f"rows of design {name!r} are not in order")
                place = now
                out.write(f"{row[self.at['line']]}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Written(files=done)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [final for _, final in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one design were in several tasks; use write_files")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True)):
                if f.is_file and f.path.endswith(self.ending):
                    store.delete_file(f.path)
        for temporary, final in files:
            store.move(temporary, final)
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        self._clear(store, base)

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        """Removes this job's folder, and the one above it if no other job has anything there."""
        if store.get_file_info(self._temporary(base)).type != fs.FileType.NotFound:
            store.delete_dir(self._temporary(base))
        above = f"{base.rstrip('/')}/_temporary"
        if store.get_file_info(above).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


class DesignFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> FilesReader:
        return FilesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    find_library(spark)
    spark.dataSource.register(DesignFiles)


def read_files(spark: SparkSession, folder: str, ending: str = "", partitions: int = 0) -> DataFrame:
    """design_id, path, file_size, line_no, line, error of the files of a folder; what readers.rev_tables takes."""
    register(spark)
    options = {"ending": ending} | ({"partitions": str(partitions)} if partitions else {})
    return spark.read.format(FORMAT).options(**options).load(folder)


def write_files(lines: DataFrame, folder: str, ending: str, mode: str = "append") -> None:
    """One file a design from lines (design_id, part, ord, line) in any order, all or none."""
    register(lines.sparkSession)
    at = lines.select(ID, "part", "ord", "line").repartition(ID).sortWithinPartitions(ID, "part", "ord")
    at.write.format(FORMAT).option("ending", ending).mode(mode).save(folder)
