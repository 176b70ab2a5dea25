"""A Python data source of zip archives that is read by ranges of entries.

The planner reads each archive's directory, which lies at its end, and cuts the
entries into partitions by their sizes, so an archive of many books is read by
many tasks, each of which opens it and goes to its own entries.  Paths are
those of pyarrow's file systems (local, HDFS, object stores), reached from the
driver and all executors.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class EntryRange(InputPartition):
    """Entries of one archive, by their numbers in its directory."""

    archive: str
    numbers: list[int]


def _opened(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    own, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(own.open_input_file(inside))


def _below(path: str, suffix: str) -> list[str]:
    from pyarrow import fs

    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    own, inside = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)
    host = path[: path.index(inside)] if scheme else ""
    found = own.get_file_info(fs.FileSelector(inside, recursive=True)) if own.get_file_info(inside).type == fs.FileType.Directory else [own.get_file_info(inside)]
    return sorted(host + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"].removeprefix("file://") if options["path"].startswith("file:///") else options["path"], options.get("suffix", "").lower()
        self.size = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[EntryRange]:
        """Ranges of about partitionBytes; an archive that cannot be opened has none."""
        out = []
        for archive in _below(self.path, ".zip"):
            try:
                with _opened(archive) as z:
                    sizes = [(k, i.file_size) for k, i in enumerate(z.infolist()) if not i.is_dir() and i.filename.lower().endswith(self.suffix)]
            except (zipfile.BadZipFile, OSError, ValueError):  # pyarrow reports a seek before the start as a ValueError
                continue
            held, total = [], 0
            for number, size in sizes:
                if held and total + size > self.size:
                    out.append(EntryRange(archive, held))
                    held, total = [], 0
                held.append(number)
                total += size
            if held:
                out.append(EntryRange(archive, held))
        return out or [EntryRange("", [])]

    def read(self, partition: EntryRange) -> Iterator[tuple]:
        if not partition.numbers:
            return
        name = partition.archive.rsplit("/", 1)[-1]
        with _opened(partition.archive) as z:
            entries = z.infolist()
            for number in partition.numbers:
                try:
                    content, error = z.read(entries[number]), None
                except Exception as e:  # noqa: BLE001  any damage of an entry is its own
                    content, error = None, type(e).__name__
                yield name, entries[number].filename, number, content, error


class ArchiveSource(DataSource):
    """archive, entry, number, content and error of the entries of all .zip files below ``path``.

    Options: ``suffix`` of the entries' names, ``partitionBytes``.  An entry that
    cannot be read has no content and the kind of its error.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, entry string, number int, content binary, error string"

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})
