"""``spark.read.format("fasta")`` and ``spark.readStream.format("fasta")``: a Python data source for FASTA files.

Files come from the local file system or from a store that Arrow opens by its URI. A plain file is divided into
ranges of bytes, which need no scan: a record belongs to the range in which its '>' stands, and the task of that range
reads on until the record ends. Gzip files are one range. seq_id is the number of the file times 2**40 plus the byte at which the
record starts (in gzip files the byte of its text), so that it rises in the order of files and records. In a stream files are
numbered by a hash of their path, and a file that grows by whole records is read from where it ended before.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's visible files, or of those that a pattern in the last part names; sorted."""
    from pyarrow import fs

    store, own = _store(path)
    folder, _, last = own.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder or ".")) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = store.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(own))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class FastaRange(InputPartition):
    def __init__(self, root: str, path: str, number: int, start: int, stop: int) -> None:
        self.root, self.path, self.number, self.start, self.stop = root, path, number, start, stop


def _ranges(root: str, path: str, number: int, start: int, stop: int, split: int) -> list[FastaRange]:
    if path.endswith(".gz"):
        return [FastaRange(root, path, number, 0, stop)] if not start else []
    return [FastaRange(root, path, number, at, min(at + split, stop)) for at in range(start, stop, split)]


def _lines(source, at: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) from ``at`` on, a chunk at a time."""
    rest = b""
    while chunk := source.read(CHUNK):
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop()
        for line in lines:
            yield at, line
            at += len(line) + 1
    if rest:
        yield at, rest


def _records(part: FastaRange) -> Iterator[tuple[int, str, str]]:
    store, _ = _store(part.root)
    with store.open_input_file(part.path) as raw:
        if part.path.endswith(".gz"):
            lines, stop = _lines(gzip.GzipFile(fileobj=io.BufferedReader(raw)), 0), None
        else:
            # What stands before the first line start of the range belongs to the one before.
            begin = max(part.start - 1, 0)
            raw.seek(begin)
            lines, stop = _lines(raw, begin), part.stop
            if part.start:
                next(lines, None)
        first = hd = None
        body: list[bytes] = []
        for at, line in lines:
            if line.startswith(b">"):
                if hd is not None:
                    yield first, hd, b"".join(body).decode().upper()
                hd = None
                if stop is not None and at >= stop:
                    return
                first, hd, body = at, line[1:].strip().decode(), []
            elif hd is not None:
                body.append(b"".join(line.split()))
        if hd is not None:
            yield first, hd, b"".join(body).decode().upper()


def _rows(part: FastaRange) -> Iterator[tuple[int, str, str]]:
    for at, hd, seq in _records(part):
        if not seq:
            raise ValueError(f"a record has no sequence: {hd}")
        yield (part.number << 40) + at, hd, seq


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return [p for k, (path, size) in enumerate(_files(self.root)) for p in _ranges(self.root, path, k, 0, size, self.split)]

    def read(self, partition):
        return _rows(partition)


class FastaStreamReader(DataSourceStreamReader):
    """Offsets are the bytes of every file; one that has not grown gives no range."""

    def __init__(self, options: dict) -> None:
        self.root, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(_files(self.root))

    def partitions(self, start: dict, end: dict):
        return [p for path, size in sorted(end.items()) for p in _ranges(self.root, path, zlib.crc32(path.encode()) >> 9, start.get(path, 0), size, self.split)]

    def read(self, partition):
        return _rows(partition)


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "seq_id long, hd string, seq string"

    def reader(self, schema):
        return FastaReader(self.options)

    def streamReader(self, schema):
        return FastaStreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FastaDataSource)
