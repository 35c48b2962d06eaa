"""A streaming source for logs that grow while they are read: byte offsets, whole lines only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, value string"
PIECE, CHUNK = 64 << 20, 1 << 20


def _open(path: str):
    """A file of any store that Arrow knows, for reading at any place."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def _listed(folder: str, suffix: str) -> dict[str, int]:
    """The files of a folder, by name, with their sizes."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    head = folder[: len(folder) - len(name)] if folder.endswith(name) else folder.split("://", 1)[0] + "://"
    found = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return {head + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(suffix) and f.base_name[0] not in "._"}


def last_line_end(path: str, size: int, known: int) -> int:
    """The place after the last line end among the first ``size`` bytes, not before ``known``."""
    with _open(path) as f:
        at = size
        while at > known:
            begin = max(known, at - CHUNK)
            f.seek(begin)
            place = f.read(at - begin).rfind(b"\n")
            if place >= 0:
                return begin + place + 1
            at = begin
    return known


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in [begin, end); ``first`` if a line begins at ``begin``."""

    path: str
    begin: int
    end: int
    first: bool


def lines(piece: Piece) -> Iterator[tuple[list[int], list[str]]]:
    """Places and texts of a piece's lines, a chunk at a time; no more than a chunk and one line is held."""
    with _open(piece.path) as f:
        at = piece.begin if piece.first else piece.begin - 1
        f.seek(at)
        held, skipping = b"", not piece.first
        while at < piece.end:
            read = f.read(CHUNK)
            if not read:
                return
            held += read
            if skipping:
                cut = held.find(b"\n")
                if cut < 0:
                    at, held = at + len(held), b""
                    continue
                at, held, skipping = at + cut + 1, held[cut + 1 :], False
            *whole, rest = held.split(b"\n")
            places, texts = [], []
            for line in whole:
                if at >= piece.end:
                    break
                places.append(at)
                texts.append(line.removesuffix(b"\r").decode(errors="replace"))
                at += len(line) + 1
            yield places, texts
            held = rest


class GrowingLogReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file; a line is read once its end is there."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix
        self.ends: dict[str, tuple[int, int]] = {}  # file -> size seen, end of its last whole line

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for path, size in _listed(self.folder, self.suffix).items():
            seen, end = self.ends.get(path, (0, 0))
            if size < end:
                raise ValueError(f"{path} has become shorter: {size} bytes of {end} read before")
            if size > seen:
                self.ends[path] = (size, last_line_end(path, size, end))
        return {path: end for path, (_, end) in self.ends.items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, upto in end.items():
            begin = start.get(path, 0)
            out += [Piece(path, at, min(at + PIECE, upto), at == begin) for at in range(begin, upto, PIECE)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for places, texts in lines(partition):
            if places:
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(places)), pa.array(places, pa.int64()), pa.array(texts)], names=["file", "at", "value"])


class GrowingLog(DataSource):
    """``spark.readStream.format("growing_log").option("path", folder).load()``: (file, at, value), a row a line.

    Unlike the built-in text source, which reads a file once, it reads what was appended since; a torn last line waits
    until its end is written.  Files that match ``suffix`` may be added at any time; a file that becomes shorter is
    an error.  Pieces of 64 MB are read in parallel.  Offsets name each file, so finished files should be moved away.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:  # noqa: N802
        return GrowingLogReader(self.options["path"].rstrip("/"), self.options.get("suffix", ""))


def growing_log(spark, folder: str, suffix: str = ""):
    """The lines of a folder's growing files as a stream."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("path", folder).option("suffix", suffix).load()
