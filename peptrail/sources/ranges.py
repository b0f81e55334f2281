"""FASTA by byte ranges: a data source whose tasks read parts of a file wherever these begin, also within a line.

Spark's text reader ends a split at a line's end, so a chromosome on one line would be one row. Here a partition is a range
of bytes; it yields the range's sequence in pieces of bounded size and all headers that begin in it. Files are opened by
Arrow's file systems (local, HDFS, S3, GCS) on the executors; compressed files, and stores that only Spark's own readers
reach, are for the reader by lines. A header may have HEADER bytes at most.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at once, and the longest header.
CHUNK, HEADER = 1 << 20, 1 << 16
SCHEMA = "file string, split long, piece long, record long, label string, seq string"
_NUCLEOTIDES = bytes(c if chr(c) in "ACGT" else ord("N") for c in range(256))
_WHITE = b" \t\r\n\x0b\x0c"


def opened(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        super().__init__((file, start))
        self.file, self.start, self.stop = file, start, stop


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size, self.bytes = options["path"], int(options["size"]), int(options["bytes"])

    def partitions(self) -> list[Range]:
        from pyarrow.fs import FileSelector, FileType

        files, name = opened(self.path)
        info = files.get_file_info(name)
        found = files.get_file_info(FileSelector(name)) if info.type == FileType.Directory else [info]
        found = sorted((f.path, f.size) for f in found if f.type == FileType.File and not f.base_name.startswith(("_", ".")))
        return [Range(f, at, min(at + self.bytes, size)) for f, size in found for at in range(0, size, self.bytes)]

    def read(self, part: Range) -> Iterator[tuple]:
        files, _ = opened(self.path)
        with files.open_input_file(part.file) as source:
            yield from pieces_of(source, part, self.size)


class FastaSource(DataSource):
    """Options: size (nucleotides to a piece) and bytes (of a range)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def in_header(source, start: int) -> bool:
    """Whether the byte at start lies in a header that began before it."""
    if start == 0:
        return False
    source.seek(max(0, start - HEADER))
    before = source.read(min(start, HEADER))
    line = before[before.rfind(b"\n") + 1 :]
    return line.startswith(b">") and (len(line) < len(before) or start <= HEADER)


def pieces_of(source, part: Range, size: int) -> Iterator[tuple]:
    """file, split, piece, record, label, seq of a range; record counts the headers met in it (0: a record that an earlier range began)."""
    piece, record, label, held = 0, 0, None, bytearray()
    key = part.file, part.start
    rest, inside = b"", in_header(source, part.start)  # an open header line, and whether it began before
    skip, header = inside, inside
    source.seek(part.start)
    at, fresh = part.start, part.start == 0  # fresh: at a line's beginning
    if part.start and not inside:
        source.seek(part.start - 1)
        fresh = source.read(1) == b"\n"

    def cut(all_of_it: bool) -> Iterator[tuple]:
        nonlocal piece, label
        while len(held) >= size or (all_of_it and (held or label is not None)):
            yield *key, piece, record, label, held[:size].decode("ascii")
            piece, label = piece + 1, None
            del held[:size]

    while at < part.stop or header:
        data = source.read(CHUNK if at >= part.stop else min(CHUNK, part.stop - at))
        if not data:
            break
        at += len(data)
        while data:
            if header:
                end = data.find(b"\n")
                rest += data if end < 0 else data[:end]
                data, fresh = (b"" if end < 0 else data[end + 1 :]), end >= 0
                if end >= 0:
                    header = False
                    if not skip:
                        record, label = record + 1, rest[1:].decode("utf-8", "replace").strip()
                    rest, skip = b"", False
                    if at - len(data) >= part.stop:
                        data = b""
                continue
            if fresh and data.startswith(b">"):
                yield from cut(True)
                header = True
                continue
            mark = data.find(b"\n>")
            body = data if mark < 0 else data[: mark + 1]
            data, fresh = data[len(body) :], body.endswith(b"\n")
            text = body.upper().translate(_NUCLEOTIDES, _WHITE)
            if text and not record and part.start == 0:
                raise ValueError(f"sequence before the first > in {part.file}")
            held += text
            yield from cut(False)
    if header and not skip:  # a header that the file's end closes
        record, label = record + 1, rest[1:].decode("utf-8", "replace").strip()
    yield from cut(True)
