"""A data source of text records that end with a blank line (CoNLL-U) or a line EOS (KNP), read in byte ranges.

A record belongs to the range that its first byte lies in. Whether a record starts at a byte is told by the few bytes
before it, so any cut of a file gives the same records. Line ends may be LF or CRLF; the last record needs no end mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: By kind: the last line of a record, as bytes that follow a line end.
ENDS = {"blank": re.compile(rb"(?<=\n)\r?\n"), "eos": re.compile(rb"(?<=\n)EOS[ \t]*\r?\n")}
#: Bytes that an end can have, and that are read at once; bytes of a range; records of a batch.
LONGEST, CHUNK, RANGE, RECORDS = 64, 1 << 20, 64 << 20, 1024
SCHEMA = pa.schema([("value", pa.string()), ("file", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _starts(file, end_mark: re.Pattern, at: int) -> Iterator[tuple[int, bytes]]:
    """The place of each record from the first that starts at byte `at` or later, and its bytes with its end mark."""
    begin = max(0, at - LONGEST)
    file.seek(begin)
    held, base, looked = b"", begin, 0  # held: bytes from `base` on; ends before `looked` are known
    start = 0 if at == 0 else None
    while True:
        more = file.read(CHUNK)
        held += more
        whole = not more
        for m in end_mark.finditer(held, looked):
            if m.end() == len(held) and not whole:
                break  # the end may go on
            place = base + m.end()
            looked = m.end()
            if start is not None:
                yield start, held[start - base : m.end()]
            if place >= at:
                start = place
        if whole:
            if start is not None and start < base + len(held):
                yield start, held[start - base :]
            return
        drop = (start - base) if start is not None else max(0, len(held) - LONGEST)
        held, base, looked = held[drop:], base + drop, max(0, looked - drop)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.end_mark, self.size = options["path"], ENDS[options.get("ends", "blank")], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        return [Range(f.path, at, min(f.size, at + self.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.size)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is nothing to read
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        values: list[str] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([partition.path] * len(values), pa.string())], schema=SCHEMA)

        with system.open_input_file(partition.path) as file:
            for start, raw in _starts(file, self.end_mark, partition.start):
                if start >= partition.end:
                    break
                text = raw.decode("utf-8", "replace").replace("\r\n", "\n").strip("\n")
                if text:
                    values.append(text)
                if len(values) == RECORDS:
                    yield batch()
                    values = []
        if values:
            yield batch()


class RecordSource(DataSource):
    """Options: path (a file, or a folder read at any depth), ends (blank or eos), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "text_records"

    def schema(self) -> str:
        return "value string, file string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def records(spark: SparkSession, path: str, ends: str, range_bytes: int = RANGE) -> DataFrame:
    """(value, file): the records of the files at path, without end marks' line ends. Files of any size are read in ranges.

    Paths are those that pyarrow's file systems open (local, hdfs, s3, gs), on driver and executors alike. Bytes that are
    not UTF-8 are replaced; empty records are none; an empty folder or file has none, a missing path is an error.
    """
    spark.dataSource.register(RecordSource)
    return spark.read.format("text_records").option("ends", ends).option("rangeBytes", range_bytes).load(path)
