"""Live tail of growing logs as a streaming data source.

An offset holds the size of every log.  A line belongs to the batch in which its line feed
arrives: a reader of the bytes [a, b) goes back to the start of the line that ``a`` stands
in and leaves out what follows the last line feed before ``b``.  So nothing is kept between
batches, a torn last line waits until it is whole, and a batch that is run again gives the
same lines.  A log that has become shorter was truncated and is read from its start.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .pairs import parse_pairs

SCHEMA = "value string, source_path string, block_start bigint, row_id bigint, restarted boolean"
BLOCK = 1 << 20
RANGE = 64 << 20
ROWS = 1000


class Range(InputPartition):
    """Bytes [start, end) of a log; ``restarted`` where they follow a truncation."""

    def __init__(self, path: str, start: int, end: int, restarted: bool):
        self.path, self.start, self.end, self.restarted = path, start, end, restarted


def open_log(path: str):
    """A file of any store pyarrow knows, opened for reading at any place."""
    store, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return store.open_input_file(inside)


def line_start(file, at: int) -> int:
    """Start of the line that the byte ``at`` belongs to."""
    while at > 0:
        low = max(0, at - BLOCK)
        file.seek(low)
        feed = file.read(at - low).rfind(b"\n")
        if feed >= 0:
            return low + feed + 1
        at = low
    return 0


def whole_lines(file, start: int, end: int, *, last: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines whose line feed is one of the bytes [start, end).

    ``last`` adds what follows the last line feed, for a log that nobody writes to any more.
    """
    at = first = line_start(file, start)
    file.seek(at)
    held: list[bytes] = []
    while at < end:
        block = file.read(min(BLOCK, end - at))
        if not block:
            return  # became shorter since it was listed
        at += len(block)
        head, *rest = block.split(b"\n")
        held.append(head)
        for part in rest:
            line = b"".join(held)
            yield first, line
            first += len(line) + 1
            held = [part]
    if last and any(held):
        yield first, b"".join(held)


class TailReader(DataSourceStreamReader):
    def __init__(self, paths: Sequence[str], suffix: str, range_bytes: int):
        self.paths, self.suffix, self.range_bytes = list(paths), suffix, range_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sizes": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        sizes = {}
        for root in self.paths:
            store, inside = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
            scheme = root.split("://")[0] + "://" if "://" in root else ""
            info = store.get_file_info(inside)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(
                fs.FileSelector(inside, recursive=True, allow_not_found=True))
            sizes.update({scheme + f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)})
        return {"sizes": dict(sorted(sizes.items()))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, size in end["sizes"].items():
            seen = start["sizes"].get(path, 0)
            restarted = size < seen
            low = 0 if restarted else seen
            out += [Range(path, a, min(a + self.range_bytes, size), restarted) for a in range(low, size, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        try:
            file = open_log(partition.path)
        except FileNotFoundError:
            return  # gone since it was listed
        with file:
            held: list[tuple[int, bytes]] = []
            size = 0
            for line in whole_lines(file, partition.start, min(partition.end, file.size())):
                held.append(line)
                size += len(line[1])
                if len(held) >= ROWS or size >= BLOCK:
                    yield _rows(partition, held)
                    held, size = [], 0
            if held:
                yield _rows(partition, held)


def _rows(part: Range, lines: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([
        pa.array([x.decode("utf-8", "replace") for _, x in lines], pa.string()), pa.array([part.path] * n, pa.string()),
        pa.array([0] * n, pa.int64()), pa.array([at for at, _ in lines], pa.int64()), pa.array([part.restarted] * n, pa.bool_()),
    ], names=["value", "source_path", "block_start", "row_id", "restarted"])


class TailSource(DataSource):
    """Format ``jsonl_tail``.  Options: ``paths`` (JSON list of folders or files), ``suffix``, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        options = self.options
        return TailReader(json.loads(options["paths"]), options.get("suffix", ".jsonl"), int(options.get("rangeBytes", RANGE)))


def tail_lines(spark: SparkSession, paths: str | Sequence[str], *, suffix: str = ".jsonl", range_bytes: int = RANGE) -> DataFrame:
    """Stream of the whole lines of growing logs, each once: value, source_path, row_id (byte offset).

    ``restarted`` marks lines read anew after their log had become shorter; what was shown
    of it before should then be dropped.  A log that is replaced by one at least as long
    between two polls cannot be told from an appended one, as only sizes are looked at.
    An offset lists all logs, so watch the folders that are still written to.
    """
    spark.dataSource.register(TailSource)
    roots = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.readStream.format("jsonl_tail").option("paths", json.dumps(roots)).option("suffix", suffix)
    return reader.option("rangeBytes", range_bytes).load()


def tail_pairs(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Stream of well-formed pairs of growing logs; blank and malformed lines are left out."""
    return parse_pairs(tail_lines(spark, paths, **options))
