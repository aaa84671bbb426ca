"""Change streams as a streaming source: server-sent blocks captured to files, read block by block.

The files of a folder, in the order of their paths, are one stream of bytes: a capture that begins a
new file anywhere, in the middle of a block too. Files only grow at the end of the last one. An offset
is the place (file, byte) behind the last whole block, so a block whose end is not there yet waits for
a later batch, and a restart goes on at the first block that was not committed. Event ids are handed
on as a column: a capture that reconnects may repeat events, and ids tell them apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 16 << 20  # bytes of one task
STEP = 1 << 20    # bytes read at once

_GAP = re.compile(rb"\r?\n\r?\n")


def parse_block(raw: bytes) -> tuple[str | None, str | None, str] | None:
    """(id, event, data) of a block; None without data. Lines of data are joined by line feeds."""
    found: dict[str, str] = {}
    data = []
    for line in raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name in ("id", "event"):
            found[name] = value
    return (found.get("id"), found.get("event"), "\n".join(data)) if data else None


@dataclass
class Files:
    """Files as one stream; places in it count from the start of the first file."""

    folder: str
    names: list[str]
    sizes: list[int]

    @staticmethod
    def listed(folder: str, first: str | None) -> Files:
        """The files from ``first`` on."""
        fs, base = pafs.FileSystem.from_uri(folder)
        found = sorted((i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(base, recursive=True))
                       if i.is_file and not re.search(r"/[_.]", i.path[len(base):]))
        found = [(p, n) for p, n in found if first is None or p >= first]
        return Files(folder, [p for p, _ in found], [n for _, n in found])

    @property
    def end(self) -> int:
        return sum(self.sizes)

    def at(self, place: int) -> tuple[str, int]:
        """File and byte; a place between two files is the end of the earlier."""
        for name, size in zip(self.names, self.sizes, strict=True):
            if place <= size:
                return name, place
            place -= size
        raise ValueError("place beyond the end")

    def read(self, start: int, stop: int) -> bytes:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        out, before = [], 0
        for name, size in zip(self.names, self.sizes, strict=True):
            low, high = max(start - before, 0), min(stop - before, size)
            if low < high:
                with fs.open_input_file(name) as f:
                    f.seek(low)
                    out.append(f.read(high - low))
            before += size
        return b"".join(out)

    def last_gap(self, start: int) -> int:
        """End of the last blank line behind ``start``; ``start`` if there is none."""
        stop = self.end
        while stop > start:
            low = max(start, stop - STEP)
            # a gap may lie across the cut
            gaps = list(_GAP.finditer(self.read(low, min(stop + 3, self.end))))
            if gaps:
                return low + gaps[-1].end()
            stop = low
        return start

    def blocks(self, start: int, stop: int, end: int, whole: bool) -> Iterator[bytes]:
        """Blocks whose first byte lies in [start, stop); ``whole`` says that one may begin at start.

        A block begins at the first byte behind a blank line that is no line end itself, so every
        block belongs to one range however the ranges are cut. All blocks before ``end`` are whole.
        """
        read = at = start if whole else max(0, start - 4)
        held = b""

        def more() -> bool:
            nonlocal held, read
            got = self.read(read, min(read + STEP, end))
            held, read = held + got, read + len(got)
            return bool(got)

        begins = whole
        while True:
            if begins:
                while not (rest := held.lstrip(b"\r\n")) and more():
                    pass
                at, held = at + len(held) - len(rest), rest
                if not held or at >= stop:
                    return
            looked = 0
            while not (gap := _GAP.search(held, looked)):
                looked = max(0, len(held) - 3)
                if not more():
                    return
            if begins and at >= start:
                yield held[:gap.start()]
            at, held, begins = at + gap.end(), held[gap.end():], True


@dataclass
class Range(InputPartition):
    files: Files
    start: int
    stop: int
    end: int
    whole: bool


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range = int(options.get("range", RANGE))
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"file": None, "byte": 0}

    def latestOffset(self) -> dict:
        start = self.known or self.initialOffset()
        files = Files.listed(self.folder, start["file"])
        place = files.last_gap(start["byte"])
        if place == start["byte"]:
            return start
        name, byte = files.at(place)
        self.known = {"file": name, "byte": byte}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start == end:
            return []
        files = Files.listed(self.folder, start["file"])
        before = dict(zip(files.names, [sum(files.sizes[:k]) for k in range(len(files.names))], strict=True))
        low, high = start["byte"], before[end["file"]] + end["byte"]
        cuts = [*range(low, high, self.range), high]
        return [Range(files, a, b, high, a == low) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for raw in partition.files.blocks(partition.start, partition.stop, partition.end, partition.whole):
            if (row := parse_block(raw)) is not None:
                yield row

    def commit(self, end: dict) -> None:
        """The files stay; what was read is in the query's own log."""


class ChangeStream(DataSource):
    """Option ``path``: the folder of captured files. Option ``range``: bytes of one task."""

    @classmethod
    def name(cls) -> str:
        return "change_stream"

    def schema(self) -> str:
        return "id string, event string, data string"

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def read_changes(spark: SparkSession, landing: str, **options: object) -> DataFrame:
    """Stream of (id, event, data), one row per block with data."""
    spark.dataSource.register(ChangeStream)
    reader = spark.readStream.format("change_stream").option("path", landing)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
