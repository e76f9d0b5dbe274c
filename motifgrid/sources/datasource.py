"""``spark.read.format("edgelist")``: edge-list text as a batch data source."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 32 << 20


class Block(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class EdgeListReader(DataSourceReader):
    """Byte ranges of a file that every executor can open; a line belongs to the range where it starts."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        size = os.path.getsize(self.path)
        return [Block(self.path, a, min(size, a + BLOCK)) for a in range(0, max(1, size), BLOCK)]

    def read(self, part):
        with open(part.path, "rb") as f:
            f.seek(max(0, part.start - 1))
            if part.start == 0 or f.read(1) != b"\n":
                f.readline()  # the header, or a line that began in the block before
            while f.tell() < part.end and (line := f.readline()):
                fields = line.split()
                if len(fields) >= 2:
                    yield int(fields[0]), int(fields[1])


class EdgeListSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edgelist"

    def schema(self) -> str:
        return "u long, v long"

    def reader(self, schema):
        return EdgeListReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(EdgeListSource)
