"""Rows that a Python class makes, as a Spark data source: each partition makes its own range of them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Generator(ABC):
    """A source of numbered samples. Any sample can be made on its own, so lost partitions are made again."""

    schema: str

    @abstractmethod
    def batch(self, start: int, stop: int) -> pa.RecordBatch:
        """Samples start to stop - 1, columns as in the schema."""


class Counting(Generator):
    """How many times a letter is in a word made from the sample's number."""

    schema = "id bigint, question string, answer int"

    def batch(self, start: int, stop: int) -> pa.RecordBatch:
        numbers = range(start, stop)
        words = [f"{i * 2654435761 % (1 << 32):x}" for i in numbers]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([f"How many 'a' are in {w}?" for w in words]), pa.array([w.count("a") for w in words], pa.int32())], names=["id", "question", "answer"])


def _named(path: str) -> Generator:
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)()


class _Range(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows, self.parts = options["generator"], int(options["rows"]), int(options.get("partitions", "4"))

    def partitions(self) -> list[InputPartition]:
        size = -(-self.rows // self.parts) if self.rows else 0
        return [_Range(i, min(i + size, self.rows)) for i in range(0, self.rows, size)] if size else [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        made = _named(self.path)
        for at in range(partition.start, partition.stop, 4096):
            yield made.batch(at, min(at + 4096, partition.stop))


class GeneratedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brindle_generated"

    def schema(self) -> str:
        return _named(self.options["generator"]).schema

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_generated(spark: SparkSession, generator: str, rows: int, partitions: int = 4) -> DataFrame:
    """`rows` samples of a generator named 'module:Class'."""
    spark.dataSource.register(GeneratedSource)
    return spark.read.format(GeneratedSource.name()).option("generator", generator).option("rows", str(rows)).option("partitions", str(partitions)).load()
