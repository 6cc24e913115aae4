"""Tar shards as a Spark data source, for reading and writing.

Reading: `spark.read.format("brindle_tar").load(path)` gives shard, key, ext, data of every member of the .tar files of a
folder. Planning reads the members' headers and cuts each shard into splits of about `splitBytes` that begin at a member,
so a shard is read by several tasks and may be of any size; a member is one row. Writing: a task writes one shard, of which
the attempt that Spark commits is renamed to its place. Paths are what Arrow's file systems open (local, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "shard string, key string, ext string, data binary"
SPLIT = 64 << 20


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


@dataclass
class Split(InputPartition):
    """The members of a shard whose headers begin in [start, stop)."""

    shard: str
    start: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__(0)


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int, shards: list[str] | None = None) -> None:
        self.path, self.split, self.shards = path, split, shards

    def partitions(self) -> list[Split]:
        if self.shards is None:
            files, root = _opened(self.path)
            named = [f.path for f in files.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if f.path.endswith(".tar")]
        else:
            named = [_opened(shard)[1] for shard in self.shards]
        with ThreadPoolExecutor(16) as pool:
            return [s for found in pool.map(self.splits, sorted(named)) for s in found]

    def splits(self, shard: str) -> list[Split]:
        """Only headers are read; between them the file is sought."""
        files, _ = _opened(self.path)
        found: list[Split] = []
        start = None
        with files.open_input_file(shard) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
            for member in tar:
                if start is None or member.offset - start >= self.split:
                    if start is not None:
                        found.append(Split(shard, start, member.offset))
                    start = member.offset
                tar.members = []  # a shard may have any number of members
        return found if start is None else [*found, Split(shard, start, 1 << 62)]

    def read(self, partition: Split | None) -> Iterator[tuple]:
        if partition is None:  # without shards
            return
        files, _ = _opened(self.path)
        with files.open_input_file(partition.shard) as raw:
            raw.seek(partition.start)
            with tarfile.open(fileobj=raw, mode="r:") as tar:
                for member in tar:
                    if member.offset >= partition.stop:
                        return
                    if member.isfile():
                        key, _, ext = member.name.partition(".")
                        yield partition.shard.rsplit("/", 1)[-1], key, ext, tar.extractfile(member).read()
                    tar.members = []


@dataclass
class Written(WriterCommitMessage):
    made: str
    name: str


class Writer(DataSourceWriter):
    """Rows (key, ext, data) in their order; one shard a task."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        files, root = _opened(self.path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files.create_dir(f"{root}/_attempts")
        made = f"{root}/_attempts/{attempt}.tar"
        with files.open_output_stream(made) as raw, tarfile.open(fileobj=raw, mode="w|") as tar:
            for row in iterator:
                info = tarfile.TarInfo(f"{row['key']}.{row['ext']}")
                info.size = len(row["data"])
                tar.addfile(info, io.BytesIO(row["data"]))
        return Written(made, f"{root}/part-{part:05}-{self.job}.tar")

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        done = [m for m in messages if m is not None]
        for m in done:
            files.move(m.made, m.name)
        with files.open_output_stream(f"{root}/shards.json") as out:
            out.write(json.dumps({"shardlist": [m.name.rsplit("/", 1)[-1] for m in done]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(m.made)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brindle_tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        shards = json.loads(self.options["shards"]) if "shards" in self.options else None
        return Reader(shards[0] if shards else self.options.get("path", ""), int(self.options.get("splitBytes", SPLIT)), shards)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def read(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """Members of the shards of a folder, or of shards by name in one file system."""
    spark.dataSource.register(TarSource)
    if not isinstance(path, str):
        return spark.read.format("brindle_tar").option("splitBytes", split).option("shards", json.dumps(path)).load()
    return spark.read.format("brindle_tar").option("splitBytes", split).load(path)


def write(members: DataFrame, path: str) -> None:
    """members: key, ext, data; a null or empty part of a name is written as it is, null data as empty."""
    members.sparkSession.dataSource.register(TarSource)
    rows = members.selectExpr("coalesce(cast(key as string), '') AS key", "coalesce(cast(ext as string), '') AS ext", "coalesce(cast(data as binary), cast('' as binary)) AS data")
    rows.write.format("brindle_tar").mode("append").save(path)
