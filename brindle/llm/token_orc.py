"""Token-ID output: ORC files of token ids in ascending document order, with metadata that readers can prune by.

Rows are range-partitioned and sorted by document id before they are tokenised, so each file covers one id range and
each stripe a narrower one. ORC stores the id lists as run-length encoded integers with row indexes, and a Bloom filter
on doc_id lets a point lookup skip stripes. Files can be split at stripes, so reading is parallel within a file.

Nulls, ties and repeats: a null text is an empty document; rows with a null id come first; rows of equal id follow each
other, ordered by text; every row is one document, very long texts included. An empty table gives an empty file set.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import released, shared_path, slices
from brindle.llm.encoding import encoder

FILE_SCHEMA = "part int, doc_id long, local_start long, n_tokens int, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, byte_level: bool = True) -> None:
    """Writes `doc_id, text` as token files. local_start counts the ids before a document within its range `part`."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary, byte_level)
        for batch in slices(batches, 8192, 24):
            ids, bounds = coder.encode(batch.column(1))
            n = batch.num_rows
            out = np.insert(ids, bounds[1:], end_id).astype(np.int32)
            lengths = np.diff(bounds) + 1
            starts = at + np.cumsum(lengths) - lengths
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), batch.column(0), pa.array(starts), pa.array(lengths.astype(np.int32)), lists],
                names=["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            at += int(lengths.sum())

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(released(tokenised), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_positions(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start over all files, n_tokens and the checksum of its ids, from the files alone.

    One number per range goes to the driver (as many as the files), never one per document.
    """
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(sums):
        base[part] = at
        at += sums[part]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            parts = np.asarray(batch.column(0))
            shift = np.fromiter((base[int(p)] for p in parts), np.int64, len(parts))
            view = memoryview(raw.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.asarray(batch.column(2)) + shift), batch.column(3).cast(pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return files.mapInArrow(released(summed), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_orc(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    path = shared_path(spark, "token-orc")
    write_token_orc(docs, path, vocabulary)
    return token_positions(read_token_orc(spark, path))
