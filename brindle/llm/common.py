"""What the training-data operators share: the folder for written tables, Arrow access to texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import scratch

#: A group of more rows than the larger of these, LEAST and a 1/SHARE of all rows, is not joined by a shuffle on its key.
LEAST, SHARE = 500, 10_000
#: Words are runs of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the session names in spark.checkpoint.dir."""
    return scratch(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. One whose files cannot be split among the cores (a single row group) is spread over them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def word_count(text: Column) -> Column:
    """The number of words of a text (null: 0), without Python."""
    return F.coalesce(F.size(F.array_remove(word_array(text), "")), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """Words with empty strings between neighbouring separators; one literal separator lets the JVM split without a regex."""
    return F.split(F.translate(text, SPACES[1:], " " * 5), " ")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Whole texts, nulls as empty strings."""
    return [x or "" for x in column.to_pylist()]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of whole texts, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, mb: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes, so that very long texts do not pile up in a worker.

    Parts of a batch are copied to start at offset 0: some Arrow string kernels misread arrays with an offset.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > mb << 20:
                n //= 2
            part = batch.slice(at, n)
            yield part if n == batch.num_rows else part.take(pa.array(range(n), pa.int32()))
            at += n


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, after which the Python worker gives its free memory back: workers are used again by later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run


def with_group(rows: DataFrame, keys: list[str], *aggregates: Column, total: int, of: DataFrame | None = None) -> DataFrame:
    """rows with aggregates of their key's group in `of` (rows themselves if not given), which has `total` rows.

    Groups above the bound are broadcast, at most SHARE of them; their rows are dealt by a hash of all columns. The other
    groups meet in a shuffle join. So no task gets more than a small share of all rows, whatever a key holds.
    """
    per = (rows if of is None else of).groupBy(*keys).agg(*aggregates, F.count("*").alias("_n"))
    names = [c for c in per.columns if c not in (*keys, "_n")]
    limit = max(LEAST, total // SHARE)
    large = per.where(F.col("_n") > limit).select(*keys, *[F.col(c).alias(f"_large_{c}") for c in names], F.lit(True).alias("_large"))
    # The optimizer folds a constant key away, and with it the dealing; least() of a column stays.
    small = per.where(F.col("_n") <= limit).withColumn("_deal", F.least(F.col("_n"), F.lit(0).cast("long"))).drop("_n")
    marked = rows.join(F.broadcast(large), keys, "left").withColumn("_deal", F.when(F.col("_large"), F.xxhash64(*rows.columns).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    met = marked.join(small.hint("merge"), ["_deal", *keys], "left")
    return met.select(*rows.columns, *[F.coalesce(c, f"_large_{c}").alias(c) for c in names])
