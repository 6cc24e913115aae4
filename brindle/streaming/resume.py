"""Samples exactly once over stops and restarts, by one bit per sample.

A sample is (file, epoch, index). What is done is a table of bitmaps: a row per (file, epoch, bucket), a bit for each of the
bucket's 32,768 indexes, so state is bounded by the number of samples in bits and no row of it is large. Each micro-batch
writes its rows and then its own bits; a repeated micro-batch overwrites both. A new run, which replays its input from the
start, begins with the bits of all runs before it; of a micro-batch that was stopped between rows and bits, the bits are
taken from its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = "file string, epoch long, bucket long, bits binary"


def _named(samples: DataFrame, file: str, epoch: str, index: str) -> DataFrame:
    number = F.col(index).cast("long") + 1
    named = samples.withColumn("_file", F.col(file).cast("string")).withColumn("_epoch", F.col(epoch).cast("long"))
    return named.withColumn("_bucket", F.bitmap_bucket_number(number)).withColumn("_bit", F.bitmap_bit_position(number))


def done_bits(samples: DataFrame, file: str = "file", epoch: str = "epoch", index: str = "index") -> DataFrame:
    """file, epoch, bucket, bits of samples whose index is not null and not negative."""
    named = _named(samples, file, epoch, index).where(F.col(index) >= 0)
    return named.groupBy(F.col("_file").alias("file"), F.col("_epoch").alias("epoch"), F.col("_bucket").alias("bucket")).agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merged(bits: DataFrame) -> DataFrame:
    return bits.groupBy("file", "epoch", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def done_count(bits: DataFrame) -> Column:
    return F.sum(F.bitmap_count("bits"))


def unseen(samples: DataFrame, done: DataFrame, file: str = "file", epoch: str = "epoch", index: str = "index") -> DataFrame:
    """Samples that are not done, each once; done holds one row per bucket."""
    named = _named(samples.where(F.col(index) >= 0).dropDuplicates([file, epoch, index]), file, epoch, index)
    held = done.select(*[F.col(c).alias(f"_done_{c}") for c in ("file", "epoch", "bucket", "bits")])
    met = named.join(held, [F.col(f"_{c}").eqNullSafe(F.col(f"_done_{c}")) for c in ("file", "epoch", "bucket")], "left")
    byte = F.conv(F.hex(F.substr(F.col("_done_bits"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1
    return met.withColumn("_byte", F.coalesce(byte, F.lit(0))).where(~is_set).select(*samples.columns)


class Ledger:
    """The rows and bits of all runs below a path in the shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, file: str = "file", epoch: str = "epoch", index: str = "index") -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, (file, epoch, index)

    def _read(self, what: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], f"{schema}, run int, batch long")
        return self.spark.read.schema(f"{schema}, run int, batch long").parquet(f"{self.path}/{what}")

    def rows(self) -> DataFrame:
        """All samples given so far, with the run and micro-batch that gave them."""
        return self._read("rows", self.schema)

    def bits(self) -> DataFrame:
        return self._read("bits", BITS)

    def begin(self) -> int:
        """Numbers a new run and writes the bits of all runs before it as its first state."""
        rows, bits = self.rows(), self.bits()
        last = [x.agg(F.max("run").alias("n")).first()["n"] for x in (rows, bits)]
        run = max((n for n in last if n is not None), default=-1) + 1
        stopped = rows.join(bits.select("run", "batch").distinct(), ["run", "batch"], "left_anti")
        whole = merged(bits.select("file", "epoch", "bucket", "bits").unionByName(done_bits(stopped, *self.keys)))
        whole.write.mode("overwrite").parquet(f"{self.path}/bits/run={run}/batch=-1")
        return run

    def take(self, samples: DataFrame, run: int, batch: int) -> None:
        """One micro-batch: gives what no earlier run or micro-batch gave. A repeat overwrites."""
        done = merged(self.bits().where((F.col("run") == run) & (F.col("batch") < batch)).select("file", "epoch", "bucket", "bits"))
        unseen(samples, done, *self.keys).write.mode("overwrite").parquet(f"{self.path}/rows/run={run}/batch={batch}")
        given = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/run={run}/batch={batch}")
        done_bits(given, *self.keys).write.mode("overwrite").parquet(f"{self.path}/bits/run={run}/batch={batch}")

    def drain(self, stream: DataFrame, run: int, stop_after: int | None = None) -> None:
        """Takes everything that is available now. The run's own checkpoint lets the same run go on after a failure."""

        def put(batch: DataFrame, number: int) -> None:
            self.take(batch, run, number)
            if stop_after is not None and number >= stop_after:
                raise RuntimeError("stopped")

        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.path}/state/run={run}").trigger(availableNow=True).start()
        query.awaitTermination()
