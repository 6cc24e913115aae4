"""Residual k-means: train, encode, decode, loss."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, the smaller one of a tie."""
    return np.argmin((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def train(vectors: DataFrame, vector: str, layers: int, size: int, rounds: int = 10, sample: int = 200_000, seed: int = 42) -> list[np.ndarray]:
    """Codebooks of each layer on the residuals of the layers before, by distributed Lloyd steps.

    Assignments and partial sums run in the tasks; the driver sees `size` sums a round. At most `sample` expected rows
    are used for fitting; encoding covers all rows.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    total = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 20)) < min(1.0, sample / max(total, 1)) * (1 << 20))
    books: list[np.ndarray] = []
    for _ in range(layers):
        first = drawn.orderBy(F.xxhash64("v", F.lit(seed + len(books)))).limit(size).collect()
        centres = _residual(np.array([r["v"] for r in first]), books)
        for _ in range(rounds):
            # The function is read when the job is planned, which is within this round.
            def sums(batches: Iterator[pa.RecordBatch], books=tuple(books), centres=centres) -> Iterator[pa.RecordBatch]:
                total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
                for batch in batches:
                    x = _residual(_matrix(batch.column(0)), books)
                    at = nearest(x, centres)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(centres))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "n", "s"])

            added = drawn.mapInArrow(sums, "i int, n long, s array<double>").groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(d))).alias(f"d{d}") for d in range(centres.shape[1])]).collect()
            for r in added:
                if r["n"]:
                    centres[r["i"]] = np.array([r[f"d{d}"] for d in range(centres.shape[1])]) / r["n"]
        books.append(centres)
    return books


def _residual(x: np.ndarray, books) -> np.ndarray:
    for book in books:
        x = x - book[nearest(x, book)]
    return x


def encode(vectors: DataFrame, key: str, vector: str, books: list[np.ndarray]) -> DataFrame:
    """key, codes: one code per layer."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, codes = _matrix(batch.column(1)), []
            for book in books:
                at = nearest(x, book)
                codes.append(at)
                x = x - book[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.stack(codes, 1).tolist(), pa.list_(pa.int32()))], names=[key, "codes"])

    return vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).mapInArrow(coded, f"{key} long, codes array<int>")


def codebook_table(spark: SparkSession, books: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(layer, i, row.tolist()) for layer, book in enumerate(books) for i, row in enumerate(book)], "layer int, code int, centre array<double>")


def decode(codes: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """key, vector: the sum of the codes' centres."""
    each = codes.select(key, F.posexplode("codes").alias("layer", "code")).join(table, ["layer", "code"])
    parts = each.groupBy(key).agg(F.collect_list("centre").alias("c"))
    return parts.select(key, F.aggregate(F.slice("c", F.lit(2), F.size("c")), F.get("c", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("vector"))


#: Keeps the relative error of a coordinate that is zero on both sides at zero.
EPSILON = 1e-4


def reconstruction_loss(df: DataFrame, vector: str, decoded: str) -> DataFrame:
    """Mean squared error, and mean over all coordinates of the error relative to the larger of both absolute values."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(vector).alias("x"), F.col(decoded).alias("y"))).alias("p")).select("p.x", "p.y")
    return pairs.agg(F.avg(F.pow(F.col("x") - F.col("y"), 2)).alias("mse"), F.avg(F.abs(F.col("x") - F.col("y")) / (F.greatest(F.abs("x"), F.abs("y")) + EPSILON)).alias("relative_l1"))


def vocabulary(spark: SparkSession, size: int, levels: str = "abc") -> DataFrame:
    """place, token: all codes of a level, level after level, then the begin and end tags."""
    codes = spark.range(size * len(levels)).select(F.col("id").alias("place"), F.concat(F.lit("<s_"), F.substring(F.lit(levels), (F.col("id") / size).cast("int") + 1, F.lit(1)), F.lit("_"), (F.col("id") % size).cast("string"), F.lit(">")).alias("token"))
    tags = spark.range(2).select((F.col("id") + size * len(levels)).alias("place"), F.when(F.col("id") == 0, "<|sid_begin|>").otherwise("<|sid_end|>").alias("token"))
    return codes.unionByName(tags)
