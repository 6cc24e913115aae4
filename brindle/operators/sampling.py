"""Samples, splits, shuffles and shards by hash order: exact sizes, reproducible, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.batch import in_ranges, with_row_id, with_running


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def sample_exact(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows (all of a smaller table): each task keeps n at most."""
    return df.withColumn("_h", hash_order(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")


def split_exact(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """part 'test' for exactly n rows, 'train' for the rest: the n-th hash is the threshold, nothing is sorted whole."""
    hashed = df.withColumn("_h", F.struct(hash_order(seed, *keys).alias("h"), *[F.col(k) for k in keys]))
    edge = hashed.select("_h").orderBy("_h").limit(n).agg(F.max("_h").alias("_edge"))
    return hashed.join(F.broadcast(edge)).withColumn("part", F.when(F.col("_h") <= F.col("_edge"), "test").otherwise("train")).drop("_h", "_edge")


def split_fraction(df: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    bucket = F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("part", F.when(bucket < share, "test").otherwise("train"))


def shuffle(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """`place` of each row in a seeded permutation."""
    return with_row_id(df.withColumn("_h", hash_order(seed, *keys)), ["_h", *keys], "place").drop("_h")


def shards(df: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """Contiguous shards of `rows` rows; needs no single-task window."""
    placed = with_row_id(df, order, "_place")
    return placed.withColumn("shard", F.floor(F.col("_place") / rows)).drop("_place")


#: Added to every resampling weight, so that each row can be drawn.
LEAST_WEIGHT = 1e-8


def score_weights(df: DataFrame, score: str, how: str, power: float = 2.0, name: str = "weight") -> DataFrame:
    """df with a resampling weight by score: `pow` |score|**power, `max_min` 1 for the extremes and 0 else, `max_random` 0.4 for the greatest and 0.1 else."""
    s = F.col(score)
    if how == "pow":
        return df.withColumn(name, F.pow(F.abs(s), F.lit(power)) + LEAST_WEIGHT)
    ends = df.agg(F.max(score).alias("_top"), F.min(score).alias("_low"))  # one row
    if how == "max_min":
        weight = F.when((s == F.col("_top")) | (s == F.col("_low")), 1.0).otherwise(0.0)
    elif how == "max_random":
        weight = F.when(s == F.col("_top"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"no resampling weight is called {how}")
    return df.join(F.broadcast(ends)).withColumn(name, weight + LEAST_WEIGHT).drop("_top", "_low")


def resample_weighted(df: DataFrame, weight: Column, n: int, seed: int, key: str) -> DataFrame:
    """n draws with replacement by weight; key is unique. A draw is a hashed uniform times the sum of weights.

    Rows are placed at their cumulative weight, in parallel ranges. Rows and draws are then sorted together, in ranges again,
    and each draw takes the last row at or before it; a range hands its last row on to the next. Work is linear in rows and
    draws, however unevenly weights are spread.
    """
    weighted = df.select(F.col(key).alias("_key"), weight.cast("double").alias("_w")).where("_w > 0")
    starts = with_running(weighted, ["_key"], F.col("_w"), "_pos")
    total = weighted.agg(F.sum("_w").alias("_total"))  # one row
    uniform = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), uniform.alias("_u")).join(F.broadcast(total)).select("draw", (F.col("_u") * F.col("_total")).alias("_pos"))
    both = starts.select("_pos", F.lit(0).alias("_kind"), F.struct("_key").alias("_row")).unionByName(draws.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    merged = in_ranges(both, ["_pos", "_kind", "draw"])
    upto = Window.partitionBy("_rid_part").orderBy("_rid_at").rowsBetween(Window.unboundedPreceding, 0)
    # One row per range: the last row of the ranges before it.
    ends = merged.where("_kind = 0").groupBy("_rid_part").agg(F.max_by("_row", "_rid_at").alias("_end"))
    ranges = merged.select("_rid_part").distinct().join(ends, "_rid_part", "left")
    before = ranges.select("_rid_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_rid_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    met = merged.withColumn("_row", F.last("_row", ignorenulls=True).over(upto)).where("_kind = 1").join(F.broadcast(before), "_rid_part")
    chosen = met.select("draw", F.coalesce("_row", "_before")["_key"].alias("_key"))
    return chosen.join(df.withColumn("_key", F.col(key)), "_key").select("draw", *df.columns)
