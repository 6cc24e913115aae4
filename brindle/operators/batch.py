"""Batch algebra on rows with an explicit, dense `row_id`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import scratch


def in_ranges(df: DataFrame, order: list[str], part: str = "_rid_part", at: str = "_rid_at") -> DataFrame:
    """df sorted in ranges: `part` numbers a row's range in the given order, `at` its place there.

    The placed rows are written once and read back. Both numbers come from that one run: planned again, a range
    partitioning may sample other bounds and coalesce other ranges, and rows would change their range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = scratch(df.sparkSession, "ranges")
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def range_bases(ranges: DataFrame, total: Column, base: str = "_rid_base", part: str = "_rid_part") -> DataFrame:
    """Per range the sum of `total` over the ranges before it. One row per range, so it may be broadcast."""
    sums = ranges.groupBy(part).agg(total.alias("_rid_n"))
    before = F.sum("_rid_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select(part, F.coalesce(before, F.lit(0)).alias(base)))


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Dense ids from 0 in the given order: ranges are sorted in parallel, and only one count per range meets in a task.

    Rows of equal keys share a range; an order that ends in a unique key deals evenly and does not change from run to run.
    """
    placed = in_ranges(df, order)
    return placed.join(range_bases(placed, F.count("*")), "_rid_part").withColumn(name, F.col("_rid_base") + F.col("_rid_at")).drop("_rid_part", "_rid_at", "_rid_base")


def with_running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """`name`: the sum of value over the rows before a row in the given order, summed up in parallel ranges."""
    placed = in_ranges(df.withColumn("_value", value), order)
    ahead = Window.partitionBy("_rid_part").orderBy("_rid_at").rowsBetween(Window.unboundedPreceding, -1)
    based = placed.join(range_bases(placed, F.sum("_value")), "_rid_part")
    return based.withColumn(name, F.col("_rid_base") + F.coalesce(F.sum("_value").over(ahead), F.lit(0))).drop("_rid_part", "_rid_at", "_rid_base", "_value")


def take_slice(df: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop."""
    return df.where((F.col("row_id") >= start) & (F.col("row_id") < stop) & (F.pmod(F.col("row_id") - start, F.lit(step)) == 0))


def pop(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The named columns as a batch of their own, and the batch without them."""
    if missing := [c for c in columns if c not in df.columns or c == "row_id"]:
        raise ValueError(f"the batch has no column {', '.join(missing)}")
    return df.select("row_id", *columns), df.drop(*columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names, which must not clash."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"the batch has no column {', '.join(missing)}")
    new = [names.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError("two columns would have one name")
    return df.toDF(*new)


def take_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows in the order and number that `ids` (new_id, row_id) names."""
    return df.join(ids, "row_id").drop("row_id").withColumnRenamed("new_id", "row_id")


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both by row_id; sizes must agree and shared columns must be equal, else the query fails."""
    shared = [c for c in a.columns if c in b.columns and c != "row_id"]
    left = a.withColumn("_l", F.lit(1))
    right = b.withColumnsRenamed({c: f"_r_{c}" for c in shared}).withColumn("_r", F.lit(1))
    both = left.join(right, "row_id", "full")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = both.withColumn("row_id", F.when(same, F.col("row_id")).otherwise(F.raise_error(F.lit("batches differ in size or in a shared column"))))
    return checked.drop("_l", "_r", *[f"_r_{c}" for c in shared])


def concat(*batches: tuple[DataFrame, int]) -> DataFrame:
    """Batches of known sizes one after the other."""
    out, at = None, 0
    for df, n in batches:
        moved = df.withColumn("row_id", F.col("row_id") + at)
        out = moved if out is None else out.unionByName(moved)
        at += n
    return out


def chunk_id(rows: int, chunks: int) -> Column:
    """Equal chunks; rows must divide."""
    if rows % chunks:
        raise ValueError("rows do not divide into equal chunks")
    return F.floor(F.col("row_id") / (rows // chunks))


def split_id(size: int) -> Column:
    """Pieces of a fixed size, the last one shorter."""
    return F.floor(F.col("row_id") / size)


def repeat(df: DataFrame, times: int, interleave: bool = True, rows: int | None = None) -> DataFrame:
    """Each row `times` times: next to each other, or the whole batch again and again (needs the number of rows)."""
    every = df.withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    new = F.col("row_id") * times + F.col("_rep") if interleave else F.col("_rep") * F.lit(rows) + F.col("row_id")
    return every.withColumn("row_id", new).drop("_rep")


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """A row-specific number of repeats, 0 among them; `rep` numbers them."""
    return df.withColumn("rep", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), times.cast("long")), lambda i: i < times)))


def fold(df: DataFrame, size: int, value: str) -> DataFrame:
    """Groups of `size` neighbouring rows as one array."""
    return df.groupBy(F.floor(F.col("row_id") / size).alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", value))), lambda x: x[value]).alias(value))


def unfold(df: DataFrame, size: int, value: str) -> DataFrame:
    return df.select(F.col("row_id").alias("_g"), F.posexplode(value).alias("_i", value)).select((F.col("_g") * size + F.col("_i")).alias("row_id"), value)


def pad_to(df: DataFrame, rows: int, divisor: int) -> DataFrame:
    """Leading rows again at the end, until the number of rows divides."""
    missing = -rows % divisor
    if not missing or not rows:
        return df
    again = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((missing - 1) // rows)))).withColumn("row_id", F.col("row_id") + (F.col("_k") + 1) * rows)
    return df.unionByName(again.drop("_k").where(F.col("row_id") < rows + missing))


def unpad(df: DataFrame, rows: int) -> DataFrame:
    return df.where(F.col("row_id") < rows)


def batch_ids(rows: int, size: int, epochs: int = 1) -> Column:
    """The mini-batch of a row in an epoch; sizes must divide."""
    if rows % size:
        raise ValueError("rows do not divide into mini-batches")
    return F.floor(F.col("row_id") / size)
