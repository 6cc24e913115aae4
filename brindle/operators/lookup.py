"""Joins against id -> code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_arrays(df: DataFrame, key: str, arrays: dict[str, Column], mapping: DataFrame, id_col: str, value_col: str, keep: list[str] | None = None) -> DataFrame:
    """For each array, the values of its ids in order: unknown ids drop out, repeats stay. One join serves all arrays.

    Elements of all arrays are exploded together, joined once on the id and gathered by the row's key, so the shuffle
    carries ids and values only. The mapping's side is chosen by the optimizer. A NULL array gives an empty result.
    """
    keep = keep or []
    slots = F.concat(*[_numbered(n, a) for n, a in enumerate(arrays.values())])
    rows = df.select(key, *keep, F.explode(slots).alias("e")).select(key, *keep, "e.*")
    found = rows.join(mapping.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).alias("value")), "id")
    gathered = found.groupBy(key, *keep).agg(F.array_sort(F.collect_list(F.struct("slot", "pos", "value"))).alias("all"))
    return gathered.select(key, *keep, *[_slot(n).alias(name) for n, name in enumerate(arrays)])


def _numbered(n: int, ids: Column) -> Column:
    return F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), lambda x, i: F.struct(F.lit(n).alias("slot"), i.alias("pos"), x.cast("long").alias("id")))


def _slot(n: int) -> Column:
    return F.transform(F.filter("all", lambda x: x["slot"] == n), lambda x: x["value"])


def lookup_scalar(df: DataFrame, on: str, mapping: DataFrame, id_col: str, value_col: str, name: str) -> DataFrame:
    """The value of one id, '' if unknown."""
    found = mapping.select(F.col(id_col).alias(on), F.col(value_col).alias(name))
    return df.join(found, on, "left").withColumn(name, F.coalesce(name, F.lit("")))


def most_popular(multimap: DataFrame, key: str, item: str, count: str) -> DataFrame:
    """key -> its item with the largest count, ties to the smallest item."""
    return multimap.groupBy(key).agg(F.max_by(F.col(item), F.struct(F.col(count), -F.col(item))).alias(item))
