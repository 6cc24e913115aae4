"""Vector expressions on ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def projection(a: Column, b: Column) -> Column:
    """The length of a along b."""
    return F.when(norm(b) > 0, dot(a, b) / norm(b)).otherwise(F.lit(0.0))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    raised = F.transform(a, lambda x: F.exp((x - top).cast("double")))
    return F.transform(raised, lambda x: x / total(raised))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))))


def js_divergence(p: Column, q: Column) -> Column:
    middle = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, middle) + kl(q, middle)) / 2


def js_distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(js_divergence(p, q), F.lit(0.0)))
