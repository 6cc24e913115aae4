"""Metrics of a run by step: backends by name, and a hook for streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.training import Registry
from brindle.sources.io import write_text

BACKENDS = Registry("tracking backend")


@BACKENDS.register("console")
def console(spark: SparkSession, folder: str) -> Callable[[dict, int], None]:
    return lambda metrics, step: print(f"step {step}: " + ", ".join(f"{k} {v:g}" for k, v in sorted(metrics.items())), flush=True)


@BACKENDS.register("file")
def file(spark: SparkSession, folder: str) -> Callable[[dict, int], None]:
    """One small JSON document per call in a shared folder, so writers never meet in a file."""
    return lambda metrics, step: write_text(spark, f"{folder}/step={step}/{uuid.uuid4().hex}.json", json.dumps(metrics))


class Tracking:
    def __init__(self, spark: SparkSession, folder: str, *backends: str) -> None:
        self.put = [BACKENDS.named(b)(spark, folder) for b in backends]

    def log(self, metrics: dict[str, float], step: int) -> None:
        for put in self.put:
            put(metrics, step)

    def hook(self, *values: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: logs the rows and the mean of columns of each micro-batch."""

        def put(batch: DataFrame, number: int) -> None:
            row = batch.agg(F.count("*").alias("rows"), *[F.avg(v).alias(v) for v in values]).first()
            self.log({k: float(v) for k, v in row.asDict().items() if v is not None}, number)

        return put


def read_tracked(spark: SparkSession, folder: str) -> DataFrame:
    """step, name, value of everything that the file backend has."""
    raw = spark.read.text(folder, wholetext=True)
    return raw.select(F.col("step").cast("long").alias("step"), F.explode(F.from_json("value", "map<string,double>")).alias("name", "value"))
