"""Dense top-k by an index: inverted lists of coarse cells with product-quantised residuals, searched by list.

Centres and codebooks are fitted on a bounded sample; every row is indexed. The index is a table of (cell, chunk, key,
codes), partitioned by cell, so a search reads the cells it asks for. A cell's rows are dealt to chunks of bounded size by
a hash of the key: no cell, however crowded, is one task's work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import vec
from brindle.operators.quantize import nearest

#: Rows of an index chunk and queries of a block, which meet in one task, and the pairs of them that are scored at once.
CHUNK, BLOCK, PAIRS = 50_000, 2_048, 4 << 20


@dataclass(frozen=True)
class Model:
    """Coarse centres, and per part of the dimensions a codebook of residuals."""

    centres: np.ndarray
    books: tuple[np.ndarray, ...]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each row."""
        cell = nearest(x, self.centres)
        codes = [nearest(part, book) for part, book in zip(self.parts(x - self.centres[cell]), self.books, strict=True)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def text(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books]})

    @staticmethod
    def of(text: str) -> Model:
        held = json.loads(text)
        return Model(np.array(held["centres"]), tuple(np.array(b) for b in held["books"]))


def _lloyd(x: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """k-means of a sample that is in a fixed order; an empty cluster keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(np.int64)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))


def fit(vectors: DataFrame, key: str, vector: str, cells: int, parts: int = 16, codes: int = 256, rounds: int = 8, sample: int = 20_000) -> Model:
    """Fitted on the `sample` rows of least key hash, which is all that reaches the driver."""
    rows = _vectors(vectors, key, vector)
    drawn = rows.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    if not drawn:
        raise ValueError("no vectors to fit an index on")
    x = np.array([r["v"] for r in drawn], np.float64)
    centres = _lloyd(x, cells, rounds)
    residual = x - centres[nearest(x, centres)]
    return Model(centres, tuple(_lloyd(p, codes, rounds) for p in np.array_split(residual, min(parts, x.shape[1]), axis=1)))


def build(vectors: DataFrame, key: str, vector: str, path: str, model: Model) -> None:
    """Writes all rows' codes below `path`, partitioned by cell, and the model beside them."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            cell, codes = model.encode(x) if len(x) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["key", "cell", "codes"])

    spark = vectors.sparkSession
    _vectors(vectors, key, vector).mapInArrow(encoded, "key long, cell int, codes binary").write.parquet(f"{path}/coded")
    coded = spark.read.parquet(f"{path}/coded")
    # One row per cell, of which the model has a fixed number.
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = coded.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    placed.repartitionByRange("cell", "chunk", F.xxhash64("key")).select("key", "codes", "chunk", "chunks", "cell").write.partitionBy("cell").parquet(f"{path}/lists")
    spark.createDataFrame([(model.text(),)], "model string").coalesce(1).write.text(f"{path}/model")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Model]:
    lists = spark.read.schema("key long, codes binary, chunk int, chunks int, cell int").parquet(f"{path}/lists")
    return lists, Model.of(spark.read.text(f"{path}/model").first()["value"])


def probes(queries: DataFrame, model: Model, count: int) -> DataFrame:
    """q, v, cell: the `count` cells whose centres are nearest to a query."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            gap = (model.centres * model.centres).sum(1) - 2 * x @ model.centres.T
            cells = np.argsort(gap, axis=1, kind="stable")[:, :count]
            rows = np.repeat(np.arange(len(x)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(cells.ravel().astype(np.int32))], names=["q", "v", "cell"])

    return queries.mapInArrow(near, "q long, v array<double>, cell int")


def _scored(model: Model, keep: int):
    """Of a chunk of a cell and a block of queries that ask for it, the `keep` best rows of each query by approximate score."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and asked.num_rows:
            keys, cell = rows["key"].to_numpy(), rows["cell"][0].as_py()
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(keys), -1)
            ids, x = asked["q"].to_numpy(), np.array(asked["v"].to_pylist(), np.float64)
            step = max(1, PAIRS // len(keys))
            for at in range(0, len(ids), step):
                q = x[at : at + step]
                score = np.repeat((q @ model.centres[cell])[:, None], len(keys), axis=1)
                for j, (part, book) in enumerate(zip(model.parts(q), model.books, strict=True)):
                    score += (part @ book.T)[:, codes[:, j]]
                score[ids[at : at + step, None] == keys] = -np.inf
                best = np.argpartition(-score, min(keep, len(keys)) - 1, axis=1)[:, :keep]
                out.append((np.repeat(ids[at : at + step], best.shape[1]), keys[best].ravel(), np.take_along_axis(score, best, 1).ravel()))
        q, c, s = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.float64 if i == 2 else np.int64) for i in range(3))
        real = np.isfinite(s)
        return pa.table({"query": pa.array(q[real], pa.int64()), "candidate": pa.array(c[real], pa.int64()), "near": pa.array(s[real], pa.float64())})

    return run


def search(lists: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, cells: int = 8, keep: int = 50) -> DataFrame:
    """query, candidate, score, place: of the `keep` best rows by code in the `cells` nearest lists, the k best by exact dot product.

    Blocks of a cell's queries meet chunks of its rows, both of bounded size. Ties as in `knn`: the score rounded to six
    digits, then the smaller key.
    """
    asked = _vectors(queries, key, vector).select(F.col("key").alias("q"), "v")
    wanted = probes(asked, model, cells)
    # Numbers per cell: as many rows as the model has cells. Lists of other cells are not read.
    sizes = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = F.broadcast(lists.sparkSession.createDataFrame([(c, -(-n // BLOCK)) for c, n in sizes.items()], "cell int, blocks int"))
    lists = lists.where(F.col("cell").isin(*sizes)) if sizes else lists.limit(0)
    chunks = F.broadcast(lists.groupBy("cell").agg(F.max("chunks").alias("of")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lists.join(blocks, "cell").withColumn("block", every("blocks")).select("cell", "chunk", "block", "key", "codes")
    right = wanted.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).join(chunks, "cell").withColumn("chunk", every("of")).select("cell", "chunk", "block", "q", "v")
    by = ("cell", "chunk", "block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scored(model, keep), "query long, candidate long, near double")
    short = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "candidate"))).where(F.col("n") <= keep)
    rows = _vectors(vectors, key, vector).select(F.col("key").alias("candidate"), F.col("v").alias("w"))
    exact = short.select("query", "candidate").join(asked.withColumnRenamed("q", "query"), "query").join(rows, "candidate").select("query", "candidate", vec.dot(F.col("v"), F.col("w")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "candidate"))
    return exact.withColumn("place", place).where(F.col("place") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, recall (the share of the true neighbours that were found)."""
    hit = truth.select("query", "candidate").join(found.select("query", "candidate", F.lit(1).alias("hit")), ["query", "candidate"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
