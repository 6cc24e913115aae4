"""Lexical top-k from a stored index: posting blocks in order of impact, with the largest impact of each block.

The index has three tables below its path: `blocks` (term, block, top, docs, impacts), `terms` (term, df, top) and `stats`
(n, avg). A posting's impact is its BM25 weight without the inverse document frequency, which belongs to the term. Postings
are placed in the order (term, falling impact) by ranges, and every `size` of a term in a range are a block: a term that all documents hold is many blocks and no task's burden.

A search first reads each query term's foremost block. The k-th best sum so far is a score that k documents reach, so a
block whose top, with the tops of the query's other terms, stays below it holds no document of the answer and is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.session import scratch

#: Sums of the same impacts in another order may differ by this much.
CLOSE = 1e-9
#: Texts whose words are counted together, and terms of queries that are broadcast.
ROWS, FEW = 256, 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def _counted(d: DataFrame) -> DataFrame:
    """doc, len, term, tf of rows with different (doc, len): a text's words are counted where its row is."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                words_ = part.column(1)
                flat = words_.flatten().dictionary_encode()
                if not len(flat):
                    continue
                each = np.asarray(pc.fill_null(pc.list_value_length(words_), 0)).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), each)
                found, tf = np.unique(row * len(flat.dictionary) + np.asarray(flat.indices), return_counts=True)
                row, term = pa.array(found // len(flat.dictionary)), pa.array(found % len(flat.dictionary))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(each.astype(np.int32)).take(row), flat.dictionary.take(term), pa.array(tf.astype(np.int64))], names=["doc", "len", "term", "tf"])

    return d.select("doc", "w").mapInArrow(counts, "doc long, len int, term string, tf long")


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (term, order, doc) of a range in order to blocks of at most `size` postings of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, rest = TaskContext.get().partitionId() << 33, 0, None

        def cut(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            # The last block may go on in the next batch.
            term, order, doc = (rows.column(i).combine_chunks() for i in range(3))
            new = np.concatenate([[True], np.asarray(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)))])
            at = np.arange(len(term))
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % size == 0)
            whole = starts if last else starts[:-1]
            ends = np.append(starts, len(term))[: len(whole) + 1].astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), x)
            first, impact = pa.array(whole), pc.negate(order)
            return pa.RecordBatch.from_arrays([term.take(first), pa.array(part + n + np.arange(len(whole))), impact.take(first), lists(doc), lists(impact)], names=["term", "block", "top", "docs", "impacts"]), rows.slice(starts[-1])

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                out, rest = cut(rows, False)
                n += out.num_rows
                yield out
        if rest is not None:
            yield cut(rest, True)[0]

    return run


def build(docs: DataFrame, key: str, text: str, path: str, size: int = 128, k1: float = 1.2, b: float = 0.75) -> None:
    """Indexes every whole text. Postings are shuffled once, into their order; blocks are cut and written where they lie."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc"), words(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("len", F.size("w"))
    n, total = F.coalesce(F.sum("c"), F.lit(0)), F.sum(F.col("len") * F.col("c"))
    seen = d.groupBy("doc", "len").agg(F.count("*").alias("c")).agg(n.alias("n"), (total / F.sum("c")).alias("avg"), F.max("c").alias("most")).first()
    spark.createDataFrame([(seen["n"], seen["avg"])], "n long, avg double").write.parquet(f"{path}/stats")
    # Rows of equal id and length are one document.
    alike = lambda: d.select("doc", "len", F.explode("w").alias("term")).groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    tf = _counted(d) if (seen["most"] or 1) == 1 else alike()
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(seen["avg"])))
    order = ["term", "order", "doc"]
    placed = tf.select("term", (-impact).alias("order"), "doc").repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(_blocks(size), "term string, block long, top double, docs array<bigint>, impacts array<double>").write.parquet(f"{path}/blocks")
    heads = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"), F.max("top").alias("top"), F.min("block").alias("first"))
    heads.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def asked_terms(spark: SparkSession, path: str, queries: DataFrame, key: str, text: str) -> DataFrame:
    """query, term, idf, top, first, rest: the query's indexed terms; rest bounds what its other terms may add."""
    stats, terms = F.broadcast(spark.read.parquet(f"{path}/stats")), spark.read.parquet(f"{path}/terms")
    q = queries.select(F.col(key).cast("long").alias("query"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = q.join(terms, "term").join(stats).select("query", "term", idf.alias("idf"), "top", "first")
    best = F.col("idf") * F.col("top")
    return known.withColumn("rest", F.sum(best).over(Window.partitionBy("query")) - best)


def _sums(met: DataFrame) -> DataFrame:
    """query, doc, score over blocks (docs, impacts) with the query and the idf that asked for them."""
    each = met.select("query", "idf", F.explode(F.arrays_zip("docs", "impacts")).alias("p")).select("query", F.col("p.docs").alias("doc"), (F.col("idf") * F.col("p.impacts")).alias("part"))
    return each.groupBy("query", "doc").agg(F.sum("part").alias("score"))


def _small(rows: DataFrame) -> DataFrame:
    """Terms of queries, written: few ones are broadcast, so that blocks are not shuffled to meet them."""
    path = scratch(rows.sparkSession, "asked")
    rows.write.parquet(path)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def _bounded(spark: SparkSession, path: str, terms: DataFrame, k: int) -> DataFrame:
    """The terms with `reached`, a score that k documents of the query reach."""
    blocks = spark.read.parquet(f"{path}/blocks").select("term", "block", "docs", "impacts")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    foremost = blocks.join(_small(terms.select("query", "idf", "term", F.col("first").alias("block"))), ["term", "block"])
    reached = _sums(foremost).withColumn("place", place).where(F.col("place") == k).select("query", F.col("score").alias("reached"))
    return _small(terms.select("query", "term", "idf", "rest").join(reached, "query", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0))))


def _asked_blocks(spark: SparkSession, path: str, terms: DataFrame, k: int) -> DataFrame:
    met = spark.read.parquet(f"{path}/blocks").join(_bounded(spark, path, terms, k), "term")
    return met.where(F.col("idf") * F.col("top") + F.col("rest") >= F.col("reached") - CLOSE)


def chosen_blocks(spark: SparkSession, path: str, terms: DataFrame, k: int) -> DataFrame:
    """query, term, idf, block of the blocks that may hold one of a query's k best documents."""
    return _asked_blocks(spark, path, terms, k).select("query", "term", "idf", "block")


def search(spark: SparkSession, path: str, queries: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """query, doc, score, place: the k best documents, exactly as by summing all postings. Ties: nine digits, then the id."""
    scored = _sums(_asked_blocks(spark, path, asked_terms(spark, path, queries, key, text), k))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
