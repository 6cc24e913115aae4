"""Filter interaction audit: what each order of a set of filters removes, and which filter gets the credit.

A document's failures are one number of a bit per filter. FIRST, a 32-by-120 table, holds the step at which a document with
these failures goes under each order of the five filters. Arrow batches of narrow rows index that table; np.bincount adds
up removals by part, order and step, once for all documents and once for each label; the partial arrays are summed.
Everything else follows from the removals: a filter that comes first removes all that fail it, one that comes last removes
what only it fails, and the sum over all orders is its Shapley value times 120.

The filter E (a copy of an earlier text) compares a row's id with the least id of its text's digest; the rows that carry
the least id are found by joining on digest and id, so that a text of very many copies is no hot key.

Nulls, ties and repeats: a null text is empty; a null source is the part of the empty string; a null id is neither earlier
nor later than any, so its row never fails E and has no labels; rows of equal id and text are no copies of each other; a
document with several rows of labels has a label if one of them says so. Very long texts are measured whole. An empty
table gives no rows. Other columns are not read and are free to have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import released, word_array, written

#: A filter's letter -> the test that a document fails; E is found by the texts' digests. A filter's bit is its place here.
TESTS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "odd",
}
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS) + 1
#: FIRST[failures, order]: the step, from 0, that removes such a document; the last one stands for "kept".
FIRST = np.array([[next((s for s, f in enumerate(order) if failed >> FILTERS.index(f) & 1), STEPS - 1) for order in ORDERS] for failed in range(1 << len(FILTERS))])
#: Parts whose sums a task holds at once.
HELD = 256
COUNTS = ("removed", "good_lost", "toxic_lost")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed: one bit per filter. Every text is read once; a narrow table is written."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(word_array(text), "")
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        words.alias("words"), F.length(text).alias("n_chars"), (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"), text.rlike("[#$%&*|]").alias("odd"),
    ).select("doc_id", "part", "digest", "n_chars", "n_capitals", "odd", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    bits = sum((F.expr(test).cast("int") * (1 << FILTERS.index(f)) for f, test in TESTS.items()), F.lit(0))
    rows = written(measured.select("doc_id", "part", "digest", bits.alias("failed")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("failed") + later.cast("int") * (1 << FILTERS.index("E"))).alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed, good, toxic (0 or 1) of each row."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    per = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    return rows.join(per, "doc_id", "left").select("part", "failed", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part one row of arrays over order and step: documents removed, and how many of them are good and toxic."""
    size = len(ORDERS) * STEPS
    names, sums = {}, np.zeros((len(COUNTS), 0, size), np.int64)

    def held() -> pa.RecordBatch:
        arrays = [pa.array(list(names), pa.string()), *(pa.array(list(s), pa.list_(pa.int64())) for s in sums)]
        return pa.RecordBatch.from_arrays(arrays, names=["part", *COUNTS])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        for p in parts.dictionary.to_pylist():
            names.setdefault(p, len(names))
        sums = np.pad(sums, ((0, 0), (0, len(names) - sums.shape[1]), (0, 0)))
        part = np.array([names[p] for p in parts.dictionary.to_pylist()], np.int64)[parts.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.int64)
        cause = part * len(FIRST) + batch.column(1).to_numpy()
        weights = [None, batch.column(2).to_numpy(), batch.column(3).to_numpy()]
        causes = np.arange(len(names) * len(FIRST))
        place = ((causes // len(FIRST) * len(ORDERS))[:, None] + np.arange(len(ORDERS))) * STEPS + FIRST[causes % len(FIRST)]
        for total, w in zip(sums, weights, strict=True):
            rows = np.bincount(cause, weights=w, minlength=len(causes))
            total += np.bincount(place.ravel(), weights=np.repeat(rows, len(ORDERS)), minlength=total.size).astype(np.int64).reshape(total.shape)
        if len(names) > HELD:
            yield held()
            names, sums = {}, np.zeros((len(COUNTS), 0, size), np.int64)
    yield held()


def removals(rows: DataFrame) -> DataFrame:
    """part, filter_order, step (the last stands for "kept"), and the summed COUNTS, zeros included."""
    partial = rows.mapInArrow(released(_partial), "part string, " + ", ".join(f"{c} array<long>" for c in COUNTS))
    each = partial.select("part", F.posexplode(F.arrays_zip(*COUNTS)).alias("place", "n")).groupBy("part", "place").agg(*[F.sum(f"n.{c}").alias(c) for c in COUNTS])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.floor(F.col("place") / STEPS).cast("int") + 1)
    return each.select("part", order.alias("filter_order"), (F.col("place") % STEPS + 1).cast("int").alias("step"), *COUNTS)


def audit(rows: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    later = Window.partitionBy("part", "filter_order").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part", "filter")
    steps = removals(rows).withColumn("kept", F.sum("removed").over(later)).where(F.col("step") < STEPS).withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    return steps.select(
        "part", "filter_order", "step", "kept", "removed",
        (F.max("removed").over(own) - F.col("removed")).alias("redundant"), F.min("removed").over(own).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"),
    )


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(labelled(failures(docs), labels))
