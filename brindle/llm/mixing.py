"""Mixing sources to target weights by hash-threshold histograms, on DataFrame functions alone.

Sizes are summed by source and by the leading bits of a hash of the document id. A cumulative sum over at most
2**bits buckets per source finds the bucket in which a source's budget ends; only that bucket is looked at again by the
next bits, until the threshold is a single hash value. Documents are then kept by comparing hashes: no sort, and reruns
agree. Budgets are nested: a larger budget keeps a superset.

Targets: the sources share `share` times all sizes by weight; none exceeds `most` times its own size, and what it leaves
is shared again by weight (water filling in closed form over sources sorted by capacity per weight).

A target of q times the source's size plus a rest takes every document q times and, below the threshold, once more.

Nulls, ties and repeats: a null text has size 0; null is a source of its own, after all others; rows with the same id
share a hash and are kept or left together; a null id has a hash too. Sources of size 0 have target 0. Very long texts
count with all their words. An empty table gives no rows. Other columns are not read and are free to have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import word_count, written
from brindle.operators.batch import in_ranges, range_bases, with_row_id

#: Hash bits, and the bits that each refinement resolves.
BITS, STEP = 48, 12


def id_hash(doc_id: Column) -> Column:
    """The first 48 bits of the MD5 of the id's decimal text (null: of an empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A join key without null: null itself maps to 'n', any other source to 's' and its name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source_key, source_size, target from `source, source_key, size`.

    Sources may be many: they are numbered, and their capacities summed up, in sorted ranges and never in one task.
    """
    per = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = with_row_id(per, ["last", "source", "source_key"], "place").withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    ranked = in_ranges(capped.select("source_key", "source_size", "weight", "cap", (F.col("cap") / F.col("weight")).alias("ratio")), ["ratio", "source_key"])
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    ahead = Window.partitionBy("_rid_part").orderBy("_rid_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked.join(range_bases(ranked, F.sum("cap"), "caps"), "_rid_part").join(range_bases(ranked, F.sum("weight"), "weights"), "_rid_part")
    before = lambda c, base: F.col(base) + F.coalesce(F.sum(c).over(ahead), F.lit(0.0))
    # With the sources before it full, a source's level either stays below its capacity per weight or fills it too.
    levels = summed.withColumn("level", (F.lit(whole["size"] * share) - before("cap", "caps")) / (F.lit(whole["weight"]) - before("weight", "weights")))
    water = levels.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", "source_key")).alias("water")).first()["water"]
    target = F.col("cap") if water is None else F.least(F.col("cap"), F.lit(water) * F.col("weight"))
    return ranked.select("source_key", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source_key, threshold: documents with a smaller hash stay within `budget`, the next hash value would exceed it."""
    found = budgets.select("source_key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    for level in range(1, BITS // STEP + 1):
        width = BITS - level * STEP
        here = sizes.join(found, "source_key").where(F.shiftright("hash", width + STEP) == F.col("prefix"))
        summed = here.groupBy("source_key", "budget", "below", F.shiftright("hash", width).alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = F.col("below") + F.sum("tokens").over(Window.partitionBy("source_key").orderBy("bucket"))
        over = summed.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        first = over.groupBy("source_key").agg(F.min_by(F.struct("bucket", F.col("upto") - F.col("tokens")), "bucket").alias("edge"))
        found = written(
            found.join(first, "source_key").select("source_key", "budget", F.col("edge.bucket").alias("prefix"), F.col("edge.col2").alias("below")), f"mix-level{level}"
        )
    return found.select("source_key", F.col("prefix").alias("threshold"))


def plan(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Sizes per document, and per source: source_key, source_size, target, times, threshold."""
    sizes = written(
        docs.select(
            F.col("doc_id"), F.col("source").cast("string").alias("source"), source_key(F.col("source").cast("string")).alias("source_key"),
            word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash"),
        ),
        "mix-sizes",
    )
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = targets.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    edges = thresholds(sizes.select("source_key", "size", "hash"), planned.where("budget < source_size").select("source_key", "budget"))
    return sizes, written(planned.join(edges, "source_key", "left").select("source_key", "source_size", "target", "times", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")), "mix-plan")


def copies() -> Column:
    """How often a document with `hash` is taken under its source's `times` and `threshold`."""
    return F.col("times") + (F.col("hash") < F.col("threshold")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sizes, sources = plan(docs, weights, share, most)
    return sizes.join(sources, "source_key").select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: rows of docs, all columns, as often as they are taken."""
    _, sources = plan(docs, weights, share, most)
    packed = docs.select(F.struct(*docs.columns).alias("row"), source_key(F.col("source").cast("string")).alias("source_key"), id_hash(F.col("doc_id")).alias("hash"))
    taken = packed.join(sources, "source_key").withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies().cast("int"))))
    return taken.select("row.*")
