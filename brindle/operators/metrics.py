"""Evaluation: rank metrics, AUC, F1 families, judge scores, throughput, correlation, percentiles, text overlap."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vec
from brindle.operators.batch import in_ranges, range_bases, with_row_id


def real(codes: Column) -> Column:
    """Predictions or truths that count: neither NULL nor '' nor 0."""
    return F.filter(codes, lambda x: x.isNotNull() & (x.cast("string") != "") & (x.cast("string") != "0"))


def pass_at(predicted: Column, truth: Column, k: int) -> Column:
    """Whether any of the first k predictions, repeats counted, is true."""
    return F.coalesce(F.arrays_overlap(real(F.slice(predicted, 1, k)), truth), F.lit(False))


def first_truth_at(predicted: Column, truth: Column, k: int) -> Column:
    return F.coalesce(F.array_contains(F.slice(predicted, 1, k), F.get(truth, 0)), F.lit(False))


def recall_at(predicted: Column, truth: Column, k: int) -> Column:
    """Distinct truths among the first k, over distinct truths; 0 without truths."""
    all_true = F.array_distinct(real(truth))
    return F.when(F.size(all_true) > 0, F.size(F.array_intersect(real(F.slice(predicted, 1, k)), all_true)) / F.size(all_true)).otherwise(F.lit(0.0))


def ndcg_at(predicted: Column, truth: Column, k: int) -> Column:
    """Binary gains, a repeated hit counts once, ideal over min(|truth|, k)."""
    first, truth = F.slice(predicted, 1, k), real(truth)
    gains = F.transform(first, lambda p, i: F.when(F.array_contains(truth, p) & (F.array_position(first, p) == i + 1), F.lit(1.0) / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0)))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(F.array_distinct(truth)), F.lit(k)), F.lit(1))), lambda i: F.lit(1.0) / F.log2(i + F.lit(1.0)))
    return F.when(F.size(truth) > 0, F.coalesce(vec.total(gains), F.lit(0.0)) / vec.total(ideal)).otherwise(F.lit(0.0))


def overall(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Means over all samples, failed ones (NULL) as 0."""
    return df.agg(*[(F.sum(F.coalesce(m.cast("double"), F.lit(0.0))) / F.count("*")).alias(n) for n, m in metrics.items()])


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC-AUC with average ranks for ties: 0.5 for a single class, 0.0 without rows.

    Rows are first summed to one per distinct score. Scores are sorted in ranges that are written once, so the running
    rank is a sum inside each range plus one number per range: no step sees all scores in one task.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.count("*").alias("n"))
    ranged = in_ranges(per, ["s"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_rid_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.join(range_bases(ranged, F.sum("n")), "_rid_part").withColumn("rank", F.col("_rid_base") + before + (F.col("n") + 1) / 2)
    one = ranks.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.coalesce(F.sum("p"), F.lit(0)).alias("np"), F.coalesce(F.sum(F.col("n") - F.col("p")), F.lit(0)).alias("nn"))
    value = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
    return one.select(F.when(F.col("np") + F.col("nn") == 0, F.lit(0.0)).when((F.col("np") == 0) | (F.col("nn") == 0), F.lit(0.5)).otherwise(value).alias("auc"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """*by, share, value: exact percentiles of each group, linear between neighbours; nulls do not count.

    Rows are numbered in the order of group and value, in parallel ranges; a percentile is one or two row numbers, which are
    looked up. No task or buffer holds a group's values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    placed = with_row_id(rows, [*by, "_value"], "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    share = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    wanted = groups.select("*", share).withColumn("_rank", F.col("share") * (F.col("_n") - 1))
    places = wanted.withColumn("_part", F.col("_rank") - F.floor("_rank")).withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_rank") + F.col("_first"), F.ceil("_rank") + F.col("_first")))))
    near = places.withColumn("_weight", F.when(F.col("_at") - F.col("_first") == F.floor("_rank"), 1 - F.col("_part")).otherwise(F.col("_part")))
    met = near.select(*by, "share", "_at", "_weight").join(placed.select("_at", "_value"), "_at")
    return met.groupBy(*by, "share").agg(F.sum(F.col("_value") * F.col("_weight")).alias("value"))


def average_rank(score: str, *by: str) -> Column:
    """Ranks with ties averaged, within a bounded group."""
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(score)) + (F.count("*").over(Window.partitionBy(*by, score)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    ranked = df.withColumn("_a", average_rank(a, *by)).withColumn("_b", average_rank(b, *by))
    return ranked.groupBy(*by).agg(F.corr("_a", "_b").alias("rho"))


def normalised_probability(positive: Column, negative: Column) -> Column:
    return F.when(positive + negative > 0, positive / (positive + negative)).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    whole = 2 * tp + fp + fn
    return F.when(whole > 0, 2 * tp / whole).otherwise(F.lit(0.0))


def _sum(a: Column, f) -> Column:
    return F.aggregate(F.coalesce(a, F.expr("cast(array() as array<double>)")), F.lit(0.0), lambda s, x: s + x) if f is None else vec.total(F.transform(a, f))


def f1_family(matches: Column, extra: Column, missed: Column) -> dict[str, Column]:
    """matches: (gt, model, quality) importance scores; extra and missed: scores of unmatched model and truth points.

    plain counts points, core counts truth points of 5 or more, weighted sums scores, double weighs matches by quality
    and gives the rest to the errors; a match without quality does not count there.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    core = lambda a, f: F.size(F.filter(a, f)).cast("double")
    return {
        "f1": f1(F.size(matches).cast("double"), F.size(extra).cast("double"), F.size(missed).cast("double")),
        "f1_core": f1(core(matches, lambda m: m["gt"] >= 5), core(extra, lambda x: x >= 5), core(missed, lambda x: x >= 5)),
        "f1_weighted": f1(_sum(matches, lambda m: m["gt"].cast("double")), _sum(extra, lambda x: x.cast("double")), _sum(missed, lambda x: x.cast("double"))),
        "f1_double": f1(
            _sum(matches, lambda m: zero(m["gt"] * m["quality"])),
            _sum(extra, lambda x: x.cast("double")) + _sum(matches, lambda m: zero(m["model"] * (1 - m["quality"]))),
            _sum(missed, lambda x: x.cast("double")) + _sum(matches, lambda m: zero(m["gt"] * (1 - m["quality"]))),
        ),
    }


def judge_score(raw: Column) -> Column:
    """A judge's score in [1, 5]; anything else is 3."""
    value = F.try_to_number(raw, F.lit("9999.9999")).cast("double")
    value = F.coalesce(raw.try_cast("double"), value)
    return F.when((value >= 1) & (value <= 5), value).otherwise(F.lit(3.0))


def mfu(tokens: Column, seconds: Column, parameters: float, tflops: float, gpus: int) -> Column:
    """Model FLOPs utilisation of a decoder: 2 FLOPs per parameter and token."""
    return F.when(seconds > 0, 2 * parameters * tokens / (tflops * 1e12 * gpus * seconds)).otherwise(F.lit(0.0))


def decoder_flops(length: Column, layers: int, hidden: int, intermediate: int, heads: int, kv_heads: int, vocabulary: int) -> Column:
    """Training FLOPs of one sequence: six per dense parameter and token, and twelve per attended pair, layer and head width."""
    width = hidden // heads
    dense = layers * (hidden * intermediate * 3 + hidden * (heads * width * 2 + kv_heads * width * 2)) + 2 * vocabulary * hidden
    return 6.0 * dense * length + 12.0 * length * length * width * heads * layers


def stage_totals(df: DataFrame, tokens: str, seconds: str) -> DataFrame:
    """Per position of two parallel arrays: summed tokens, greatest time."""
    each = df.select(F.posexplode(F.arrays_zip(F.col(tokens).alias("t"), F.col(seconds).alias("s"))).alias("stage", "x"))
    return each.groupBy("stage").agg(F.sum("x.t").alias("tokens"), F.max("x.s").alias("seconds"))


def top_unique(df: DataFrame, key: str, item: str, score: str, n: int) -> DataFrame:
    """The first n distinct items of each key by score, ties to the smaller item; key, item, place."""
    best = df.groupBy(key, item).agg(F.max(score).alias(score))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), item))
    return best.withColumn("place", place).where(F.col("place") <= n)


def pair_accuracy(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Per group the share of ordered pairs whose score and label differences agree; 0.5 where all labels are equal; then the mean.

    Pairs are counted from arrays inside a bounded group (the samples of one prompt).
    """
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), F.col(label).alias("y")))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: F.struct((F.signum(b["s"] - a["s"]) * F.signum(b["y"] - a["y"])).alias("g"), F.abs(b["y"] - a["y"]).alias("w")))))
    good = vec.total(F.transform("p", lambda p: F.when(p["g"] > 0, p["w"].cast("double")).when((p["g"] == 0) & (p["w"] > 0), p["w"] * 0.5).otherwise(F.lit(0.0))))
    weight = vec.total(F.transform("p", lambda p: p["w"].cast("double")))
    return rows.select(pairs.alias("p")).select(F.when(weight > 0, good / weight).otherwise(F.lit(0.5)).alias("acc")).agg(F.avg("acc").alias("accuracy"))


def bleu(candidate: Column, reference: Column, longest: int = 4) -> Column:
    """Sentence BLEU of word arrays: clipped n-gram precisions with add-one smoothing above unigrams, brevity penalty."""


    def log_precision(n: int) -> Column:
        grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        mine, theirs = grams(candidate), grams(reference)
        hits = vec.total(F.transform(F.array_distinct(mine), lambda g: F.least(F.size(F.filter(mine, lambda x: x == g)), F.size(F.filter(theirs, lambda x: x == g))).cast("double")))
        add = 0.0 if n == 1 else 1.0
        return F.log((hits + add) / (F.size(mine) + add))

    logs = [log_precision(n) for n in range(1, longest + 1)]
    mean = logs[0]
    for x in logs[1:]:
        mean = mean + x
    short = F.when(F.size(candidate) < F.size(reference), F.exp(1 - F.size(reference) / F.size(candidate))).otherwise(F.lit(1.0))
    return F.when(F.size(candidate) > 0, F.coalesce(short * F.exp(mean / longest), F.lit(0.0))).otherwise(F.lit(0.0))


def bleu_rows(df: DataFrame, key: str, candidate: str, reference: str, name: str = "bleu", longest: int = 4) -> DataFrame:
    """bleu() of two word arrays per row, with a row's n-grams counted where it is: linear in the words. NULL counts as no words."""

    def score(c: list, r: list) -> float:
        codes = {w: i for i, w in enumerate({*c, *r})}
        c, r = ([codes[w] for w in x] for x in (c, r))
        total = 0.0
        for n in range(1, longest + 1):
            mine, theirs = (Counter(zip(*[x[i:] for i in range(n)])) for x in (c, r))  # noqa: B905
            hits, add = sum(min(k, theirs[g]) for g, k in mine.items() if g in theirs), 0 if n == 1 else 1
            # Without a common word the precision is 0 and so is the score.
            if not hits + add:
                return 0.0
            total += math.log((hits + add) / (max(len(c) - n + 1, 0) + add))
        return (math.exp(1 - len(r) / len(c)) if len(c) < len(r) else 1.0) * math.exp(total / longest)

    @F.pandas_udf("double")
    def scores(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or not len(x) else score(list(x), [] if y is None else list(y)) for x, y in zip(c, r, strict=True)], dtype=float)

    return df.select(key, scores(candidate, reference).alias(name))


def report(df: DataFrame, row: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row per model, one column per metric; names in pass, recall, ndcg order."""
    rank = lambda n: next((i for i, p in enumerate(("pass", "recall", "ndcg")) if p in n), 3)
    return df.groupBy(row).pivot(name, sorted(names, key=lambda n: (rank(n), n))).agg(F.first(value))
