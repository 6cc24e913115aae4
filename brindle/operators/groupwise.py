"""Group estimators, losses, validation statistics and metric roll-ups.

Each takes rows with a group column and a reward and returns them with the estimate. Groups are the samples of one
prompt, small by design; every window is partitioned by the group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import policy as P

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str) -> Callable:
    """Registers an estimator; the same name for another function is an error."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"estimator {name} is registered already")
        return f

    return put


def get_estimator(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name]


@estimator("grpo")
def grpo(df: DataFrame, group: str, reward: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(r - mean) / (sample std + eps); a group of one has mean 0 and std 1."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    mean = F.when(n == 1, F.lit(0.0)).otherwise(F.avg(reward).over(w))
    std = F.when(n == 1, F.lit(1.0)).otherwise(F.stddev_samp(reward).over(w))
    return df.withColumn("advantage", (F.col(reward) - mean) / (std + eps) if by_std else F.col(reward) - mean)


@estimator("grpo_vectorised")
def grpo_floored(df: DataFrame, group: str, reward: str, eps: float = 1e-6) -> DataFrame:
    """The same by segment sums, with the variance floored at eps before the root."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    var = F.when(n > 1, F.greatest(F.var_samp(reward).over(w), F.lit(eps))).otherwise(F.lit(1.0))
    mean = F.when(n > 1, F.avg(reward).over(w)).otherwise(F.lit(0.0))
    return df.withColumn("advantage", (F.col(reward) - mean) / F.sqrt(var))


@estimator("grpo_passk")
def passk(df: DataFrame, group: str, reward: str, order: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """The best response gets its lead over the second best, others 0."""
    ranked = Window.partitionBy(group).orderBy(F.col(reward).desc(), order)
    w = Window.partitionBy(group)
    second = F.max(F.when(F.col("_p") == 2, F.col(reward))).over(w)
    gap = F.when(F.col("_p") == 1, F.col(reward) - second).otherwise(F.lit(0.0))
    return df.withColumn("_p", F.row_number().over(ranked)).withColumn("advantage", gap / (F.stddev_samp(reward).over(w) + eps) if by_std else gap).drop("_p")


@estimator("rloo")
def rloo(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Leave-one-out baseline: (r - mean) * n / (n - 1), the reward itself in a group of one."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    return df.withColumn("advantage", F.when(n > 1, (F.col(reward) - F.avg(reward).over(w)) * n / (n - 1)).otherwise(F.col(reward)))


@estimator("rloo_vectorised")
def rloo_summed(df: DataFrame, group: str, reward: str) -> DataFrame:
    """The same by segment sums; a group of one gets 0."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    return df.withColumn("advantage", F.when(n > 1, (n * F.col(reward) - F.sum(reward).over(w)) / (n - 1)).otherwise(F.lit(0.0)))


@estimator("opo")
def opo(df: DataFrame, group: str, reward: str, length: str) -> DataFrame:
    """Length-weighted baseline; a group of one has baseline 0."""
    w = Window.partitionBy(group)
    base = F.sum(F.col(reward) * F.col(length)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(reward) - F.when(F.count("*").over(w) > 1, base).otherwise(F.lit(0.0)))


@estimator("gpg")
def gpg(df: DataFrame, group: str, reward: str, f_norm: float = 1.0) -> DataFrame:
    """alpha * (r - mean) / f_norm with alpha = rows / rows with a reward other than 0, over the whole batch."""
    scale = df.agg((F.count("*") / F.greatest(F.count_if(F.col(reward) != 0), F.lit(1))).alias("_alpha"))
    w = Window.partitionBy(group)
    mean = F.when(F.count("*").over(w) > 1, F.avg(reward).over(w)).otherwise(F.lit(0.0))
    return df.join(F.broadcast(scale)).withColumn("advantage", F.col("_alpha") * (F.col(reward) - mean) / F.lit(f_norm)).drop("_alpha")


@estimator("reinforce_plus_plus_baseline")
def reinforce_baseline(df: DataFrame, group: str, reward: str, eps: float = 1e-8) -> DataFrame:
    """r minus its group's mean (0 in a group of one), then whitened over the batch with Bessel's correction."""
    w = Window.partitionBy(group)
    centred = df.withColumn("_c", F.col(reward) - F.when(F.count("*").over(w) > 1, F.avg(reward).over(w)).otherwise(F.lit(0.0)))
    return whitened(centred, "_c", "advantage", eps).drop("_c")


def whitened(df: DataFrame, value: str, name: str, eps: float = 1e-8, shift: bool = True) -> DataFrame:
    """(x - mean) / sqrt(sample variance + eps) over all rows; the mean is put back unless shift."""
    stats = df.agg(F.avg(value).alias("_mean"), F.var_samp(value).alias("_var"))
    white = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + eps)
    return df.join(F.broadcast(stats)).withColumn(name, white if shift else white + F.col("_mean")).drop("_mean", "_var")


def with_variance(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups whose population deviation is above 0, or of one row."""
    w = Window.partitionBy(group)
    return df.withColumn("_s", F.stddev_pop(metric).over(w)).withColumn("_n", F.count("*").over(w)).where((F.col("_s") > 0) | (F.col("_n") == 1)).drop("_s", "_n")


def loss(df: DataFrame, mode: str, value: str, row: str, horizon: float = 1.0) -> DataFrame:
    """Aggregates token losses (rows of `row`): token-mean, seq-mean-token-sum, seq-mean-token-mean, seq-mean-token-sum-norm."""
    if mode == "token-mean":
        return df.agg(F.avg(value).alias("loss"))
    per = df.groupBy(row).agg(F.sum(value).alias("_s"), F.avg(value).alias("_m"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("_s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg("_m").alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("_s") / F.lit(horizon)).alias("loss"))
    raise ValueError(mode)


def conditional_means(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Means over marked and unmarked rows with the small denominator of the training loop."""
    m = F.col(mask).cast("double")
    return df.agg((F.sum(F.col(value) * m) / (F.sum(m) + 1e-6)).alias("marked"), (F.sum(F.col(value) * (1 - m)) / (F.sum(1 - m) + 1e-6)).alias("unmarked"))


def majority(df: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """The value of the first row with the most frequent vote; of equally frequent votes the one seen first."""
    per = df.groupBy(*group, vote).agg(F.count("*").alias("_n"), F.min(order).alias("_first"), F.min_by(value, order).alias("maj"))
    return per.groupBy(*group).agg(F.max_by("maj", F.struct("_n", -F.col("_first"))).alias("maj"))


def validation(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """mean@N and population std@N per prompt, then the mean over prompts of each source, by N."""
    per = df.groupBy(source, prompt).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return per.groupBy(source, "n").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.count("*").alias("prompts"))


def bootstrap(df: DataFrame, group: list[str], value: str, order: str, size: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and deviation of best and worst of `size` hashed picks with replacement, over `draws` resamples of each group."""
    rows = df.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("_v"))
    key = F.concat_ws("|", *[F.col(g).cast("string") for g in group])
    pick = lambda d, i: F.get(F.col("_v"), F.pmod(F.xxhash64(F.lit(seed), key, d, i), F.size("_v").cast("long")).cast("int"))
    each = rows.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_x", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: pick(F.col("_d"), i)))
    best = each.select(*group, F.array_max("_x").alias("b"), F.array_min("_x").alias("w"))
    return best.groupBy(*group).agg(F.avg("b").alias("best_mean"), F.stddev_pop("b").alias("best_std"), F.avg("w").alias("worst_mean"), F.stddev_pop("w").alias("worst_std"))


#: Reducers of a resample by name: a numpy array to a number.
REDUCERS: dict[str, Callable[[np.ndarray], float]] = {"mean": np.mean, "max": np.max, "min": np.min, "std": np.std}


def reducer(name: str) -> Callable:
    """Registers a reducer; the same name for another function is an error."""

    def put(f: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], float]:
        if REDUCERS.setdefault(name, f) is not f:
            raise ValueError(f"reducer {name} is registered already")
        return f

    return put


def bootstrap_by(df: DataFrame, group: str, value: str, order: str, size: int, reducers: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """group, and of each reducer its mean and deviation (population) over `draws` resamples of `size` picks with replacement.

    All reducers see the same resample, an array of picks, and run on Arrow batches of them. A pick is a place in the group's
    values in the given order, by MD5, so it does not depend on partitioning. Groups are the answers to one prompt,
    small by design.
    """
    if unknown := [r for r in reducers if r not in REDUCERS]:
        raise ValueError(f"no reducer {', '.join(unknown)}; there are {', '.join(sorted(REDUCERS))}")
    rows = df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("_v"))
    each = rows.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = [F.lit(str(seed)), F.col(group).cast("string"), F.col("_d").cast("string")]
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", *key, i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    picked = each.select(group, F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.get("_v", (drawn(i) % F.size("_v")).cast("int"))).alias("_x"))

    def reduced_by(name: str) -> Column:
        apply = REDUCERS[name]

        def reduce(x: pd.Series) -> pd.Series:
            return x.map(lambda a: float(apply(a)))

        return F.pandas_udf(reduce, "double")(F.col("_x")).alias(name)

    reduced = picked.select(group, *[reduced_by(r) for r in reducers])
    return reduced.groupBy(group).agg(*[f(r).alias(f"{r}_{n}") for r in reducers for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


#: Rules of a roll-up, by the first of these found in a metric's name.
NAME_RULES = (("max", "max"), ("min", "min"))


def reduce_by_name(df: DataFrame, name: str, value: str) -> DataFrame:
    """max where the name has 'max', min where it has 'min', else the mean."""
    n = F.col(name)
    return df.groupBy(name).agg(F.when(F.contains(F.first(n), F.lit("max")), F.max(value)).when(F.contains(F.first(n), F.lit("min")), F.min(value)).otherwise(F.avg(value)).alias("value"))


def rollup(df: DataFrame, name: str, step: str, value: str, weight: str, rule: Column) -> DataFrame:
    """One value per metric by its rule: last, weighted_avg, sum, max, min or avg."""
    parts = df.withColumn("_rule", rule).groupBy(name, "_rule").agg(
        F.max_by(value, step).alias("last"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_avg"), F.sum(value).alias("sum"), F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("avg")
    )
    chosen = F.coalesce(*[F.when(F.col("_rule") == r, F.col(r)) for r in ("last", "weighted_avg", "sum", "max", "min", "avg")])
    return parts.select(name, chosen.alias("value"))


def preference_winners(df: DataFrame, score: str) -> DataFrame:
    """Interleaved pairs of rows: the higher score wins, the first of a tie."""
    w = Window.partitionBy(F.floor(F.col("row_id") / 2)).orderBy(F.col(score).desc(), "row_id")
    return df.withColumn("winner", F.row_number().over(w) == 1)


def dpo_loss(policy: Column, reference: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """Loss of chosen-minus-rejected log ratios of policy and reference."""
    x = policy - reference
    if kind == "ipo":
        return F.pow(x - F.lit(1 / (2 * beta)), 2)
    log_sigmoid = lambda z: -F.log1p(F.exp(-z))
    return -log_sigmoid(F.lit(beta) * x) * F.lit(1 - smoothing) - log_sigmoid(F.lit(-beta) * x) * F.lit(smoothing)


def importance_stats(df: DataFrame, weight: str, row: str, high: float, low: float) -> DataFrame:
    """Of token weights: mean, deviation, extremes, shares beyond the bounds, effective sample size, vetoed sequences."""
    per = df.groupBy(row).agg(F.sum(weight).alias("s"), F.sum(F.col(weight) * F.col(weight)).alias("q"), F.count("*").alias("n"), F.min(weight).alias("lo"), F.max(weight).alias("hi"), F.count_if(F.col(weight) > high).alias("over"), F.count_if(F.col(weight) < low).alias("under"))
    s, n = F.sum("s"), F.sum("n")
    return per.agg(
        (s / n).alias("mean"), F.sqrt(F.greatest(F.sum("q") / n - (s / n) * (s / n), F.lit(0.0))).alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        (F.sum("over") / n).alias("share_high"), (F.sum("under") / n).alias("share_low"), (s * s / (n * F.sum("q"))).alias("ess"), F.avg((F.col("lo") < low).cast("double")).alias("veto"),
    )


def perplexity(df: DataFrame, row: str, logp: str, other: str) -> DataFrame:
    """Means over sequences of exp(-mean log p) for two models, their ratio, and direct and k3 divergences over tokens."""
    gap = F.col(other) - F.col(logp)
    per = df.groupBy(row).agg(F.avg(logp).alias("a"), F.avg(other).alias("b"), F.sum(-gap).alias("k1"), F.sum(F.exp(gap) - gap - 1).alias("k3"), F.count("*").alias("n"))
    return per.agg(F.avg(F.exp(-F.col("a"))).alias("ppl"), F.avg(F.exp(-F.col("b"))).alias("ppl_other"), F.avg(F.exp(F.col("a") - F.col("b"))).alias("ratio"), (F.sum("k1") / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3"))


def masked_rloo(df: DataFrame, group: str, size: int, mask: str, token_scores: dict[str, float], outcomes: dict[str, float]) -> DataFrame:
    """df with `returns` and `advantages` per token: leave-one-out over several reward sources, summed with their weights.

    token_scores name array columns, rewards of every masked token; outcomes name numbers, the reward of the last masked
    token. In a source each masked reward r becomes r * n / (n - 1) - sum of the samples' means / (n - 1), where a sample's
    mean is over its masked tokens. Returns are sums from a token on; advantages are returns whitened over all masked tokens
    of the table. Samples of groups that do not have `size` members, and samples without a masked token, are left out.
    """
    m = F.col(mask)
    count = F.aggregate(m, F.lit(0), lambda a, x: a + x.cast("int"))
    sources = [*token_scores, *outcomes]
    means = [(P.masked_sum(F.col(c), m) / count).alias(f"_mean_{c}") for c in token_scores] + [F.col(c).cast("double").alias(f"_mean_{c}") for c in outcomes]
    whole = Window.partitionBy(group)
    rows = df.where(count > 0).select("*", *means).withColumn("_n", F.count("*").over(whole)).where(F.col("_n") == size)
    based = rows.select("*", *[(F.sum(f"_mean_{c}").over(whole) / (size - 1)).alias(f"_base_{c}") for c in sources])
    last = F.array_max(F.transform(m, lambda x, i: F.when(x == 1, i)))

    def reward(i: Column) -> Column:
        total = F.lit(0.0)
        for c, w in token_scores.items():
            total = total + w * (F.get(F.col(c), i) * (size / (size - 1)) - F.col(f"_base_{c}"))
        for c, w in outcomes.items():
            total = total + F.when(i == F.col("_last"), w * (F.col(c) * (size / (size - 1)) - F.col(f"_base_{c}"))).otherwise(F.lit(0.0))
        return total

    rewarded = based.withColumn("_last", last).withColumn("_reward", F.transform(m, lambda x, i: F.when(x == 1, reward(i)).otherwise(F.lit(0.0))))
    returned = rewarded.withColumn("returns", P.suffix_sums(F.col("_reward"), F.transform(m, lambda x: F.lit(1))))
    tokens = returned.select(F.explode(F.arrays_zip(F.col("returns").alias("x"), m.alias("m"))).alias("e")).where("e.m = 1")
    stats = tokens.agg(F.avg("e.x").alias("_mean"), F.var_samp("e.x").alias("_var"))  # one row
    whitened = returned.join(F.broadcast(stats)).withColumn("advantages", F.transform("returns", lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)))
    return whitened.select(*df.columns, "returns", "advantages")
