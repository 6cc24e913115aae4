"""Policy losses by name, validation at k, preference losses, FLOPs by model family, dispatch modes, tasks, reward managers, samplers."""

from __future__ import annotations

import importlib.util
import signal
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions.vec import total
from brindle.operators.groupwise import estimator
from brindle.operators.sampling import hash_order


class Registry(dict):
    """Functions by name; the same name for another function is an error."""

    def __init__(self, what: str) -> None:
        super().__init__()
        self.what = what

    def register(self, name: str) -> Callable:
        def put(f):
            if self.setdefault(name, f) is not f:
                raise ValueError(f"{self.what} {name} is registered already")
            return f

        return put

    def named(self, name: str):
        if name not in self:
            raise ValueError(f"no {self.what} {name}; there are {', '.join(sorted(self))}")
        return self[name]


# Policy losses. Each takes one row per token (row, logp, old, adv, mask and unique keys) and adds `loss`.

LOSSES = Registry("policy loss")


@LOSSES.register("vanilla")
def vanilla(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, **_) -> DataFrame:
    return tokens.withColumn("loss", P.ppo_loss(F.col("logp"), F.col("old"), F.col("adv"), low, high, dual))


@LOSSES.register("gpg")
def gpg(tokens: DataFrame, **_) -> DataFrame:
    return tokens.withColumn("loss", P.gpg_loss(F.col("logp"), F.col("adv")))


@LOSSES.register("gspo")
def gspo(tokens: DataFrame, low: float = 0.2, high: float = 0.2, **_) -> DataFrame:
    """The ratio is that of the whole sequence, for each of its tokens."""
    seq = Window.partitionBy("row")
    n = F.greatest(F.sum(F.col("mask").cast("double")).over(seq), F.lit(1.0))
    ratio = F.exp(F.least(F.sum((F.col("logp") - F.col("old")) * F.col("mask")).over(seq) / n, F.lit(10.0)))
    return tokens.withColumn("_r", ratio).withColumn("loss", F.greatest(-F.col("adv") * F.col("_r"), -F.col("adv") * P.clamp(F.col("_r"), 1 - low, 1 + high))).drop("_r")


def with_covariance(tokens: DataFrame, eps: float = 0.0) -> tuple[DataFrame, int]:
    """tokens with `_cov`, the product of deviations of advantage and log probability from their means over the batch's masked tokens; and their number."""
    of = tokens.where("mask > 0").agg(F.count("*").alias("n"), F.sum("adv").alias("a"), F.sum("logp").alias("p")).first()
    share = lambda s: (s or 0.0) / (of["n"] + eps) if of["n"] else 0.0
    return tokens.withColumn("_cov", (F.col("adv") - F.lit(share(of["a"]))) * (F.col("logp") - F.lit(share(of["p"])))), of["n"]


def _first(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """One row: the n-th smallest `order`, so that rows up to it can be told without a join on their keys."""
    return F.broadcast(rows.select(order.alias("_o")).orderBy("_o").limit(n).agg(F.max("_o").alias("_edge")))


@LOSSES.register("clip_cov")
def clip_cov(tokens: DataFrame, keys: tuple[str, ...] = (), seed: int = 42, share: float = 0.0002, least: float = 1.0, most: float = 5.0, low: float = 0.2, high: float = 0.2, **_) -> DataFrame:
    """The clipped surrogate without the gradient of `share` of the tokens, drawn by hash among unclipped ones whose covariance lies between the bounds. `dropped` marks them."""
    rows, n = with_covariance(tokens, 1e-8)
    ratio = F.exp(F.col("logp") - F.col("old"))
    plain, clipped = -F.col("adv") * ratio, -F.col("adv") * P.clamp(ratio, 1 - low, 1 + high)
    order = F.struct(hash_order(seed, *keys).alias("h"), *[F.col(k) for k in keys])
    open_ = (F.col("mask") > 0) & ~(clipped > plain) & (F.col("_cov") > least) & (F.col("_cov") < most)
    marked = rows.join(_first(rows.where(open_), order, max(int(share * n), 1))).withColumn("dropped", open_ & F.coalesce(order <= F.col("_edge"), F.lit(False)))
    return marked.withColumn("loss", F.when(F.col("dropped"), F.lit(0.0)).otherwise(F.greatest(plain, clipped))).drop("_cov", "_edge")


@LOSSES.register("kl_cov")
def kl_cov(tokens: DataFrame, keys: tuple[str, ...] = (), share: float = 0.0002, coefficient: float = 1.0, **_) -> DataFrame:
    """The plain surrogate, with a divergence penalty on the `share` of tokens of the largest covariance. `dropped` marks them."""
    rows, n = with_covariance(tokens)
    gap = F.col("logp") - F.col("old")
    order = F.struct((-F.col("_cov")).alias("c"), *[F.col(k) for k in keys])
    marked = rows.join(_first(rows.where("mask > 0"), order, max(int(n * share), 1))).withColumn("dropped", (F.col("mask") > 0) & F.coalesce(order <= F.col("_edge"), F.lit(False)))
    return marked.withColumn("loss", -F.col("adv") * F.exp(gap) + F.when(F.col("dropped"), F.lit(coefficient) * F.abs(gap)).otherwise(F.lit(0.0))).drop("_cov", "_edge")


# Estimators over token arrays.


def masked_whitened(df: DataFrame, x: str, mask: str, name: str, eps: float = 1e-8) -> DataFrame:
    """Arrays less the batch's masked mean, over the root of its masked variance with Bessel's correction."""
    n = total(F.transform(mask, lambda m: m.cast("double")))
    of = df.agg(F.sum(n).alias("n"), F.sum(P.masked_sum(F.col(x), F.col(mask))).alias("s"), F.sum(P.masked_sum(F.transform(x, lambda v: v * v), F.col(mask))).alias("q")).first()
    count = of["n"] or 0.0
    mean = of["s"] / count if count else 0.0
    var = (of["q"] / count - mean * mean) * count / (count - 1) if count > 1 else 0.0
    return df.withColumn(name, F.transform(x, lambda v: (v - F.lit(mean)) / F.lit((var + eps) ** 0.5)))


@estimator("remax")
def remax(df: DataFrame, rewards: str, mask: str, baseline: str) -> DataFrame:
    """Rewards to the end less the greedy response's reward, on masked tokens."""
    kept = F.transform(mask, lambda m: F.col(baseline) * m)
    return df.withColumn("returns", P.suffix_sums(F.col(rewards), F.col(mask))).withColumn("advantage", F.zip_with("returns", kept, lambda r, b: r - b))


@estimator("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, rewards: str, mask: str, gamma: float = 1.0) -> DataFrame:
    """Discounted returns, whitened over the batch's masked tokens."""
    back = df.withColumn("returns", P.discounted_returns(F.col(rewards), F.col(mask), gamma))
    return masked_whitened(back, "returns", mask, "_w").withColumn("advantage", F.zip_with("_w", mask, lambda w, m: w * m)).drop("_w")


@estimator("gae")
def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Generalised advantages, whitened over the batch's masked tokens; returns are advantages before that plus values."""
    raw = df.withColumn("_a", P.gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam)).withColumn("returns", F.zip_with("_a", values, lambda a, v: a + v))
    return masked_whitened(raw, "_a", mask, "advantage").drop("_a")


# Validation, preferences.


def validation_at(df: DataFrame, source: str, prompt: str, value: str, vote: str, order: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """source, k, prompts and the mean over prompts of the bootstrap mean and deviation of best, worst and majority of k responses.

    k runs over 2, 4, ... below a prompt's number of responses, and that number. A draw takes k responses with
    replacement, by hash. The majority's value is that of the first pick with the most frequent vote.
    """
    answer = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x"), F.col(vote).cast("string").alias("v"))
    rows = df.groupBy(source, prompt).agg(F.array_sort(F.collect_list(answer)).alias("_r")).withColumn("_n", F.size("_r")).where("_n > 1")
    sizes = F.array_distinct(F.concat(F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda e: F.pow(F.lit(2.0), e).cast("int")), lambda k: k < F.col("_n")), F.array("_n")))
    each = rows.withColumn("k", F.explode(sizes)).withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = lambda i: F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in (F.col(source), F.col(prompt), F.col("k"), F.col("_d"), i)])
    place = lambda i: F.pmod(F.conv(F.substring(F.md5(key(i).cast("binary")), 1, 8), 16, 10).cast("long"), F.col("_n").cast("long")).cast("int")
    picked = each.withColumn("_p", F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.get("_r", place(i))))
    votes = F.transform("_p", lambda x, i: F.struct(F.size(F.filter("_p", lambda y: y["v"].eqNullSafe(x["v"]))).alias("c"), (-i).alias("i"), x["x"].alias("x")))
    value_of = F.transform("_p", lambda x: x["x"])
    names = {"best": F.array_max(value_of), "worst": F.array_min(value_of), "maj": F.array_max(votes)["x"]}
    drawn = picked.select(source, prompt, "k", *[c.alias(n) for n, c in names.items()])
    per = drawn.groupBy(source, prompt, "k").agg(*[x for n in names for x in (F.avg(n).alias(n), F.stddev_pop(n).alias(f"{n}_std"))])
    return per.groupBy(source, "k").agg(*[F.avg(x).alias(x) for n in names for x in (n, f"{n}_std")], F.count("*").alias("prompts"))


def detached_preference(df: DataFrame, group: str, score: str, accuracy: str, beta: float, best_of: str | None = None) -> DataFrame:
    """`loss` and `weight` of each response of a prompt: -log sigmoid of beta times the lead over the mean of the answers that it
    should beat (or lose to); weights are 1, or n * P(other <= this) ** (n - 1) by score ('score') or accuracy ('accuracy')."""
    w = Window.partitionBy(group)
    good = F.col(accuracy) > 0
    others = F.collect_list(F.struct(F.col(accuracy).cast("double").alias("a"), F.col(score).cast("double").alias("q"))).over(w)
    held = df.withColumn("_all", others)
    against = F.filter("_all", lambda o: F.when(good, o["a"] < F.col(accuracy)).otherwise(o["a"] > F.col(accuracy)))
    mean = F.when(F.size("_against") > 0, total(F.transform("_against", lambda o: o["q"])) / F.size("_against")).otherwise(F.lit(0.0))
    lead = F.lit(beta) * (F.col(score) - mean) * F.when(good, 1.0).otherwise(-1.0)
    n = F.size("_all")
    field_, mine = ("q", F.col(score)) if best_of == "score" else ("a", F.col(accuracy))
    weight = F.lit(1.0) if best_of is None else n * F.pow(F.size(F.filter("_all", lambda o: o[field_] <= mine)) / n, n - 1)
    return held.withColumn("_against", against).withColumn("loss", F.log1p(F.exp(-lead))).withColumn("weight", weight).drop("_all", "_against")


def masked_importance(logp: Column, rollout: Column, mask: Column, level: str, high: float, low: float | None = None, veto: float | None = None) -> Column:
    """The response mask without tokens whose ratio leaves [low, high] (low: 1 / high if not given), or empty if any token's ratio is below `veto`."""
    kept = P.importance_weight(logp, rollout, mask, level, high, truncate=False, low=1 / high if low is None else low)
    inside = F.zip_with(kept, mask, lambda k, m: F.when(k > 0, m).otherwise(F.lit(0)))
    if veto is None:
        return inside
    bad = F.exists(F.zip_with(F.zip_with(logp, rollout, lambda a, b: a - b), mask, lambda g, m: (m > 0) & (F.exp(g) < veto)), lambda x: x)
    return F.when(bad, F.transform(inside, lambda _: F.lit(0))).otherwise(inside)


# FLOPs of training.


@dataclass(frozen=True)
class Shape:
    """Sizes of a decoder. Only a family's own fields count."""

    hidden: int
    layers: int
    heads: int
    kv_heads: int
    intermediate: int
    vocabulary: int
    head: int = 0
    experts: int = 0
    active: int = 0
    expert_size: int = 0
    shared: int = 0
    dense_layers: int = 0
    rope: int = 0
    nope: int = 0
    value_head: int = 0
    kv_rank: int = 0
    q_rank: int = 0
    window: int = 1024
    full_every: int = 6


FAMILIES = Registry("model family")


def _grouped_query(s: Shape) -> int:
    head = s.head or s.hidden // s.heads
    return s.hidden * head * (2 * s.heads + 2 * s.kv_heads)


def _training(length: Column, parameters: int, attended: Column, width: int) -> Column:
    """Six per parameter and token; twelve per attended pair and unit of width."""
    return F.lit(6.0 * parameters) * length + F.lit(12.0 * width) * attended


@FAMILIES.register("dense")
def dense(n: Column, s: Shape) -> Column:
    x = n.cast("double")
    return _training(x, s.layers * (3 * s.hidden * s.intermediate + _grouped_query(s)) + 2 * s.vocabulary * s.hidden, x * x * s.layers, (s.head or s.hidden // s.heads) * s.heads)


@FAMILIES.register("mixture")
def mixture(n: Column, s: Shape) -> Column:
    """A token meets its active experts and the gate."""
    x = n.cast("double")
    mlp = 3 * s.hidden * s.active * s.expert_size + s.hidden * s.experts
    return _training(x, s.layers * (mlp + _grouped_query(s)) + 2 * s.vocabulary * s.hidden, x * x * s.layers, (s.head or s.hidden // s.heads) * s.heads)


@FAMILIES.register("latent")
def latent(n: Column, s: Shape) -> Column:
    """Compressed keys and values, experts after some dense layers."""
    x, q = n.cast("double"), s.nope + s.rope
    query = s.hidden * s.q_rank + s.heads * q * s.q_rank if s.q_rank else s.hidden * s.heads * q
    attention = query + s.hidden * (s.kv_rank + s.rope) + s.kv_rank * s.heads * (q - s.rope + s.value_head) + s.heads * s.value_head * s.hidden
    expert = s.hidden * s.experts + 3 * s.hidden * s.expert_size * (s.active + s.shared)
    parameters = (expert + attention) * (s.layers - s.dense_layers) + (3 * s.hidden * s.intermediate + attention) * s.dense_layers + 2 * s.vocabulary * s.hidden
    return _training(x, parameters, x * x * s.layers, q * s.heads)


@FAMILIES.register("sliding")
def sliding(n: Column, s: Shape) -> Column:
    """Every `full_every`-th layer attends to all tokens, the others to a window."""
    x = n.cast("double")
    full = s.layers // s.full_every
    attended = x * x * full + x * F.least(x, F.lit(float(s.window))) * (s.layers - full)
    return _training(x, s.layers * (3 * s.hidden * s.intermediate + _grouped_query(s)) + 2 * s.vocabulary * s.hidden, attended, (s.head or s.hidden // s.heads) * s.heads)


# The family of each model type that configurations name.
MODEL_TYPES = {
    "qwen2": "dense", "llama": "dense", "qwen2_vl": "dense", "qwen2_5_vl": "dense", "qwen3": "dense", "minicpmv": "dense", "minicpmo": "dense", "mistral": "dense",
    "qwen2_moe": "mixture", "qwen3_moe": "mixture", "deepseek_v3": "latent", "gemma3_text": "sliding",
}


def training_flops(length: Column, model_type: str, shape: Shape) -> Column:
    """FLOPs of a forward and backward pass over a sequence; 0 for an unknown model type."""
    return FAMILIES[MODEL_TYPES[model_type]](length, shape) if model_type in MODEL_TYPES else F.lit(0.0)


# Dispatch modes: how a numbered batch goes to ranks, and how results come back.

DISPATCH = Registry("dispatch mode")


@DISPATCH.register("one_to_all")
def one_to_all(batch: DataFrame, ranks: int, rows: int | None = None) -> DataFrame:
    """Every rank gets all rows: for small batches."""
    return batch.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


@DISPATCH.register("rank_zero")
def rank_zero(batch: DataFrame, ranks: int, rows: int | None = None) -> DataFrame:
    return batch.withColumn("rank", F.lit(0))


@DISPATCH.register("data_parallel")
def data_parallel(batch: DataFrame, ranks: int, rows: int) -> DataFrame:
    """Equal runs of neighbouring rows, the batch padded with its first rows; `padded` marks them."""
    from brindle.operators.batch import pad_to

    size = -(-rows // ranks)
    return pad_to(batch, rows, ranks).withColumn("rank", F.floor(F.col("row_id") / max(size, 1)).cast("int")).withColumn("padded", F.col("row_id") >= rows)


def collected(results: DataFrame, mode: str) -> DataFrame:
    """Results of all ranks as one batch: copies of the first rank, or all rows without padding."""
    rows = results.where("rank = 0") if mode in ("one_to_all", "rank_zero") else results
    return (rows.where("NOT padded").drop("padded") if "padded" in rows.columns else rows).drop("rank")


# Tasks of a benchmark: how samples are read, how answers are judged, with which settings.


@dataclass(frozen=True)
class Task:
    name: str
    load: Callable[..., DataFrame]
    evaluate: Callable[[DataFrame], DataFrame]
    settings: dict = field(default_factory=dict)

    def run(self, *args, **changed) -> DataFrame:
        return self.evaluate(self.load(*args, **(self.settings | changed)))


TASKS = Registry("task")


def task(name: str, load: Callable[..., DataFrame], evaluate: Callable[[DataFrame], DataFrame], **settings) -> Task:
    if name in TASKS:
        raise ValueError(f"task {name} is registered already")
    TASKS[name] = Task(name, load, evaluate, settings)
    return TASKS[name]


# Reward managers over rows of solutions.

MANAGERS = Registry("reward manager")


@MANAGERS.register("naive")
@MANAGERS.register("batch")
def scored(df: DataFrame, source: str = "source", solution: str = "solution", truth: str = "truth", given: str | None = None, **_) -> DataFrame:
    """`reward` by the source's scorer, as one expression over all rows: there is no difference between row by row and in batches."""
    from brindle.operators.scorers import rewards

    return rewards(df, source, solution, truth, given)


@MANAGERS.register("dapo")
def overlong(df: DataFrame, length: str = "length", longest: int = 0, buffer: int = 0, factor: float = 1.0, **names) -> DataFrame:
    """The same with a penalty for responses that reach into the last `buffer` tokens."""
    from brindle.operators.scorers import rewards

    return rewards(df, names.get("source", "source"), names.get("solution", "solution"), names.get("truth", "truth"), names.get("given"), length, longest, buffer, factor)


@MANAGERS.register("prime")
def limited(df: DataFrame, score: Callable[[str, str], float | dict], solution: str = "solution", truth: str = "truth", seconds: float = 300.0, **_) -> DataFrame:
    """`reward` by a Python function of solution and truth; one that fails or takes longer than `seconds` gives 0. Of a dict, its 'score' counts."""

    @F.pandas_udf("double")
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, truths in frames:
            yield pd.Series([_within(score, a, b, seconds) for a, b in zip(texts, truths, strict=True)], dtype="float64")

    return df.withColumn("reward", run(solution, truth))


def _within(score: Callable, a: str, b: str, seconds: float) -> float:
    def late(*_) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        found = score(a, b)
        return float(found["score"] if isinstance(found, dict) else found)
    except Exception:  # noqa: BLE001
        return 0.0
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def loaded(path: str, name: str = "compute_score") -> Callable:
    """A scoring function from a Python file that a configuration names."""
    spec = importlib.util.spec_from_file_location(f"brindle_loaded_{abs(hash(path))}", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"{path} is no Python file")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)


# Samplers whose next batch depends on what came of the last.


class Sampler(ABC):
    @abstractmethod
    def batch(self, rows: DataFrame, size: int, step: int) -> DataFrame:
        """The rows of a step."""


class Curriculum(Sampler):
    """Draws rows by hash and weight; a group's weight follows its last mean score: what is solved, or hopeless, is seen less."""

    def __init__(self, key: str, group: str, seed: int = 42) -> None:
        self.key, self.group, self.seed, self.weights = key, group, seed, None

    def update(self, results: DataFrame, score: str) -> None:
        """results: rows with the group and a score from 0 to 1. One row a group is kept."""
        mean = F.avg(F.col(score).cast("double"))
        self.weights = results.groupBy(self.group).agg(F.greatest(4 * mean * (1 - mean), F.lit(0.05)).alias("_weight"))

    def batch(self, rows: DataFrame, size: int, step: int) -> DataFrame:
        # Weighted sampling without replacement: the smallest -log(u) / weight win.
        u = (F.conv(F.substring(hash_order(self.seed + step, self.key), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
        weight = F.lit(1.0)
        if self.weights is not None:
            rows, weight = rows.join(self.weights, self.group, "left"), F.coalesce("_weight", F.lit(1.0))
        return rows.withColumn("_race", -F.log(u) / weight).orderBy("_race", self.key).limit(size).drop("_race", "_weight")
