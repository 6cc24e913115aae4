"""Policy-gradient mathematics on columns: divergences, rewards, losses, masks over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.vec import total


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token divergence: k1 (difference), abs, k2 (half square), k3 (low variance, clamped)."""
    gap = logp - ref
    if kind == "k1":
        return gap
    if kind == "abs":
        return F.abs(gap)
    if kind == "k2":
        return F.lit(0.5) * gap * gap
    if kind == "k3":
        back = clamp(ref - logp, -20.0, 20.0)
        return clamp(F.exp(back) - back - 1, -10.0, 10.0)
    raise ValueError(kind)


def kl_reward(score: Column, kl: Column, beta: float) -> Column:
    return score - F.lit(beta) * kl


def next_beta(beta: float, kl: float, target: float, steps: int, horizon: int) -> float:
    """The adaptive controller's next coefficient: its relative error is clipped to +-0.2."""
    error = min(max(kl / target - 1, -0.2), 0.2)
    return beta * (1 + error * steps / horizon)


def next_beta_column(beta: Column, kl: Column, target: float, steps: Column, horizon: int) -> Column:
    """`next_beta` of a row."""
    return beta * (1 + F.greatest(F.least(kl / target - 1, F.lit(0.2)), F.lit(-0.2)) * steps / horizon)


def reverse_kl(student: Column, teacher: Column) -> Column:
    return -(student - teacher)


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    exceed = length - F.lit(longest - buffer)
    return F.least(-(exceed / F.lit(buffer)) * F.lit(factor), F.lit(0.0))


def masked_sum(x: Column, mask: Column) -> Column:
    """Over masked positions; values outside the mask, NaN included, do not count."""
    return total(F.zip_with(x, mask, lambda v, m: F.when(m > 0, v).otherwise(F.lit(0.0))))


def masked_mean(x: Column, mask: Column) -> Column:
    return masked_sum(x, mask) / (total(F.transform(mask, lambda m: m.cast("double"))) + F.lit(1e-8))


def ppo_loss(logp: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped surrogate with the dual clip for negative advantages, per token."""
    ratio = F.exp(clamp(logp - old, -20.0, 20.0))
    clipped = F.greatest(-advantage * ratio, -advantage * clamp(ratio, 1 - low, 1 + high))
    return F.when(advantage < 0, F.least(-advantage * F.lit(dual), clipped)).otherwise(clipped)


def gpg_loss(logp: Column, advantage: Column) -> Column:
    return -logp * advantage


def gspo_ratio(logp: Column, old: Column, mask: Column, most: float | None = 10.0) -> Column:
    """The sequence-level ratio: exp of the masked mean log ratio, capped at e^most."""
    mean = masked_mean(F.zip_with(logp, old, lambda a, b: a - b), mask)
    return F.exp(mean if most is None else F.least(mean, F.lit(most)))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """R_t = r_t + gamma * R_{t+1}, set back to 0 after masked positions."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    state = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out")),
        lambda s, x: F.struct(
            ((x["r"] + F.lit(gamma) * s["run"]) * x["m"]).cast("double").alias("run"), F.array_append(s["out"], (x["r"] + F.lit(gamma) * s["run"]).cast("double")).alias("out")
        ),
    )
    return F.reverse(state["out"])


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening; masked positions pass the next value and advantage through."""
    rows = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))

    def step(s: Column, x: Column) -> Column:
        delta = x["r"] + F.lit(gamma) * s["next"] - x["v"]
        run = delta + F.lit(gamma * lam) * s["run"]
        return F.struct(
            F.when(x["m"] > 0, x["v"]).otherwise(s["next"]).cast("double").alias("next"),
            F.when(x["m"] > 0, run).otherwise(s["run"]).cast("double").alias("run"),
            F.array_append(s["out"], F.when(x["m"] > 0, run).otherwise(s["run"]).cast("double")).alias("out"),
        )

    state = F.aggregate(rows, F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out")), step)
    return F.reverse(state["out"])


def suffix_sums(rewards: Column, mask: Column) -> Column:
    """Masked rewards summed from each position to the end."""
    kept = F.zip_with(rewards, mask, lambda r, m: (r * m).cast("double"))
    summed = F.aggregate(F.reverse(kept), F.array().cast("array<double>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x))
    return F.reverse(summed)


def importance_weight(logp: Column, rollout: Column, mask: Column, level: str, high: float, truncate: bool = True, low: float = 0.0) -> Column:
    """Ratios of training to rollout probabilities per token: token, sequence or geometric level; truncated at `high` or zeroed outside [low, high]."""
    gap = F.zip_with(logp, rollout, lambda a, b: clamp(a - b, -20.0, 20.0))
    if level == "token":
        ratios = F.transform(gap, lambda g: F.exp(g))
    else:
        summed = masked_sum(F.zip_with(logp, rollout, lambda a, b: a - b), mask)
        one = summed if level == "sequence" else masked_mean(F.zip_with(logp, rollout, lambda a, b: a - b), mask)
        ratios = F.transform(gap, lambda _: F.exp(clamp(one, -20.0, 20.0)))
    if truncate:
        kept = F.transform(ratios, lambda r: F.least(r, F.lit(high)))
    else:
        kept = F.transform(ratios, lambda r: F.when((r >= low) & (r <= high), r).otherwise(F.lit(0.0)))
    return F.zip_with(kept, mask, lambda r, m: r * m)
