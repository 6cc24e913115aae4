"""Scorers by name, and reward managers over rows of solutions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import text as T

SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(name: str) -> Callable:
    """Registers score(solution, truth) -> Column; the same name for another function is an error."""

    def put(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        if SCORERS.setdefault(name, f) is not f:
            raise ValueError(f"scorer {name} is registered already")
        return f

    return put


@scorer("gsm8k")
def gsm8k(solution: Column, truth: Column) -> Column:
    return T.gsm8k_score(solution, truth)


@scorer("qa")
def qa(solution: Column, truth: Column) -> Column:
    return T.qa_score(solution, F.array(truth))


@scorer("math")
def math(solution: Column, truth: Column) -> Column:
    from brindle.operators.sequences import math_score

    return math_score(solution, truth)


@scorer("geo3k")
def geo3k(solution: Column, truth: Column, form: float = 0.1) -> Column:
    """A share `form` for thinking first and boxing the answer, the rest for a right one."""
    shaped = F.regexp_like(solution, F.lit(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")).cast("double")
    return F.lit(1 - form) * math(solution, truth) + F.lit(form) * shaped


def dispatch(source: Column, scores: dict[str, Column], default: Column | None = None) -> Column:
    """The score of a row's data source; an unknown source is an error unless there is a default."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, score in scores.items():
        out = out.when(source == name, score)
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)) if default is None else default)


def rewards(df: DataFrame, source: str, solution: str, truth: str, given: str | None = None, length: str | None = None, longest: int = 0, buffer: int = 0, factor: float = 1.0) -> DataFrame:
    """`reward` by the source's scorer; a given model score goes first; overlong responses are penalised if a buffer is set."""
    score = dispatch(F.col(source), {n: f(F.col(solution), F.col(truth)) for n, f in SCORERS.items()})
    if given:
        score = F.coalesce(F.col(given), score)
    if length and buffer:
        score = score + P.overlong_penalty(F.col(length), longest, buffer, factor)
    return df.withColumn("reward", score)
