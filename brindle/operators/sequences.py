"""Sequential operators: greedy packing, balanced partitions, micro-batches, reserialised JSON, math answers."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from brindle.functions import expressions
from brindle.functions.arrays import let

PACKS = "shard long, pack long, item long, start int, length int, position int"


def pack_greedy(df: DataFrame, shard: str, key: str, length: str, order: str, longest: int, cut: bool = True) -> DataFrame:
    """Items of a shard in hash order fill packs of `longest` tokens; the crossing item is cut, or starts the next pack.

    Shards are bounded by the caller. Rows arrive sorted and are streamed, so a pack is all that is held. What is cut
    off an item is dropped; `cut=False` keeps items whole (longer ones are cut).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pack, used = None, 0, 0
        for batch in batches:
            out = []
            for s, item, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != at:
                    at, pack, used = s, 0, 0
                if used and (used + n > longest and not cut or used == longest):
                    pack, used = pack + 1, 0
                take = min(n, longest - used)
                out.append((s, pack, item, 0, take, used))
                used += take
                if used >= longest:
                    pack, used = pack + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.int32()) for i in range(6)], names=["shard", "pack", "item", "start", "length", "position"])

    rows = df.select(F.col(shard).cast("long").alias("s"), F.col(key).cast("long").alias("k"), F.col(length).cast("int").alias("n"), F.col(order).alias("o"))
    return rows.repartition("s").sortWithinPartitions("s", "o", "k").select("s", "k", "n").mapInArrow(run, PACKS)


def balanced(lengths: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Largest differencing: indices in `parts` groups of near-equal sums, of equal numbers if asked."""
    if equal and len(lengths) % parts:
        raise ValueError("items do not divide into equal parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    heap: list[tuple] = []
    count = 0
    step = parts if equal else 1
    for at in range(0, len(order), step):
        state = [[0, []] for _ in range(parts)]
        for j, i in enumerate(order[at : at + step]):
            state[j] = [lengths[i], [i]]
        state.sort(key=lambda s: (-s[0], s[1]))
        heapq.heappush(heap, (-(state[0][0] - state[-1][0]), count, state))
        count += 1
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = [[x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda s: (-s[0], s[1]))
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), count, merged))
        count += 1
    groups = [sorted(s[1]) for s in heap[0][2]] if heap else [[] for _ in range(parts)]
    return sorted(groups, key=lambda g: (-sum(lengths[i] ** 2 for i in g), g[:1]))


def balanced_partitions(df: DataFrame, batch: str, key: str, length: str, parts: int, equal: bool = False) -> DataFrame:
    """batch, key, part: each training batch (bounded) is balanced in one task, batches in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        part = [0] * len(pdf)
        for p, group in enumerate(balanced(pdf[length].astype(int).tolist(), parts, equal and len(pdf) % parts == 0)):
            for i in group:
                part[i] = p
        return pd.DataFrame({"batch": pdf[batch], "item": pdf[key], "part": part})

    rows = df.select(F.col(batch).cast("long").alias(batch), F.col(key).cast("long").alias(key), F.col(length).cast("long").alias(length))
    return rows.groupBy(batch).applyInPandas(run, "batch long, item long, part int")


def micro_batches(lengths: list[int], longest: int, least: int = 1) -> list[list[int]]:
    """As few balanced micro-batches as the token limit allows."""
    n = min(len(lengths), max(least, -(-sum(lengths) // longest)))
    return [sorted(g) for g in balanced(lengths, n)] if n else []


def greedy(lengths: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Each item in its order goes to the group with the least sum, the first of equal ones; equal numbers if asked."""
    if equal and len(lengths) % parts:
        raise ValueError("items do not divide into equal parts")
    extra = sum(lengths) + 1 if equal else 0  # outweighs any difference of sums, so numbers stay level
    heap = [(0, p) for p in range(parts)]
    groups: list[list[int]] = [[] for _ in range(parts)]
    for i, n in enumerate(lengths):
        load, p = heapq.heappop(heap)
        groups[p].append(i)
        heapq.heappush(heap, (load + n + extra, p))
    return groups


def micro_batch_counts(df: DataFrame, batch: str, rank: str, length: str, longest: int, divisor: int = 1, least: int = 1) -> DataFrame:
    """batch, micros: the number of micro-batches that every rank of a batch makes.

    A rank asks for enough micro-batches of `longest` tokens, at least `least` and no more than it has items; the ranks of a
    batch take the largest wish, rounded up to the divisor. Fewer items than that on some rank are an error, as is a longer item.
    """
    own = df.groupBy(batch, rank).agg(F.count("*").alias("n"), F.sum(length).alias("tokens"), F.max(length).alias("top"))
    wish = F.greatest(F.lit(least), F.least(F.col("n"), F.ceil(F.col("tokens") / longest)))
    per = own.groupBy(batch).agg((F.ceil(F.max(wish) / divisor) * divisor).cast("int").alias("micros"), F.min("n").alias("n"), F.max("top").alias("top"))
    sound = F.when(F.col("top") > longest, F.raise_error(F.lit("an item is longer than a micro-batch"))).when(F.col("n") < F.col("micros"), F.raise_error(F.lit("a rank has fewer items than micro-batches")))
    return per.select(batch, F.coalesce(sound.cast("int"), F.col("micros")).alias("micros"))


def rank_micro_batches(df: DataFrame, batch: str, rank: str, key: str, length: str, longest: int, divisor: int = 1, least: int = 1) -> DataFrame:
    """batch, rank, item, micro, micros: balanced micro-batches, as many on each rank of a batch, those of the largest sum of squared lengths first.

    A rank's share of a batch is bounded by the caller and balanced in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        lengths = pdf["n"].astype(int).tolist()
        groups = sorted(balanced(lengths, int(pdf["micros"][0])), key=lambda g: (sum(lengths[i] ** 2 for i in g), min(g, default=0)), reverse=True)
        micro = [0] * len(pdf)
        for m, group in enumerate(groups):
            for i in group:
                micro[i] = m
        return pd.DataFrame({"batch": pdf["batch"], "rank": pdf["rank"], "item": pdf["k"], "micro": micro, "micros": pdf["micros"]})

    counts = micro_batch_counts(df, batch, rank, length, longest, divisor, least)
    rows = df.join(counts, batch).select(F.col(batch).cast("long").alias("batch"), F.col(rank).cast("int").alias("rank"), F.col(key).cast("long").alias("k"), F.col(length).cast("long").alias("n"), "micros")
    return rows.groupBy("batch", "rank").applyInPandas(run, "batch long, rank int, item long, micro int, micros int")


def workload(length: Column, linear: int = 24576) -> Column:
    """Cost of a sequence: linear and quadratic parts."""
    return length * linear + length * length


@F.pandas_udf(StringType())
def json_plain(texts: pd.Series) -> pd.Series:
    """JSON with \\u escapes written out as characters, compact; texts without escapes or that do not parse stay."""

    def one(t: str | None) -> str | None:
        if t is None or "\\u" not in t:
            return t
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return t

    return texts.map(one)


def boxed(text: str) -> str | None:
    """Contents of the last balanced \\boxed{}, or what follows '\\boxed ' up to a dollar sign."""
    at = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
    if at < 0:
        return None
    start = at + len("\\boxed") if text.startswith("\\boxed", at) else at + len("\\fbox")
    if text[start : start + 1] == " ":
        return text[start + 1 :].split("$")[0]
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if text[i] == "}" and depth == 0:
            return text[start + 1 : i]
    return None


UNITS = re.compile(r"\\text\{\s[^}]*\}|\\(?:left|right|!|,|;|quad)|\\?%|\\\$|\^\{?\\circ\}?")
HALVES = re.compile(r"\\[td]?frac(\d)(\d)")
SIMPLE = re.compile(r"^(-?\d+)/(\d+)$")


def plain_math(s: str) -> str:
    """One spelling for equal answers: no spacing or units, braced fractions and roots, no leading 'x ='."""
    s = UNITS.sub("", s.replace("\n", "").replace("tfrac", "frac").replace("dfrac", "frac"))
    s = re.sub(r"\\sqrt(\w)", r"\\sqrt{\1}", HALVES.sub(r"\\frac{\1}{\2}", s))
    s = re.sub(r"(?<![0-9])\.(\d)", r"0.\1", s.replace(" ", ""))
    if len(parts := s.split("=")) == 2 and len(parts[0]) <= 2:
        s = parts[1]
    s = SIMPLE.sub(r"\\frac{\1}{\2}", s)
    return "\\frac{1}{2}" if s == "0.5" else s.rstrip(".")


def math_equal(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is None and b is None
    x, y = plain_math(a), plain_math(b)
    if x == y:
        return True
    return expressions.equal(a, b)


@F.pandas_udf(DoubleType())
def math_score(texts: pd.Series, truths: pd.Series) -> pd.Series:
    """1 if the boxed answer of a solution equals the truth, else 0."""
    return pd.Series([float(t is not None and (x := boxed(t)) is not None and math_equal(x, y)) for t, y in zip(texts, truths, strict=True)])


def answer_after_thought(text: Column) -> Column:
    """The trimmed answer after the one think block that a solution begins with; NULL if that is not its form."""
    space, tags = "[\\s]+", {tag: (F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag) for tag in ("<think>", "</think>")}
    trimmed = lambda c: F.regexp_replace(c, f"^{space}|{space}$", "")
    thought = trimmed(F.substring_index(F.substr(text, F.lit(len("<think>") + 1)), "</think>", 1))
    answer = trimmed(F.substring_index(text, "</think>", -1))
    form = text.startswith("<think>") & (tags["<think>"] == 1) & (tags["</think>"] == 1) & (thought != "") & (answer != "")
    return F.when(form, answer)


def point_reward(solution: Column, box: Column, think: bool = True) -> Column:
    """Pointing answers: (score, format, accuracy, num_pred, first_correct, is_collinear); box: (x1, y1, x2, y2).

    An answer is a JSON list of objects, each with two numbers under point_2d. With n points of which the k-th is the first
    inside the box, accuracy is 1 / sqrt(n * k), and -1 / n if none is. Another form, no points, or any three points on one
    line give -1 for both accuracy and score; otherwise the score is 1 more than accuracy.
    """
    # A solution is often a long expression: it is made once, not at each of its uses.
    answer = let(solution, answer_after_thought) if think else solution
    listed = lambda t: F.when(F.instr(t, "[") > 0, F.substr(t, F.instr(t, "[")))
    objects = F.from_json(let(answer, listed), "array<struct<point_2d:array<double>>>")
    whole = lambda p: F.size(p).eqNullSafe(F.lit(2)) & F.coalesce(F.forall(p, lambda x: x.isNotNull()), F.lit(False))
    sound = lambda points: F.when(F.coalesce(F.forall(points, whole), F.lit(False)), points)

    def on_line(a: Column, b: Column, c: Column) -> Column:
        return let(F.array((b[1] - a[1]) * (c[0] - a[0]), (c[1] - a[1]) * (b[0] - a[0])), lambda x: F.abs(x[0] - x[1]) <= 1e-9 * F.greatest(F.abs(x[0]), F.abs(x[1])))

    def seen(p: Column) -> Column:
        after = lambda i: F.slice(p, i + 2, F.size(p))
        line = F.exists(F.transform(p, lambda a, i: F.exists(F.transform(after(i), lambda b, j: F.exists(F.slice(p, i + j + 3, F.size(p)), lambda c: on_line(a, b, c))), lambda x: x)), lambda x: x)
        inside = F.transform(p, lambda a: a[0].between(box["x1"], box["x2"]) & a[1].between(box["y1"], box["y2"]))
        return F.struct(F.coalesce(line, F.lit(False)).alias("line"), F.coalesce(F.array_position(inside, F.lit(True)), F.lit(0)).alias("first"), F.coalesce(F.nullif(F.size(p), F.lit(-1)), F.lit(0)).alias("n"))

    def judged(s: Column) -> Column:
        fine = (s["n"] > 0) & ~s["line"]
        raw = F.when(~fine, F.lit(-1.0)).when(s["first"] > 0, 1 / F.sqrt(s["first"] * s["n"])).otherwise(-1.0 / s["n"])
        return F.struct(
            (raw + fine.cast("double")).alias("score"), fine.cast("double").alias("format"), raw.alias("accuracy"), F.when(fine, s["n"]).otherwise(F.lit(0)).alias("num_pred"),
            (fine & (s["first"] == 1)).cast("int").alias("first_correct"), s["line"].cast("int").alias("is_collinear"),
        )

    return let(let(let(objects, lambda o: sound(F.transform(o, lambda x: x["point_2d"]))), seen), judged)
