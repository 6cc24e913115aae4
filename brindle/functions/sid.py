"""Item codes: a triple of codes below 8192, written as tagged text or packed into one BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and code width that other tools of this format read.
BEGIN, END = "<|sid_begin|>", "<|sid_end|>"
TRIPLE = r"<s_a_(\d+)><s_b_(\d+)><s_c_(\d+)>"
WIDTH = 8192
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"


def sid_format(code: Column) -> Column:
    """Tagged text of an array of three codes; NULL unless there are three."""
    text = F.format_string(BEGIN + "<s_a_%d><s_b_%d><s_c_%d>" + END, F.get(code, 0), F.get(code, 1), F.get(code, 2))
    return F.when(F.size(code) == 3, text)


def sid_encode(a: Column, b: Column, c: Column) -> Column:
    return a.cast("long") * (WIDTH * WIDTH) + b.cast("long") * WIDTH + c.cast("long")


def sid_decode(packed: Column) -> Column:
    width = F.lit(WIDTH).cast("long")
    return F.array(F.floor(packed / F.lit(WIDTH * WIDTH)), F.pmod(F.floor(packed / width), width), F.pmod(packed, width))


def sid_parse_all(text: Column) -> Column:
    """Packed codes of all triples in a text, in order."""
    parts = [F.regexp_extract_all(text, F.lit(TRIPLE), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc", strict=True)]), lambda x: sid_encode(x["a"], x["b"], x["c"]))


def sid_parse_first(text: Column) -> Column:
    """Packed code of the first triple, else NULL."""
    return F.get(sid_parse_all(text), 0)


def closed_blocks(text: Column) -> Column:
    """Trimmed contents after each begin tag up to its end tag, without empty ones."""
    cut = F.split(text, r"<\|sid_begin\|>")
    with_end = F.filter(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(END)))
    return F.filter(F.transform(with_end, lambda x: F.trim(F.substring_index(x, END, 1))), lambda x: x != "")


def answer_set(text: Column) -> Column:
    """Distinct codes named by a ground-truth text."""
    return F.array_distinct(closed_blocks(text))


def sid_from_generation(text: Column) -> Column:
    """After the last closing think tag: the first closed block, else what follows an unclosed begin tag, else all of it."""
    said = F.trim(F.substring_index(text, THINK_CLOSE, -1))
    rest = F.substring_index(said, BEGIN, -1)
    opened = F.contains(said, F.lit(BEGIN))
    first = F.trim(F.substring_index(F.get(F.split(said, r"<\|sid_begin\|>"), 1), END, 1))
    return F.when(opened, F.coalesce(first, F.trim(rest))).otherwise(said)


def prefix_token(code: Column, levels: int = 2) -> Column:
    """The first levels of a code joined by '_'."""
    return F.array_join(F.transform(F.slice(code, 1, levels), lambda x: x.cast("string")), "_")


def best_level(predicted: Column, truth: Column) -> Column:
    """100, 10 or 1 for agreement on three, two or one leading codes with any truth, else 0. Both are packed codes."""

    def level(p: Column, t: Column) -> Column:
        shift = lambda x, n: F.floor(x / F.lit(WIDTH**n))
        return F.when(p == t, 100.0).when(shift(p, 1) == shift(t, 1), 10.0).when(shift(p, 2) == shift(t, 2), 1.0).otherwise(0.0)

    return F.transform(predicted, lambda p: F.coalesce(F.array_max(F.transform(truth, lambda t: level(p, t))), F.lit(0.0)))


def partial_hit(predicted: Column, truth: Column) -> Column:
    """Mean best level over predictions; 0 without predictions."""
    levels = best_level(predicted, truth)
    return F.when(F.size(predicted) > 0, F.aggregate(levels, F.lit(0.0), lambda a, x: a + x) / F.size(predicted)).otherwise(F.lit(0.0))


def named_codes(text: Column) -> Column:
    """All triples of a text as they are written, in order; of a null none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TRIPLE), F.lit(0)), F.expr("cast(array() as array<string>)"))


def thought_through(text: Column) -> Column:
    """What follows the first closing think tag; NULL unless both tags are there."""
    closing = F.instr(text, THINK_CLOSE)
    return F.when((closing > 0) & (F.instr(text, THINK_OPEN) > 0), F.substr(text, closing + len(THINK_CLOSE)))


def _agreement(said: Column, truth: Column, score) -> Column:
    """score(predictions, truths), 0 where either is empty."""
    p, t = named_codes(said), named_codes(truth)
    return F.when((F.size(p) > 0) & (F.size(t) > 0), score(p, t).cast("double")).otherwise(F.lit(0.0))


def hit_reward(prediction: Column, truth: Column) -> Column:
    """Distinct predictions after the thought that are true, over all of them with repeats; 0 without a thought."""
    return _agreement(thought_through(prediction), truth, lambda p, t: F.size(F.array_intersect(p, t)) / F.size(p))


def first_hit_reward(prediction: Column, truth: Column) -> Column:
    """1 if the first prediction after the thought is true; 0 without a thought."""
    return _agreement(thought_through(prediction), truth, lambda p, t: F.array_contains(t, F.get(p, 0)))


def pass_rate(prediction: Column, truth: Column) -> Column:
    """1 if any triple of the whole prediction, its thought included, is true."""
    return _agreement(prediction, truth, F.arrays_overlap)
