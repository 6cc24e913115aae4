"""Quality rules as a bitmask ledger, on DataFrame functions alone.

Every rule is evaluated once per document. The ledger is a written table of the measurements and one bit per failed rule; a
policy is a named, versioned mask over those bits, so policies are applied, compared and ablated on the table without
reading a text again.

Nulls, ties and repeats: a null text has no words and fails `too_short`; every row gets a ledger row, a null id too. Very
long texts are measured whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, word_array, written

#: Rule name -> its test on a ledger's measurements. A rule's bit is its place here; places are never reused.
RULES: dict[str, str] = {
    "too_short": "n_words < 20",
    "repeats_itself": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 6 * n_words",
    "repeated_lines": "n_dup_lines > 4 AND 10 * n_dup_lines > 5 * n_lines",
    "odd_word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "no_letters": "n_letters = 0",
}
#: The rules whose failure the contract calls base_failed.
BASE = ("too_short", "repeats_itself")
#: Policies by version: the rules that remove a document.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": (*BASE, "symbols", "repeated_lines", "odd_word_length", "no_letters")}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, span: int = 8) -> Column:
    """Words that lie in a span-word window which occurs twice or more; span is a power of two.

    Windows are told apart by 64-bit hashes. A window's hash is that of its halves' hashes, so each word is read once and
    a window of 8 takes three steps.
    """
    if span & (span - 1):
        raise ValueError("a window's words must be a power of two")

    def doubled(width: int):
        def both(h: Column) -> Column:
            n = F.size(h) - width
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))

        return both

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in range(span.bit_length() - 1):
        hashes = _let(hashes, doubled(1 << step))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        gaps = _let(_let(ordered, places), lambda p: F.transform(p, lambda x, i: F.least(F.lit(span), F.coalesce(F.get(p, i + 1) - x, F.lit(span)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    any_twice = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none))
    return F.when(F.size(words) > span, any_twice).otherwise(none)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = F.array_remove(word_array(text), "")
    solid = F.translate(text, SPACES, "")
    letterless = F.regexp_replace(text, r"\p{L}+", "")
    base = docs.select(
        "doc_id", words.alias("words"), lines.alias("lines"), F.length(solid).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"), (F.length(text) - F.length(letterless)).alias("n_letters"),
    )
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.col("n_letters").cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with `failed`: bit i is set if rule i fails."""
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed.cast("long"))


def store(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger as a table at `path` (a new one in the shared folder if not given), read back from there."""
    if path is None:
        return written(ledger(docs), "quality-ledger")
    ledger(docs).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """A ledger with `kept`: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablations(rows: DataFrame, versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy version and rule: version, rule, fails (documents that fail it), only (documents that only it removes), removed (documents the policy removes).

    The ledger is summed to one row per distinct mask, at most 2**rules; policies and rules are bits of those masks.
    """
    masks = rows.groupBy("failed").agg(F.count("*").alias("n"))
    tests = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit"), F.lit(mask(POLICIES[v])).cast("long").alias("all")) for v in versions for r in POLICIES[v]])
    each = masks.select("failed", "n", F.explode(tests).alias("t")).select("n", "t.*", F.col("failed").bitwiseAND(F.col("t.all")).alias("own"))
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("version", "rule").agg(
        counted(F.col("own").bitwiseAND(F.col("bit")) != 0).alias("fails"), counted(F.col("own") == F.col("bit")).alias("only"), counted(F.col("own") != 0).alias("removed")
    )


def op10_quality(docs: DataFrame) -> DataFrame:
    base = F.lit(mask(BASE)).cast("long")
    return apply_policy(store(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed"
    )
