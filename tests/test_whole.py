"""Queries over whole texts and whole tables against plain Python versions."""

from __future__ import annotations

import math
import os
import random
import re
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.functions import arrays as A
from brindle.functions import text as T
from brindle.operators import metrics as M
from brindle.plans import catalogue
from brindle.plans.registry import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in Tables(spark, SF).documents.select("doc_id", "text").collect()}


def brute_mask(ids, start, end):
    on, out = False, []
    for i in range(len(ids)):
        out.append(int(on))
        ends = lambda p: tuple(ids[max(i - len(p) + 1, 0) : i + 1]) == p  # noqa: B023, E731
        on = not ends(end) if on else ends(start)
    return out


def test_loss_mask_of_whole_texts(spark, texts):
    found = {r["doc_id"]: r["m"] for r in catalogue.QUERIES["fn_loss_mask"](spark, SF).collect()}
    assert found == {d: None if t is None else "".join(map(str, brute_mask([ord(c) for c in t], (32,), (46,)))) for d, t in texts.items()}
    assert max(map(len, filter(None, found.values()))) > 400


def test_loss_mask_across_parts(spark):
    rng = random.Random(3)
    rows = [[rng.randint(1, 3) for _ in range(n)] for n in (0, 1, 2, A.PART - 1, A.PART, A.PART + 1, 3 * A.PART, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>")
    for start, end in (((1, 2), (3, 1)), ((1, 1), (1, 2, 3)), ((2,), (2,))):
        for r in df.select("i", A.loss_mask(F.col("ids"), start, end).alias("m")).collect():
            assert r["m"] == brute_mask(rows[r["i"]], start, end)


def test_loss_mask_of_odd_rows(spark):
    rows = [None, [], [1, None, 2, 3, None], [2], [3, 3, 2, 3, 2, 2]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<bigint>").coalesce(1)
    for start, end in (((2,), (3,)), ((2,), (3, 2)), ((1, 2), (2, 3))):
        assert [r["m"] for r in df.select("i", A.loss_mask(F.col("ids"), start, end).alias("m")).orderBy("i").collect()] == [None if r is None else brute_mask(r, start, end) for r in rows]
    odd = [None, "", "é 😀x. .y", "a<b>c", "<<b>", "a<b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, t string").coalesce(1)
    for start, end in ((" ", "."), ("<b", "b>")):
        got = [r["m"] for r in df.select("i", A.text_loss_mask(F.col("t"), start, end).alias("m")).orderBy("i").collect()]
        assert got == [None if x is None else "".join(map(str, brute_mask([ord(c) for c in x], tuple(map(ord, start)), tuple(map(ord, end))))) for x in odd]


def test_loss_mask_time_by_the_id(spark):
    """Four million characters, and four million ids: more than 10 seconds by a lambda for each."""
    began = time.time()
    got = spark.range(200).select(A.text_loss_mask(F.repeat(F.lit("ab c. "), 3334), " ", ".").alias("m")).agg(F.sum(F.length("m") - F.length(F.replace("m", F.lit("1"), F.lit("")))).alias("ones")).first()["ones"]
    # Of each six characters, c and the stop, and from the second on the two before the next space, and the space.
    assert got == 200 * sum(brute_mask([ord(c) for c in "ab c. " * 3334], (32,), (46,)))
    ids = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: i % 6)
    ones = spark.range(200).select(F.aggregate(A.loss_mask(ids, (2,), (4,)), F.lit(0), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0]
    assert ones == 200 * sum(brute_mask([i % 6 for i in range(20_000)], (2,), (4,)))
    assert time.time() - began < 30


def brute_answer(text):
    plain = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", plain).split())


def test_normalised_answers_of_whole_texts(spark, texts):
    found = {r["doc_id"]: r["answer"] for r in catalogue.QUERIES["fn_normalize_answer"](spark, SF).collect()}
    assert found == {d: None if t is None else brute_answer(t) for d, t in texts.items()}


def test_normalised_answers_outside_ascii(spark):
    odd = ["The naïve a b", "éa the öa an à a", "a\u00a0the\u2003x\x1cy\x0bz", "日a本 a 語", "AN Éan, THE-END", "", " a ", "the_a x"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", T.normalised_answer(F.col("t")).alias("a")).collect()
    assert {r["i"]: r["a"] for r in rows} == {i: brute_answer(t) for i, t in enumerate(odd)}


def brute_bleu(c, r, longest=4):
    total = 0.0
    for n in range(1, longest + 1):
        mine, theirs = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (c, r))
        hits, add = sum((mine & theirs).values()), float(n > 1)
        if not hits + add:
            return 0.0
        total += math.log((hits + add) / (max(len(c) - n + 1, 0) + add))
    return math.exp(total / longest) * (math.exp(1 - len(r) / len(c)) if len(c) < len(r) else 1.0)


def test_bleu_of_whole_texts(spark, texts):
    found = {r["doc_id"]: r["bleu"] for r in catalogue.QUERIES["agg_bleu"](spark, SF).collect()}
    ids = sorted(texts)
    words = {d: [] if texts[d] is None else texts[d].split(" ") for d in ids}
    assert set(found) == set(ids)
    for d, e in zip(ids, ids[1:] + ids[:1], strict=True):
        assert found[d] == pytest.approx(brute_bleu(words[d], words[e]), abs=2e-6)
    assert any(0 < x < 1 for x in found.values())


def test_bleu_of_partial_overlaps(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for i in range(60)]
    rows += [(60, ["the"] * 7, ["the", "cat", "the"]), (61, ["a"], ["a", "b", "c"]), (62, None, ["a"]), (63, ["a"], None), (64, ["a b", "c"], ["a", "b c"]), (None, ["a", "b"], ["a", "b"])]
    df = spark.createDataFrame(rows, "k int, c array<string>, r array<string>")
    got = {r["k"]: r["bleu"] for r in M.bleu_rows(df, "k", "c", "r").collect()}
    assert len(got) == len(rows)
    for k, c, r in rows:
        assert got[k] == pytest.approx(brute_bleu(c or [], r or []), abs=1e-9)


@pytest.mark.parametrize("size", [1, 7, 1437])
def test_batch_algebra_takes_all_rows(spark, tmp_path, size):
    # Sizes that divide by nothing in use; the keys have gaps and come out of order.
    keys = [3 * i + 1 for i in range(size)]
    spark.createDataFrame([(k,) for k in reversed(keys)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = lambda name: sorted(tuple(r) for r in catalogue.QUERIES[f"dp_{name}"](spark, str(tmp_path)).select(*fields).collect())
    fields = ["row_id", "k"]
    n = size
    assert got("repeat") == [(3 * i + j, k) for i, k in enumerate(keys) for j in range(3)]
    assert got("tile") == list(enumerate(keys * 3))
    assert got("concat") == list(enumerate(keys * 2))
    assert got("reorder") == list(enumerate(reversed(keys)))
    assert got("reverse_idx") == list(enumerate(keys))
    assert got("select_idxs") == [(i, keys[i * 31 % n]) for i in range(2 * n)]
    assert got("pad") == [(i, keys[i % n]) for i in range(n + -n % 1024)]
    assert got("unpad") == list(enumerate(keys))
    fields = ["chunk", "piece", "n"]
    assert got("chunk") == sorted((*key, m) for key, m in Counter((i // -(-n // 20), i // 64) for i in range(n)).items())
    fields = ["mini", "n"]
    assert got("iterator") == sorted(Counter(i // 100 for i in range(n)).items())


def test_bleu_counts_within_rows(spark):
    """A pair's n-grams are never rows of a shuffle."""
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "c"])], "k int, c array<string>, r array<string>")
    plan = M.bleu_rows(df, "k", "c", "r")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
