"""Training-side operators on small frames."""

from __future__ import annotations

import math
import time
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import prompts
from brindle.operators import groupwise as G
from brindle.operators import training as T
from brindle.sources import cache, io, workbook


def tokens(spark, n=300):
    rng = np.random.RandomState(4)
    rows = [(int(i // 10), int(i % 10), float(-rng.rand() * 3), float(-rng.rand() * 3), float(rng.randn() * 2), int(rng.rand() < 0.8)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row int, pos int, logp double, old double, adv double, mask int").repartition(3)


def covariances(rows):
    kept = [r for r in rows if r[5]]
    a, p = (sum(r[i] for r in kept) / len(kept) for i in (4, 2))
    return {(r[0], r[1]): (r[4] - a) * (r[2] - p) for r in rows}, len(kept)


def test_kl_cov_penalises_the_largest(spark):
    rows, df = tokens(spark)
    cov, n = covariances(rows)
    worst = sorted((k for r in rows if r[5] for k in [(r[0], r[1])]), key=lambda k: -cov[k])[: int(n * 0.05)]
    out = T.LOSSES.named("kl_cov")(df, keys=("row", "pos"), share=0.05, coefficient=2.0).collect()
    assert {(r["row"], r["pos"]) for r in out if r["dropped"]} == set(worst)
    for r in out:
        plain = -r["adv"] * math.exp(r["logp"] - r["old"])
        assert r["loss"] == pytest.approx(plain + (2 * abs(r["logp"] - r["old"]) if r["dropped"] else 0))


def test_clip_cov_drops_eligible_tokens_only(spark):
    rows, df = tokens(spark)
    cov, n = covariances(rows)
    out = T.LOSSES.named("clip_cov")(df, keys=("row", "pos"), share=0.03, least=0.5, most=4.0).collect()
    gone = [r for r in out if r["dropped"]]
    assert len(gone) == int(0.03 * n) and all(r["loss"] == 0 and r["mask"] and 0.5 < cov[r["row"], r["pos"]] < 4 for r in gone)
    none = T.LOSSES.named("clip_cov")(df, keys=("row", "pos"), least=1e6, most=1e7).where("dropped").count()
    assert none == 0
    assert T.LOSSES.named("clip_cov")(df.where("false"), keys=("row", "pos")).count() == 0


def test_registries():
    with pytest.raises(ValueError, match="no policy loss"):
        T.LOSSES.named("nothing")
    with pytest.raises(ValueError, match="already"):
        T.LOSSES.register("gpg")(lambda df: df)
    with pytest.raises(ValueError, match="already"):
        T.task("t1", None, None) and T.task("t1", None, None)
    assert {"remax", "reinforce_plus_plus", "gae", "rloo_vectorised"} <= set(G.ESTIMATORS)


def test_validation_at_by_hand(spark):
    df = spark.createDataFrame([("s", "p", i, float(i), "ab"[i % 2]) for i in range(5)] + [("s", "q", 0, 1.0, "a")], "s string, p string, i int, v double, y string")
    out = {r["k"]: r for r in T.validation_at(df, "s", "p", "v", "y", "i", 400).collect()}
    assert sorted(out) == [2, 4, 5] and all(r["prompts"] == 1 for r in out.values())
    best = lambda k: sum((((m + 1) / 5) ** k - (m / 5) ** k) * m for m in range(5))
    for k, r in out.items():
        assert r["best"] == pytest.approx(best(k), abs=0.25) and r["worst"] == pytest.approx(4 - best(k), abs=0.25) and 0 <= r["maj"] <= 4


def test_flops_by_hand(spark):
    shape = T.Shape(hidden=8, layers=2, heads=2, kv_heads=1, intermediate=16, vocabulary=10)
    df = spark.createDataFrame([(3,)], "n int")
    dense = 2 * (8 * 16 * 3 + 8 * (8 + 4 + 4 + 8)) + 2 * 10 * 8
    assert df.select(T.training_flops(F.col("n"), "llama", shape)).first()[0] == 6 * dense * 3 + 12 * 9 * 4 * 2 * 2
    assert df.select(T.training_flops(F.col("n"), "else", shape)).first()[0] == 0


def test_slow_and_failing_scores(spark):
    def score(a, b):
        if a == "slow":
            time.sleep(30)
        return {"score": 0.5} if a == "near" else float({"x": 1}[a])

    df = spark.createDataFrame([("x", "t"), ("slow", "t"), ("near", "t"), ("unknown", "t")], "solution string, truth string")
    began = time.time()
    out = {r["solution"]: r["reward"] for r in T.MANAGERS.named("prime")(df.coalesce(1), score, seconds=0.5).collect()}
    assert out == {"x": 1.0, "slow": 0.0, "near": 0.5, "unknown": 0.0} and time.time() - began < 20


def test_score_of_a_file(tmp_path):
    (tmp_path / "mine.py").write_text("def compute_score(a, b):\n    return len(a) - len(b)\n")
    assert T.loaded(f"{tmp_path}/mine.py")("abc", "b") == 2


def test_generated_rows_are_cut_anywhere(spark):
    from brindle.sources.generated import Counting, read_generated

    whole = Counting().batch(0, 5000).to_pylist()
    for parts in (1, 7):
        out = [r.asDict() for r in read_generated(spark, "brindle.sources.generated:Counting", 5000, parts).collect()]
        assert sorted(out, key=lambda r: r["id"]) == whole
    assert read_generated(spark, "brindle.sources.generated:Counting", 0).count() == 0


def test_dispatch_round_trip(spark):
    batch = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    parts = T.data_parallel(batch, 4, 10)
    assert sorted(r["count"] for r in parts.groupBy("rank").count().collect()) == [3, 3, 3, 3]
    assert sorted(map(tuple, T.collected(parts, "data_parallel").collect())) == sorted(map(tuple, batch.collect()))
    assert T.collected(T.one_to_all(batch, 3), "one_to_all").count() == 10 and T.rank_zero(batch, 3).where("rank > 0").count() == 0


def test_curriculum_prefers_undecided_groups(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("g"))
    sampler = T.Curriculum("id", "g")
    assert sampler.batch(rows, 100, 0).count() == 100
    sampler.update(rows.withColumn("s", F.when(F.col("g") == 0, 1.0).when(F.col("g") == 1, 0.0).otherwise((F.col("id") % 2).cast("double"))), "s")
    seen = {r["g"]: r["count"] for r in sampler.batch(rows, 600, 1).groupBy("g").count().collect()}
    assert seen[2] > 450


def test_prompts(spark):
    code = "<|sid_begin|><s_a_1><s_b_2><s_c_3><|sid_end|>"
    df = spark.createDataFrame([(f"看过{code}{code}商品{code}推荐", ["a"] * 600, ["p1", "p2"]), ("no slot", ["a"], None)], "t string, v array<string>, p array<string>")
    out = [r[0] for r in df.select(prompts.slots_filled(F.col("t"), {"video": F.col("v"), "product": F.col("p")})).collect()]
    assert out == ["看过" + "a" * 512 + "商品p1p2推荐", "no slot"]
    changed = df.select(prompts.codes_replaced(F.col("t"), 1)).first()[0]
    assert changed.count("<|sid_begin|>") == 3 and changed != df.first()["t"] and changed.startswith("看过<|sid_begin|><s_a_")
    odd = spark.createDataFrame([("<|sid_begin|>none<|sid_end|>x",)], "t string").select(prompts.codes_replaced(F.col("t"), 1)).first()[0]
    assert odd == "<|sid_begin|>none<|sid_end|>x"


def test_codes_of_a_long_prompt_are_drawn_once(spark):
    """20,000 blocks in one text: a draw of every block for each of them would be 400 million."""
    code = "<|sid_begin|><s_a_1><s_b_2><s_c_3><|sid_end|>"
    n, began = 20_000, time.time()
    changed = spark.range(1).select(F.repeat(F.lit(f"x{code}"), n).alias("t")).select(prompts.codes_replaced(F.col("t"), 9)).first()[0]
    drawn = lambda i, j: int(md5(f"9|{i}|{j}".encode()).hexdigest()[:8], 16) % 8192
    assert changed == "".join(f"x<|sid_begin|><s_a_{drawn(i, 0)}><s_b_{drawn(i, 1)}><s_c_{drawn(i, 2)}><|sid_end|>" for i in range(n))
    assert time.time() - began < 60


def test_workbook_round_trip(spark, tmp_path):
    rows = [("a <&> \"b\"", 1, 0.1, True, None), (None, -5, 1e300, False, "é\n x "), ("", 0, 2.0, None, "z")]
    read = workbook.sheet_rows(workbook.workbook(["s", "n", "f", "t", "z"], rows))
    assert read[0] == ["s", "n", "f", "t", "z"] and [(*r, *[None] * (5 - len(r))) for r in read[1:]] == rows
    assert [workbook._column(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_cache_keeps_recent_files(spark, tmp_path):
    folder = f"{tmp_path}/cache"
    for i in range(6):
        io.write_text(spark, f"{tmp_path}/f{i}.txt", str(i))
        cache.cached(spark, f"{tmp_path}/f{i}.txt", folder, limit=100)
        time.sleep(0.02)
    again = cache.cached(spark, f"{tmp_path}/f0.txt", folder, limit=100)
    gone = cache.evict(spark, folder, 5)
    left = io.list_files(spark, folder, "", recursive=False)
    assert len(gone) == 3 and len(left) == 3 and any(again in x for x in left)
    with pytest.raises(Exception):  # noqa: B017
        cache.cached(spark, f"{tmp_path}/missing.txt", folder, tries=2, wait=0)
