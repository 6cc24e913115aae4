"""Operators on small frames: properties and constants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators import batch as B
from brindle.operators import groupwise as G
from brindle.operators import metrics as M
from brindle.operators import quantize as Z
from brindle.operators import sampling as R
from brindle.operators import scorers as S
from brindle.operators import sequences as Q
from brindle.operators import similar as U
from brindle.operators.lookup import lookup_arrays


def test_lookup_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(1, [3, 9, 1, 3]), (2, []), (3, None)], "uid int, ids array<bigint>")
    codes = spark.createDataFrame([(1, "a"), (3, "c")], "pid bigint, code string")
    out = {r["uid"]: r["x"] for r in lookup_arrays(df, "uid", {"x": F.col("ids")}, codes, "pid", "code").collect()}
    assert out == {1: ["c", "a", "c"]}


def test_row_ids_are_dense(spark):
    rows = B.with_row_id(spark.range(1000).repartition(7), ["id"]).collect()
    assert sorted((r["row_id"], r["id"]) for r in rows) == [(i, i) for i in range(1000)]


@pytest.fixture
def planned(spark):
    """Sets the number of shuffle partitions and adaptive execution for one test."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in keys]
    yield lambda *values: [spark.conf.set(k, v) for k, v in zip(keys, values, strict=True)]
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


@pytest.mark.parametrize(("partitions", "adaptive"), [("8", "true"), ("64", "false"), ("200", "true")])
def test_row_ids_of_many_wide_rows(spark, planned, partitions, adaptive):
    planned(partitions, adaptive)
    n = 500_000
    wide = spark.range(n).withColumn("h", F.xxhash64("id")).withColumn("pad", F.sha2(F.col("id").cast("string").cast("binary"), 512)).withColumn("more", F.concat("pad", "pad"))
    out = B.with_row_id(wide, ["h", "id"])
    row = out.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("d"), F.count_distinct("id").alias("ids"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
    assert tuple(row) == (n, n, n, 0, n - 1)
    # The order holds: neighbours by row_id rise in h.
    pairs = out.select("row_id", "h").join(out.select((F.col("row_id") + 1).alias("row_id"), F.col("h").alias("before")), "row_id")
    assert pairs.where("before >= h").count() == 0
    per = R.shards(wide.select("id", "pad"), 1000, ["id"]).groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert per.count() == 500 and per.where("n <> 1000 OR lo <> shard * 1000 OR hi <> shard * 1000 + 999").count() == 0


@pytest.mark.parametrize(("partitions", "adaptive"), [("8", "true"), ("64", "false"), ("200", "true")])
def test_auc_of_many_scores(spark, planned, partitions, adaptive):
    planned(partitions, adaptive)
    n = 400_000
    rng = np.random.RandomState(5)
    scores, labels = rng.randint(0, 300_000, n) / 7.0, rng.randint(0, 2, n)
    import pandas as pd

    ranks = pd.Series(scores).rank().to_numpy()
    pos = int(labels.sum())
    exact = (ranks[labels == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    df = spark.createDataFrame(pd.DataFrame({"y": labels, "s": scores})).repartition(16)
    assert M.auc(df, "y", "s").first()["auc"] == pytest.approx(exact, abs=1e-9)


def test_batch_algebra(spark):
    df = B.with_row_id(spark.range(10), ["id"])
    ids = lambda x: [r["id"] for r in x.orderBy("row_id").collect()]
    assert ids(B.take_slice(df, 1, 8, 3)) == [1, 4, 7]
    assert ids(B.repeat(df.where("row_id < 2"), 2)) == [0, 0, 1, 1]
    assert ids(B.repeat(df.where("row_id < 2"), 2, interleave=False, rows=2)) == [0, 1, 0, 1]
    assert ids(B.unfold(B.fold(df, 3, "id"), 3, "id")) == list(range(10))
    padded = B.pad_to(df, 10, 4)
    assert ids(padded) == [*range(10), 0, 1] and ids(B.unpad(padded, 10)) == list(range(10))
    with pytest.raises(ValueError):
        B.chunk_id(10, 3)
    with pytest.raises(Exception, match="batches differ"):
        B.union_columns(df, df.withColumn("id", F.col("id") + 1)).collect()


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(500)
    parts = R.split_exact(df, 100, 42, "id").collect()
    assert len(parts) == 500 and sum(r["part"] == "test" for r in parts) == 100
    again = {r["id"] for r in R.split_exact(df.repartition(5), 100, 42, "id").where("part = 'test'").collect()}
    assert again == {r["id"] for r in parts if r["part"] == "test"}
    assert sorted(r["place"] for r in R.shuffle(df, 1, "id").collect()) == list(range(500))


def test_weighted_draws_follow_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "k int, w double")
    out = R.resample_weighted(df, F.col("w"), 4000, 3, "k").groupBy("k").count().collect()
    counts = {r["k"]: r["count"] for r in out}
    assert sum(counts.values()) == 4000 and 2 not in counts and abs(counts[1] / 4000 - 0.75) < 0.03


@pytest.mark.parametrize(("data", "want"), [([(1, 0.1), (0, 0.2), (1, 0.2), (0, 0.3)], 0.125), ([(1, 0.5), (1, 0.7)], 0.5), ([], 0.0), ([(0, 1.0), (1, 2.0), (1, 3.0)], 1.0)])
def test_auc(spark, data, want):
    got = M.auc(spark.createDataFrame(data, "y int, s double"), "y", "s").first()["auc"]
    assert got == pytest.approx(want)


def test_auc_equals_pairs(spark):
    rng = random.Random(1)
    data = [(rng.randint(0, 1), float(rng.randint(0, 30))) for _ in range(400)]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in data for z, b in data if y > z]
    assert M.auc(spark.createDataFrame(data, "y int, s double").repartition(5), "y", "s").first()["auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_majority(spark):
    votes = lambda v: G.majority(spark.createDataFrame([(1, i, p, x) for i, (p, x) in enumerate(v)], "g int, i int, p string, v double"), ["g"], "p", "v", "i").first()["maj"]
    assert votes([("A", 0.9), ("B", 0.8), ("A", 0.7)]) == 0.9
    assert votes([("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)]) == 0.9


def test_validation_constant(spark):
    df = spark.createDataFrame([("s1", "p1", 0.8), ("s1", "p1", 0.9), ("s2", "p2", 0.7)], "s string, p string, v double")
    out = {(r["source"], r["n"]): r["mean"] for r in G.validation(df.withColumnsRenamed({"s": "source", "p": "prompt"}), "source", "prompt", "v").collect()}
    assert out[("s1", 2)] == pytest.approx(0.85)


def test_bootstrap_tolerance(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 6)], "g int, i int, v double")
    r = G.bootstrap(df, ["g"], "v", "i", 3, 400).first()
    assert 3.5 < r["best_mean"] < 5 and 1 < r["worst_mean"] < 2.5


def test_name_rules(spark):
    data = [("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_reward", 5.0), ("max_reward", 8.0), ("max_reward", 6.0), ("min_error", 0.1), ("min_error", 0.05), ("min_error", 0.2)]
    out = {r["n"]: r["value"] for r in G.reduce_by_name(spark.createDataFrame(data, "n string, v double"), "n", "v").collect()}
    assert out == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}


def test_estimators(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 5.0)], "g string, i int, r double")
    adv = lambda n, *x: {r["i"]: r["advantage"] for r in G.get_estimator(n)(df, "g", "r", *x).collect()}
    assert adv("grpo") == pytest.approx({1: -0.7071, 2: 0.7071, 3: 5.0}, abs=1e-3)
    assert adv("rloo") == pytest.approx({1: -2.0, 2: 2.0, 3: 5.0})
    assert adv("grpo_passk", "i")[1] == 0.0
    with pytest.raises(ValueError):
        G.get_estimator("nothing")
    with pytest.raises(ValueError):
        G.estimator("grpo")(lambda df: df)


def test_scorers(spark):
    df = spark.createDataFrame([("gsm8k", "#### 4", "4"), ("math", "\\boxed{0.5}", "1/2"), ("qa", "<answer>x</answer>", "y")], "s string, a string, t string")
    assert [r["reward"] for r in S.rewards(df, "s", "a", "t").collect()] == [1.0, 1.0, 0.0]
    with pytest.raises(Exception, match="no scorer"):
        S.rewards(df.withColumn("s", F.lit("none")), "s", "a", "t").collect()


def test_similar_users(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "c"), (1, "a")], "uid int, token string")
    out = U.similar_users(tokens, tokens.where("uid = 1"), k=3, max_recall=None).collect()
    assert [(r["candidate"], r["overlap"], r["place"]) for r in out] == [(2, 2, 1)] and out[0]["score"] == pytest.approx(2 / 3)


def test_quantiser_learns(spark):
    rng = np.random.RandomState(0)
    centres = rng.normal(size=(4, 6)) * 5
    data = [(i, (centres[i % 4] + rng.normal(size=6) * 0.1).tolist()) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    books = Z.train(df, "embedding", 2, 8, 5)
    codes = Z.encode(df, "vec_id", "embedding", books)
    decoded = Z.decode(codes, "vec_id", Z.codebook_table(spark, books)).withColumnRenamed("vector", "y")
    loss = Z.reconstruction_loss(df.join(decoded, "vec_id"), "embedding", "y").first()
    assert loss["mse"] < 0.2
    assert [r["token"] for r in Z.vocabulary(spark, 2).orderBy("place").collect()] == ["<s_a_0>", "<s_a_1>", "<s_b_0>", "<s_b_1>", "<s_c_0>", "<s_c_1>", "<|sid_begin|>", "<|sid_end|>"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=40), st.integers(1, 6))
def test_balanced_covers_all(lengths, parts):
    groups = Q.balanced(lengths, parts)
    assert sorted(i for g in groups for i in g) == list(range(len(lengths))) and len(groups) == parts
    if len(lengths) % parts == 0:
        assert {len(g) for g in Q.balanced(lengths, parts, equal=True)} == {len(lengths) // parts}


def test_balance_is_close():
    rng = random.Random(4)
    sums = [sum(g) for g in (lambda x: [[x[i] for i in p] for p in Q.balanced(x, 8)])([rng.randint(1, 4096) for _ in range(256)])]
    assert max(sums) - min(sums) < 100
    assert max(map(sum, [[v[i] for i in g] for v in [[5, 4, 3, 2]] for g in Q.micro_batches(v, 8)])) <= 8


@pytest.mark.parametrize(("workers", "files"), [(1, 100), (4, 100), (8, 25), (16, 5)])
def test_assignment_covers(spark, workers, files):
    from brindle.sources.io import worker_of

    counts = {r["w"]: r["count"] for r in spark.range(files).select(worker_of(F.col("id"), workers).alias("w")).groupBy("w").count().collect()}
    assert sum(counts.values()) == files and max(counts.values()) - min([*counts.values()] if len(counts) == workers else [0]) <= 1


def test_greedy_packs(spark):
    df = spark.createDataFrame([(0, i, 300, f"{i:04}") for i in range(10)], "shard long, k long, n int, o string")
    cut = Q.pack_greedy(df, "shard", "k", "n", "o", 1000).collect()
    assert all(sum(r["length"] for r in cut if r["pack"] == p) == 1000 for p in range(2))
    whole = Q.pack_greedy(df, "shard", "k", "n", "o", 1000, cut=False).collect()
    assert all(r["length"] == 300 for r in whole) and max(r["pack"] for r in whole) == 3


def test_json_and_points(spark):
    df = spark.createDataFrame([('{"a": "\\u00e9"}',), ("{bad \\u00e9",), ("plain",), (None,)], "t string")
    assert [r["x"] for r in df.select(Q.json_plain("t").alias("x")).collect()] == ['{"a":"é"}', "{bad \\u00e9", "plain", None]


POINTS = [
    ("<think>t</think> [{\"point_2d\": [1, 1]}]", 1.0, 0), ("<think>t</think> x [{\"point_2d\": [9, 9]}, {\"label\": \"[\", \"point_2d\": [1, 1]}] y", 0.5, 0), ("<think>t</think>[{\"point_2d\": [9, 9]}, {\"point_2d\": [8, 9]}]", -0.5, 0),
    ("<think>t</think>[{\"point_2d\": [0, 0]}, {\"point_2d\": [9, 1]}, {\"point_2d\": [1, 1]}, {\"point_2d\": [2, 2]}]", -1.0, 1), ("[{\"point_2d\": [1, 1]}]", -1.0, 0), ("<think> </think>[{\"point_2d\": [1, 1]}]", -1.0, 0),
    ("<think>t</think>[[1, 1]]", -1.0, 0), ("<think>t</think>[]", -1.0, 0), ("<think>t</think>none", -1.0, 0), ("<think>t</think>[{\"point_2d\": [1]}]", -1.0, 0), ("<think>t</think>[{\"point_2d\": [1, 1]}", -1.0, 0), (None, -1.0, 0), ("", -1.0, 0),
    ("<think>t</think><think>u</think>[{\"point_2d\": [1, 1]}]", -1.0, 0), ("<think>t</think>[{\"point_2d\": [3, 1]}, {\"point_2d\": [3, 5]}, {\"point_2d\": [3, 9]}]", -1.0, 1), ("<think>t</think>[{\"point_2d\": [0.5, 1.5]}, {\"point_2d\": [7, 1]}, {\"point_2d\": [2, 8]}]", 1 / 3**0.5, 0),
]


def test_point_rewards(spark):
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 2.0), ("y2", 2.0))])
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(POINTS)], "i int, p string")
    for r in df.select("i", Q.point_reward(F.col("p"), box).alias("r")).collect():
        _, accuracy, line = POINTS[r["i"]]
        assert r["r"]["accuracy"] == pytest.approx(accuracy) and r["r"]["is_collinear"] == line, POINTS[r["i"]]
        assert r["r"]["score"] == pytest.approx(-1.0 if accuracy == -1.0 else 1 + accuracy)
    plain = spark.createDataFrame([("[{\"point_2d\": [1, 1]}]",)], "p string").select(Q.point_reward(F.col("p"), box, think=False)["score"]).first()[0]
    assert plain == 2.0


def test_a_solution_is_made_once(spark):
    """A solution that takes a while to make counts once in the plan, and rows of one file are dealt to all cores."""
    from brindle.plans import catalogue

    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 2.0), ("y2", 2.0))])
    made = F.concat(F.lit("<think>t</think>"), F.format_string('[{"point_2d": [%d, 1]}]', F.col("id")))
    df = spark.range(3).select(Q.point_reward(made, box).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("point_2d\": [%d") == 1
    assert [r["r"]["accuracy"] for r in df.collect()] == [1.0, 1.0, 1.0]
    assert catalogue.QUERIES["fn_point_reward"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_code_rewards(spark):
    from brindle.functions import sid

    one, two, three = ("<s_a_1><s_b_2><s_c_3>", "<s_a_4><s_b_5><s_c_6>", "<s_a_7><s_b_8><s_c_9>")
    cases = [
        (f"<think>{two}</think>{one}{one}{two}", one + three, 1 / 3, 1.0, 1.0), (f"<think>a</think>{two}{one}", one, 0.5, 0.0, 1.0), (f"{one}", one, 0.0, 0.0, 1.0), (f"<think>{one}", one, 0.0, 0.0, 1.0),
        (f"<think>{one}</think>{two}", one, 0.0, 0.0, 1.0), ("<think>a</think>", one, 0.0, 0.0, 0.0), (f"<think>a</think>{one}", "", 0.0, 0.0, 0.0), (None, one, 0.0, 0.0, 0.0), (f"<think></think>{one}", None, 0.0, 0.0, 0.0),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, p string, t string")
    p, t = F.col("p"), F.col("t")
    for r in df.select("i", sid.hit_reward(p, t).alias("hit"), sid.first_hit_reward(p, t).alias("first"), sid.pass_rate(p, t).alias("rate")).collect():
        assert (r["hit"], r["first"], r["rate"]) == cases[r["i"]][2:], cases[r["i"]]


def test_relative_error(spark):
    from brindle.operators import quantize

    out = quantize.reconstruction_loss(spark.createDataFrame([([1.0, 2.0, -4.0], [1.5, 2.0, -1.0])], "x array<double>, y array<double>"), "x", "y").first()
    assert out["relative_l1"] == pytest.approx(0.3611, abs=1e-4) and out["mse"] == pytest.approx((0.25 + 9) / 3)


def test_masked_leave_one_out(spark):
    """Token scores and outcomes against plain arithmetic; a group that lacks a sample is left out."""
    rng = random.Random(9)
    rows = []
    for i in range(9):
        n = rng.randint(1, 6)
        mask = [1] + [rng.randint(0, 1) for _ in range(n - 1)]
        rows.append((i, i // 4, [rng.random() for _ in range(n)], mask, float(rng.randint(0, 1))))
    got = {r["i"]: r for r in G.masked_rloo(spark.createDataFrame(rows, "i int, g int, r array<double>, m array<int>, acc double"), "g", 4, "m", {"r": 0.5}, {"acc": 2.0}).collect()}
    assert sorted(got) == list(range(8))
    returns = {}
    for g in (0, 1):
        part = [x for x in rows if x[1] == g]
        base = sum(sum(a * b for a, b in zip(x[2], x[3])) / sum(x[3]) for x in part) / 3
        acc = sum(x[4] for x in part) / 3
        for i, _, r, m, a in part:
            last = max(k for k, v in enumerate(m) if v)
            x = [(0.5 * (v * 4 / 3 - base) + (2.0 * (a * 4 / 3 - acc) if k == last else 0.0)) if m[k] else 0.0 for k, v in enumerate(r)]
            returns[i] = [sum(x[k:]) for k in range(len(x))]
    kept = [v for i, out in returns.items() for v, m in zip(out, rows[i][3]) if m]
    mean = sum(kept) / len(kept)
    var = sum((v - mean) ** 2 for v in kept) / (len(kept) - 1)
    for i, out in returns.items():
        assert got[i]["returns"] == pytest.approx(out) and got[i]["advantages"] == pytest.approx([(v - mean) / (var + 1e-8) ** 0.5 for v in out])


@pytest.mark.parametrize("how", ["pow", "max_min", "max_random"])
def test_resampling_weights(spark, how):
    df = spark.createDataFrame([(i, float(i - 3)) for i in range(9)], "k int, s double")
    got = {r["k"]: r["weight"] for r in R.score_weights(df, "s", how).collect()}
    want = {i: {"pow": (i - 3) ** 2, "max_min": float(i in (0, 8)), "max_random": 0.4 if i == 8 else 0.1}[how] for i in range(9)}
    assert got == pytest.approx({i: w + 1e-8 for i, w in want.items()})
    with pytest.raises(ValueError, match="no resampling weight"):
        R.score_weights(df, "s", "other")


def test_draws_of_very_uneven_weights(spark):
    """One row holds nearly all weight, most hold almost none, some none; draws equal a plain search in cumulative weights."""
    from bisect import bisect_right
    from hashlib import md5
    from itertools import accumulate

    weights = [0.0 if i % 7 == 0 else 2.0**40 if i == 500 else 2.0 ** -(i % 9) for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(weights)), "k int, w double").repartition(5)
    got = {r["draw"]: r["k"] for r in R.resample_weighted(df, F.col("w"), 3000, 5, "k").collect()}
    upto = list(accumulate(weights))
    want = {d: bisect_right(upto, int(md5(f"5|{d}".encode()).hexdigest()[:12], 16) / (1 << 48) * upto[-1]) for d in range(3000)}
    assert got == want
    even = R.resample_weighted(df.where("w > 0 AND w < 2"), F.lit(1.0), 2000, 5, "k").groupBy("k").count()
    assert even.agg(F.sum("count")).first()[0] == 2000 and even.count() > 700


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.RandomState(3)
    groups = {"a": rng.normal(size=501), "b": rng.randint(0, 4, 400).astype(float), "c": np.array([2.5])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("d", None)], "g string, v double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {(r["g"], r["share"]): r["value"] for r in M.percentiles(df, ["g"], "v", shares).collect()}
    assert got == pytest.approx({(g, s): float(np.quantile(x, s)) for g, x in groups.items() for s in shares})
    whole = M.percentiles(df, [], "v", [0.9]).collect()
    assert [r["value"] for r in whole] == pytest.approx([float(np.quantile(np.concatenate(list(groups.values())), 0.9))])


def test_overlaps_of_hot_tokens(spark):
    """Every user has one token in common; steps and pruning are small, so that users and queries span several."""
    from collections import Counter, defaultdict

    rng = random.Random(6)
    rows = [(u, "all") for u in range(300)] + [(u, f"t{rng.randint(0, 25)}") for u in range(300) for _ in range(rng.randint(0, 12))] + [(7, None)]
    own = defaultdict(set)
    for u, x in rows:
        if x is not None:
            own[u].add(x)
    df = spark.createDataFrame(rows, "uid int, token string").repartition(5)
    out = defaultdict(list)
    for r in U.overlaps(df, df.where("uid % 10 = 0"), pool=20, block=7).collect():
        assert (r["nq"], r["nc"]) == (len(own[r["query"]]), len(own[r["candidate"]]))
        out[r["query"]].append((-r["overlap"], r["candidate"]))
    for q in range(0, 300, 10):
        want = sorted((-len(own[q] & own[c]), c) for c in own if c != q)[:20]
        assert sorted(out[q]) == want
    every = {(r["query"], r["candidate"]): r["overlap"] for r in U.overlaps(df, df.where("uid % 10 = 0"), pool=None, block=9).collect()}
    assert every == {(q, c): len(own[q] & own[c]) for q in range(0, 300, 10) for c in own if c != q and own[q] & own[c]}
    import pyarrow as pa

    users = sorted(own)
    batches = [pa.RecordBatch.from_arrays([pa.array(users[i : i + 50]), pa.array([sorted(own[u]) for u in users[i : i + 50]])], names=["uid", "tokens"]) for i in range(0, 300, 50)]
    for most in (3, 40, 10**6):
        found = Counter()
        for b in U._overlapping([3, 5], [sorted(own[3]), sorted(own[5])], 30, True, most)(iter(batches)):
            found.update({(q, c): o for q, c, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)})
        assert found == Counter({(q, c): -o for q in (3, 5) for o, c in sorted((-len(own[q] & own[c]), c) for c in own if c != q)[:30]})


def test_pop_and_rename(spark):
    df = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "row_id long, x int, y string")
    popped, rest = B.pop(df, "y")
    assert popped.columns == ["row_id", "y"] and rest.columns == ["row_id", "x"]
    assert B.rename(df, {"x": "y", "y": "x"}).columns == ["row_id", "y", "x"]
    for wrong in (lambda: B.pop(df, "z"), lambda: B.pop(df, "row_id"), lambda: B.rename(df, {"z": "x"}), lambda: B.rename(df, {"x": "y"})):
        with pytest.raises(ValueError, match="column"):
            wrong()


def test_output_paths(spark):
    from brindle.functions import text

    df = spark.createDataFrame([("/in/a/b.parquet",), ("/inner/b.parquet",), ("c.parquet",), (None,)], "p string")
    assert [r[0] for r in df.select(text.output_path(F.col("p"), "/out/", "/in/")).collect()] == ["/out/a/b.parquet", "/out/b.parquet", "/out/c.parquet", None]
    assert [r[0] for r in df.select(text.output_path(F.col("p"), "/out")).collect()] == ["/out/b.parquet", "/out/b.parquet", "/out/c.parquet", None]


def test_overlaps_by_lists(spark):
    """Dealt as lists, pairs agree with brute force in steps of any size, and a query's pairs are counted in one task."""
    import pyarrow as pa

    rng = random.Random(9)
    own = {u: {f"t{rng.randint(0, 90)}" for _ in range(rng.randint(1, 12))} for u in range(400)}
    df = spark.createDataFrame([(u, x) for u, xs in own.items() for x in xs], "uid int, token string").repartition(5)
    want = {(q, c): len(own[q] & own[c]) for q in range(0, 400, 10) for c in own if c != q and own[q] & own[c]}
    lists = U.overlaps(df, df.where("uid % 10 = 0"), pool=None)
    assert {(r["query"], r["candidate"]): r["overlap"] for r in lists.collect()} == want
    assert "Window" not in lists._jdf.queryExecution().toString() and U._parts(*[df.groupBy("uid").agg(F.collect_set("token").alias("tokens"))] * 2, 4, 1 << 20) == 4
    first = {q: sorted((-n, c) for (p, c), n in want.items() if p == q)[:15] for q in range(0, 400, 10)}
    found = {q: [] for q in first}
    for r in U.overlaps(df, df.where("uid % 10 = 0"), pool=15).collect():
        found[r["query"]].append((-r["overlap"], r["candidate"]))
        assert (r["nq"], r["nc"]) == (len(own[r["query"]]), len(own[r["candidate"]]))
    assert {q: sorted(x) for q, x in found.items()} == first
    got = {q: [] for q in first}
    for r in U.similar_users(df, df.where("uid % 10 = 0"), k=2, pool=15, min_score=0.0).orderBy("query", "place").collect():
        got[r["query"]].append(r["candidate"])
    score = lambda q, n, c: (n / (len(own[q]) + len(own[c]) + n), n, c)
    assert got == {q: [c for *_, c in sorted(score(q, n, c) for n, c in x if -n / len(own[q]) < 0.8)[:2]] for q, x in first.items()}
    who = pa.struct([("id", pa.int64()), ("n", pa.int32())])
    side = lambda users: [{"id": u, "n": len(own[u])} for u in users]
    tokens = sorted(set().union(*own.values()))
    rows = [(part, [q for q in range(part * 10, 400, 20) if t in own[q]], [c for c in own if t in own[c]]) for part in (0, 1) for t in tokens]
    rows = [r for r in rows if r[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 30]], pa.int32()), *[pa.array([side(r[j]) for r in rows[i : i + 30]], pa.list_(who)) for j in (1, 2)]], names=["part", "q", "c"]) for i in range(0, len(rows), 30)]
    for most in (1, 50, 10**6):
        seen = [(q, c, o) for b in U._counting(None, True, None, most)(iter(batches)) for q, c, o in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
        assert len(seen) == len(want) and {(q, c): o for q, c, o in seen} == want
