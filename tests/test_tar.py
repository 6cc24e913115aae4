"""Tar shards written and read by the data source; ranks, reducers and contents of any form."""

from __future__ import annotations

import io
import os
import random
import tarfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import groupwise as G
from brindle.operators import sequences as Q
from brindle.sources import tar


def test_members_come_back_from_small_splits(spark, tmp_path):
    rng = random.Random(1)
    data = [(f"k{i}", rng.choice(["txt", "json", "seg.bin"]), rng.randbytes(rng.choice([0, 1, 511, 512, 513, 9000]))) for i in range(200)]
    df = spark.createDataFrame([(*d, "extra") for d in data], "key string, ext string, data binary, other string").repartition(3)
    tar.write(df, str(tmp_path / "out"))
    shards = sorted(p for p in os.listdir(tmp_path / "out") if p.endswith(".tar"))
    assert len(shards) == 3 and os.listdir(tmp_path / "out" / "_attempts") == []
    back = tar.read(spark, str(tmp_path / "out"), 20_000)
    assert sorted((r["key"], r["ext"], bytes(r["data"])) for r in back.collect()) == sorted(data)
    assert back.rdd.getNumPartitions() > 3 * 5
    splits = tar.Reader(str(tmp_path / "out"), 20_000).partitions()
    assert all(a.shard != b.shard or a.stop == b.start for a, b in zip(splits, splits[1:]))


def test_shards_of_other_writers(spark, tmp_path):
    """Long names, folders, an archive inside an archive, and an empty shard."""
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        t.addfile(tarfile.TarInfo("hidden.txt"))
    for form, name in ((tarfile.GNU_FORMAT, "gnu"), (tarfile.PAX_FORMAT, "pax")):
        with tarfile.open(tmp_path / f"{name}.tar", "w", format=form) as t:
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for key, content in (("x" * 180 + "é.txt", b"long"), ("nested.tar", inner.getvalue()), ("folder/deep.txt", b"deep")):
                info = tarfile.TarInfo(key)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
    with tarfile.open(tmp_path / "empty.tar", "w"):
        pass
    (tmp_path / "note.txt").write_text("no shard")
    for split in (1, 1 << 20):
        got = tar.read(spark, str(tmp_path), split).collect()
        assert sorted((r["shard"], r["key"], r["ext"]) for r in got) == sorted((f"{n}.tar", k, e) for n in ("gnu", "pax") for k, e in (("x" * 180 + "é", "txt"), ("nested", "tar"), ("folder/deep", "txt")))


def test_ranks_share_a_number_of_micro_batches(spark):
    rng = random.Random(3)
    rows = [(b, r, b * 100 + r * 30 + i, rng.randint(1, 90)) for b in range(3) for r in range(2) for i in range(rng.randint(8, 25))]
    df = spark.createDataFrame(rows, "b long, r int, k long, n long")
    out = defaultdict(lambda: defaultdict(list))
    micros = {}
    length = {k: n for _, _, k, n in rows}
    for r in Q.rank_micro_batches(df, "b", "r", "k", "n", 200, 2, 3).collect():
        out[r["batch"], r["rank"]][r["micro"]].append(r["item"])
        micros[r["batch"]] = r["micros"]
    for b in range(3):
        per = [[n for x, y, _, n in rows if (x, y) == (b, r)] for r in range(2)]
        want = max(max(3, min(len(p), -(-sum(p) // 200))) for p in per)
        assert micros[b] == want + want % 2
        for r in range(2):
            groups = out[b, r]
            assert sorted(groups) == list(range(micros[b])) and sorted(k for g in groups.values() for k in g) == sorted(k for x, y, k, _ in rows if (x, y) == (b, r))
            squares = [sum(length[k] ** 2 for k in groups[m]) for m in range(micros[b])]
            assert squares == sorted(squares, reverse=True)
            sums = [sum(length[k] for k in g) for g in groups.values()]
            assert max(sums) - min(sums) <= 2 * max(per[r])
    with pytest.raises(Exception, match="longer than a micro-batch"):
        Q.micro_batch_counts(df, "b", "r", "n", 50).collect()
    with pytest.raises(Exception, match="fewer items"):
        Q.micro_batch_counts(df, "b", "r", "n", 100, divisor=64).collect()


def test_greedy_groups():
    assert Q.greedy([5, 1, 1, 9, 2], 2) == [[0, 3], [1, 2, 4]] or Q.greedy([5, 1, 1, 9, 2], 2) == [[0, 4], [1, 2, 3]]
    groups = Q.greedy([9, 9, 1, 1, 1, 1], 3, equal=True)
    assert sorted(map(len, groups)) == [2, 2, 2] and sorted(i for g in groups for i in g) == list(range(6))
    with pytest.raises(ValueError, match="equal parts"):
        Q.greedy([1, 2, 3], 2, equal=True)


def test_reducers_over_one_resample(spark):
    from hashlib import md5

    if "spread" not in G.REDUCERS:

        @G.reducer("spread")
        def spread(x):
            return float(x.max() - x.min())

    values = {g: [float((g * 7 + i * 3) % 11) for i in range(n)] for g, n in ((1, 5), (2, 1), (3, 8))}
    df = spark.createDataFrame([(g, i, v) for g, x in values.items() for i, v in enumerate(x)], "g long, i int, v double").repartition(3)
    got = {r["g"]: r for r in G.bootstrap_by(df, "g", "v", "i", 4, ["mean", "max", "spread"], 30, seed=7).collect()}
    for g, x in values.items():
        picks = [[x[int(md5(f"7|{g}|{d}|{i}".encode()).hexdigest()[:8], 16) % len(x)] for i in range(1, 5)] for d in range(1, 31)]
        for name, f in (("mean", np.mean), ("max", np.max), ("spread", np.ptp)):
            each = [f(p) for p in picks]
            assert got[g][f"{name}_mean"] == pytest.approx(np.mean(each)) and got[g][f"{name}_std"] == pytest.approx(np.std(each))
    with pytest.raises(ValueError, match="no reducer median"):
        G.bootstrap_by(df, "g", "v", "i", 4, ["median"])
    with pytest.raises(ValueError, match="registered already"):
        G.reducer("mean")(lambda x: 0.0)


CONTENTS = [
    ("plain text", "plain text"), ("", ""), (None, None), ('{"type": "text", "text": "a \\"b\\" é"}', 'a "b" é'), ('[{"type": "text", "text": "a"}, {"type": "image", "image": "i"}, "b", {"type": "text", "text": "c"}]', "abc"), ("[]", None), ('{"type": "image"}', None),
    ("{broken", "{broken"), ("[1, 2", "[1, 2"), ("42", "42"), ("true", "true"), ("null", "null"), ('"quoted"', '"quoted"'), ("[not json]", "[not json]"), ('["x", 5, null, ["y"]]', "x"), (' {"text": "t", "type": "text"} ', "t"),
]


def test_contents_of_any_form(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CONTENTS)], "i int, c string")
    for r in df.select("i", T.content_text(F.col("c")).alias("t")).collect():
        assert r["t"] == CONTENTS[r["i"]][1], CONTENTS[r["i"]]


def test_shards_by_name_are_split(spark, tmp_path):
    """A named shard is read in splits of bounded size, never as one row, and unnamed ones are not read."""
    df = spark.range(200).select(F.col("id").alias("key"), F.lit("txt").alias("ext"), F.repeat(F.lit("x"), 1000).alias("data")).repartition(2)
    tar.write(df, f"{tmp_path}/t")
    names = sorted(str(p) for p in (tmp_path / "t").glob("*.tar"))
    whole, one = tar.read(spark, [f"file://{n}" for n in names], split=10_000), tar.read(spark, [f"file://{names[0]}"], split=10_000)
    assert sorted(int(r["key"]) for r in whole.select("key").collect()) == list(range(200))
    assert 0 < one.count() < 200 and one.rdd.getNumPartitions() > 5
    assert tar.read(spark, []).count() == 0
