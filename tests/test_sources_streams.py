"""Round trips through files, and stateful streams."""

from __future__ import annotations

import io
import json
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from brindle.sources import io as S
from brindle.streaming import stateful as T


def test_parquet_folders(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/a/b")
    spark.range(5).write.parquet(f"{tmp_path}/a/c")
    (tmp_path / "a" / "broken.parquet").write_bytes(b"no parquet")
    (tmp_path / "a" / "note.txt").write_text("x")
    assert S.read_dir(spark, f"{tmp_path}/a", skip_corrupt=True).count() == 15
    files = S.mixed_paths(spark, [f"{tmp_path}/a/b", f"{tmp_path}/a/b", f"{tmp_path}/none", f"{tmp_path}/a/note.txt"])
    assert files == sorted(set(files)) and spark.read.parquet(*files).count() == 10
    S.write_text(spark, f"{tmp_path}/list.json", json.dumps(files))
    assert S.read_filelist(spark, f"{tmp_path}/list.json").count() == 10


def test_shards(spark, tmp_path):
    names = S.write_sharded(spark.range(25), f"{tmp_path}/s", 10, ["id"])
    assert [n.rsplit("/", 1)[1] for n in names] == [f"part-0000{i}-of-00003.parquet" for i in range(3)]
    assert [spark.read.parquet(n).count() for n in names] == [10, 10, 5]
    assert S.read_filelist(spark, f"{tmp_path}/s/file_list.json").count() == 25


def test_documents_and_tables(spark, tmp_path):
    doc = {"model_name": "m", "task_name": "t", "split": "test", "total_time": 1.5, "samples": {"1": {"prompt": "p", "generations": ["a", "b"], "ground_truth": "g", "logprobs": [0.1], "metadata": {"uid": "5"}}}}
    S.write_results(spark, f"{tmp_path}/g.json", doc)
    row = S.read_generations(spark, f"{tmp_path}/g.json").first()
    assert (row["sample_id"], row["generations"], row["metadata"]["uid"]) == ("1", ["a", "b"], "5")
    (tmp_path / "r.csv").write_bytes("﻿name,rows \nx, 12 \n".encode())
    assert S.read_csv(spark, f"{tmp_path}/r.csv", "name string, rows int").first()["rows"] == 12
    S.write_jsonl(spark.range(3), f"{tmp_path}/j", 7)
    assert S.read_jsonl(spark, f"{tmp_path}/j/step=7").count() == 3
    odd = spark.createDataFrame([(0, "a|b\nc"), (1, None)], "id int, `x.y` string").coalesce(1)
    assert [r["line"] for r in S.markdown_lines(odd).orderBy("place").collect()] == ["| id | x.y |", "| --- | --- |", "| 0 | a\\|b c |", "| 1 |  |"]


def test_tar_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name, data in (("1.txt", b"hello"), ("1.json", b"{}")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = {(r["key"], r["ext"]): bytes(r["data"]) for r in S.read_tar_shards(spark, str(tmp_path)).collect()}
    assert rows == {("1", "txt"): b"hello", ("1", "json"): b"{}"}


def test_epochs_and_reuse(spark, tmp_path):
    pairs = S.epochs(spark.createDataFrame([(f"f{i}",) for i in range(20)], "f string"), "f", 3, 1).collect()
    assert len({(r["f"], r["epoch"]) for r in pairs}) == 60 and sorted(r["place"] for r in pairs) == list(range(60))
    path = f"{tmp_path}/dump"
    assert S.dump_or_load(spark.range(4), path).count() == 4 and S.dump_or_load(spark.range(9), path).count() == 4
    S.copy(spark, path, f"{tmp_path}/copy")
    assert S.exists(spark, f"{tmp_path}/copy/_SUCCESS") and not S.exists(spark, f"{tmp_path}/gone")


def test_schema_rules(spark):
    good = '[{"role": "user", "content": [{"type": "text", "text": "x"}]}]'
    df = spark.createDataFrame([(good, "{}", None), (None, "{}", '[{"type": "text", "text": "x"}]'), (good.replace("user", "bot"), "{}", None), (good, "[", None)], "messages string, metadata string, segments string")
    assert S.invalid_rows(df).count() == 2
    wide = S.canonical(spark.createDataFrame([("nan", "a")], "label string, source string")).first()
    assert wide["label"] is None and wide["source"] == "a" and wide["uuid"] is None
    assert S.union_by_name(spark.range(1), spark.range(1).withColumn("x", F.lit(1))).count() == 2


def stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def buffered(batches, capacity, fetched):
    """A plain buffer per lane: what goes out in order, then what is left in order."""
    held, out = {}, {}
    for rows in batches:
        for lane, k, v, _ in sorted(rows, key=lambda r: (r[3], r[1])):
            mine = held.setdefault(lane, {})
            mine[k] = v
            if len(mine) >= capacity or int(k[-16:], 16) % 10_000 < int(10_000 * fetched):
                out.setdefault(lane, []).append((min(mine), mine.pop(min(mine))))
    return {lane: out.get(lane, []) + sorted(mine.items()) for lane, mine in held.items()}


@pytest.mark.parametrize("fetched", [0.0, 0.3])
def test_shuffle_buffer_gives_every_sample_once(spark, tmp_path, fetched):
    import random
    from hashlib import md5

    rng = random.Random(2)
    rows = [(f"l{rng.randint(0, 2)}", f"{rng.randint(0, 1):08}|{md5(str(i % 70).encode()).hexdigest()[:16]}", str(i), i) for i in range(90)]
    batches = [rows[:30], rows[30:60], rows[60:]]
    schema = "lane string, k string, v string, o long"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/n=*")
    made = T.shuffle_buffer(source, "lane", "k", "v", 8, "o", fetched)
    got = {}
    for r in T.drained(made, "buffered", rest=T.left_in_buffer).collect():
        got.setdefault(r["lane"], []).append((r["k"], r["v"]))
    want = buffered(batches, 8, fetched)
    assert {lane: sorted(x) for lane, x in got.items()} == {lane: sorted(x) for lane, x in want.items()}
    part = T.drained(T.shuffle_buffer(source, "lane", "k", "v", 8, "o", fetched), "buffered")
    assert part.count() < sum(map(len, want.values()))


def steered(rows, most):
    """A plain simulation of one lane."""
    version = stale = flying = queued = 0
    waiting, out = [], []
    for _, what, item in sorted(rows):
        if what == "submit":
            waiting.append(item)
        elif what == "done" and flying:
            flying, queued = flying - 1, queued + 1
        elif what == "consume" and queued:
            queued -= 1
        elif what == "version":
            version, stale = version + 1, flying + queued
        while waiting and stale < most and queued < most:
            flying, stale = flying + 1, stale + 1
            out.append((waiting.pop(0), version, stale))
    return out


def test_rollouts_pause_and_go_on_with_versions(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(f"l{i % 2}", i, rng.choice(["submit"] * 6 + ["done"] * 3 + ["consume"] * 2 + ["version"]), 1000 + i) for i in range(300)]
    schema = "lane string, o long, kind string, k long"
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/n=*")
    out = T.drained(T.rollout_control(source, "lane", "o", "kind", "k", 4, 0.5, 2), "steer").collect()
    for lane in ("l0", "l1"):
        want = steered([(o, kind, k) for x, o, kind, k in rows if x == lane], 12)
        assert sorted((r["sample"], r["version"], r["staleness"]) for r in out if r["lane"] == lane) == sorted(want)
        assert max(s for _, _, s in want) == 12 and len(want) < sum(x == lane and kind == "submit" for x, _, kind, _ in rows)


def test_running_packs_and_queue(spark, tmp_path):
    rows = [[("l", i, 10) for i in range(j * 10, j * 10 + 10)] for j in range(3)]
    source = stream(spark, tmp_path, rows, "lane string, k long, n int")
    packs = T.drained(T.running_packs(source, "lane", "k", "n", 64), "packs").collect()
    assert len(packs) == 4 and all(len(r["items"].split(",")) == 7 for r in packs)
    whole = T.drained(T.running_packs(source, "lane", "k", "n", 64), "packs", rest=T.open_packs).collect()
    assert sorted(int(i) for r in whole for i in r["items"].split(",")) == list(range(30)) and sorted(r["tokens"] for r in whole) == [20, 64, 64, 64, 64]
    counts = T.drained(T.bounded_queue(source, "lane", "k", 12), "queue", "update").collect()
    assert max(r["dropped"] for r in counts) == 18 and max(r["queued"] for r in counts) == 12


def test_late_rows_are_dropped(spark, tmp_path):
    hours = lambda *h: [(f"2024-01-01 {x:02}:00:00", 1.0) for x in h]
    for part in (hours(1, 2), hours(10), hours(1), hours(20)):
        spark.createDataFrame(part, "t string, value double").select(F.col("t").cast("timestamp").alias("t"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("t timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = T.drained(T.windowed_counts(source, "t", "1 hour", None, "1 hour"), "late").collect()
    assert sum(r["n"] for r in out) <= 4


def test_staleness():
    assert T.must_pause(100, 32, 0.5, 2) and not T.must_pause(95, 32, 0.5, 2) and T.staleness_after_sync(3, 4) == 7
