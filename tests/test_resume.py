"""Streams that are stopped and resumed give each sample once."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from brindle.streaming import resume

SCHEMA = "file string, epoch long, index long, payload string"


@pytest.fixture
def samples(spark, tmp_path):
    """Six files of samples with repeats, null files and epochs, and indexes beyond one bucket."""
    rng = random.Random(1)
    rows = [(f, e, i, f"{f}{e}{i}") for f in ("a", "b", None) for e in (0, 1, None) for i in (0, 1, 7, 8, 32_767, 32_768, 32_769, 100_000, *range(50, 90))]
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    for n in range(6):
        spark.createDataFrame(rows[n::6], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    return set(rows), lambda only="*": spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / f"part={only}"))


def test_each_sample_once_over_stops_and_runs(spark, samples, tmp_path):
    want, stream = samples
    ledger = resume.Ledger(spark, str(tmp_path / "ledger"), SCHEMA)
    first = ledger.begin()
    with pytest.raises(StreamingQueryException, match="stopped"):
        ledger.drain(stream(), first, stop_after=1)
    part = ledger.rows().count()
    assert 0 < part < len(want)
    second = ledger.begin()  # a new job that replays its input from the start
    with pytest.raises(StreamingQueryException, match="stopped"):
        ledger.drain(stream(), second, stop_after=3)
    ledger.drain(stream(), second)  # the same job goes on from its checkpoint, repeating the micro-batch it was stopped in
    got = Counter((r["file"], r["epoch"], r["index"], r["payload"]) for r in ledger.rows().collect())
    assert got == Counter(want) and second == first + 1
    third = ledger.begin()
    ledger.drain(stream(), third)
    assert ledger.rows().count() == len(want)
    state = ledger.bits().where(f"run = {third} AND batch = -1")
    assert state.agg(resume.done_count(state)).first()[0] == len(want) and state.count() == 9 * 3


def test_bits_lost_after_rows_are_taken_from_the_rows(spark, samples, tmp_path):
    want, stream = samples
    ledger = resume.Ledger(spark, str(tmp_path / "ledger"), SCHEMA)
    run = ledger.begin()
    batch = spark.createDataFrame(sorted(want, key=repr)[:100], SCHEMA)
    ledger.take(batch, run, 0)
    import shutil

    shutil.rmtree(tmp_path / "ledger" / "bits" / f"run={run}" / "batch=0")
    ledger.drain(stream(), ledger.begin())
    assert Counter(tuple(r)[:4] for r in ledger.rows().collect()) == Counter(want)


def test_negative_and_null_indexes_are_no_samples(spark):
    df = spark.createDataFrame([("a", 0, None, "x"), ("a", 0, -1, "y"), ("a", 0, 0, "z")], SCHEMA)
    nothing = spark.createDataFrame([], resume.BITS)
    assert [r["payload"] for r in resume.unseen(df, nothing).collect()] == ["z"]
    assert resume.unseen(df, resume.done_bits(df)).count() == 0
