"""Queries on tables whose keys are larger than those of the driver's small ones."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from brindle.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Orders and line items with part numbers above 60,000, and DuckDB on them."""
    import duckdb

    folder, con = str(tmp_path_factory.mktemp("far")), duckdb.connect()
    for t in ("orders", "lineitem"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df if t == "orders" else df.withColumn("l_partkey", F.col("l_partkey") + 60_000)).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return folder, con


def test_gspo_ratio_is_not_capped(spark, far):
    folder, con = far
    want = dict(con.execute(catalogue.SQL["agg_gspo_ratio"]).fetchall())
    got = {r["uid"]: r["ratio"] for r in catalogue.QUERIES["agg_gspo_ratio"](spark, folder).collect()}
    assert got == pytest.approx(want, rel=1e-12) and max(want.values()) > 22_027


def test_interactive_histories_are_looked_up_once(spark):
    """A user with 300 keywords: the history of 500 items is joined once and not once for each keyword."""
    from brindle.operators import corpus

    keywords = ", ".join(f'"k{i:03}": [{i}, -1, {i + 1}]' for i in range(300)) + ', "none": [], "unknown": [-5]'
    df = spark.createDataFrame([(1, None, list(range(500)), "{" + keywords + "}"), (2, 0, [-3], '{"a": [7]}'), (3, 1, [1], '{"a": [7]}')], "uid long, split int, hist_pid array<long>, keyword_items string")
    codes = spark.range(600).select(F.col("id").alias("pid"), F.format_string("<%d>", "id").alias("code"))
    got = {}
    out = corpus.sft_interactive(df, codes)
    for r in out.collect():
        got[r["uid"], r["keyword"]] = r["messages"]
    assert len(got) == 301 and (3, "a") not in got and (1, "unknown") not in got and (1, "none") not in got
    assert "History: \\nThe viewer asks for: a" in got[2, "a"] and "<7>" in got[2, "a"]
    whole = "".join(f"<{i}>" for i in range(500))
    assert all(f"History: {whole}\\nThe viewer asks for: k{i:03}" in got[1, f"k{i:03}"] and f"<{i}><{i + 1}>\"" in got[1, f"k{i:03}"] for i in range(300))
    scans = catalogue.QUERIES["build_sft_interactive"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert scans.count("lineitem.parquet") == 1
