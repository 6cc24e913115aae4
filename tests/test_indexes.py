"""Stored indexes: recall of the vector index against exact search, exactness and skipping of the text index."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import similar, text_index, vector_index


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(4)
    middles = rng.normal(size=(20, 24))
    x = middles[rng.randint(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x[:1000] = x[0] + 0.3 * rng.normal(size=(1000, 24))  # a third of all rows share a cell
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)] + [(None, x[5].tolist()), (5000, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


def test_vector_index_recalls_exact_neighbours(spark, points, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK", 200)
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    rows = points.where("id IS NOT NULL")
    vector_index.build(rows, "id", "v", str(tmp_path / "x"), vector_index.fit(rows, "id", "v", 20, 12, 256, sample=2000))
    lists, model = vector_index.load(spark, str(tmp_path / "x"))
    assert lists.count() == 3000 and lists.groupBy("cell", "chunk").count().agg({"count": "max"}).first()[0] < 300
    asked = rows.where("id % 50 = 0")
    found = vector_index.search(lists, model, rows, asked, "id", "v", 10, 8, 200).cache()
    truth = similar.knn(rows, asked, "id", "v", 10)
    out = vector_index.recall(found, truth).first()
    assert out["queries"] == 60 and out["recall"] >= 0.9
    exact = {(r["query"], r["candidate"]): r["score"] for r in truth.collect()}
    got = [(r["query"], r["candidate"], r["score"]) for r in found.collect()]
    assert all(abs(exact[q, c] - s) < 1e-9 for q, c, s in got if (q, c) in exact) and all(q != c for q, c, _ in got)


def test_all_cells_and_rows_are_exact(spark, points, tmp_path):
    rows = points.where("id < 400")
    vector_index.build(rows, "id", "v", str(tmp_path / "y"), vector_index.fit(rows, "id", "v", 8, 4, 16))
    lists, model = vector_index.load(spark, str(tmp_path / "y"))
    asked = rows.where("id % 40 = 0")
    found = {(r["query"], r["candidate"], r["place"]) for r in vector_index.search(lists, model, rows, asked, "id", "v", 5, 8, 400).collect()}
    assert found == {(r["query"], r["candidate"], r["place"]) for r in similar.knn(rows, asked, "id", "v", 5).collect()}


def test_a_search_reads_its_cells_only(spark, points, tmp_path):
    rows = points.where("id < 1500")
    vector_index.build(rows, "id", "v", str(tmp_path / "z"), vector_index.fit(rows, "id", "v", 16))
    lists, _ = vector_index.load(spark, str(tmp_path / "z"))
    plan = lists.where("cell IN (3, 5)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan and lists.where("cell = 3").select(F.input_file_name().alias("f")).where("f NOT LIKE '%cell=3%'").count() == 0
    nothing = vector_index.search(lists, vector_index.load(spark, str(tmp_path / "z"))[1], rows, rows.where("id < 0"), "id", "v")
    assert nothing.collect() == []


def plain_bm25(docs, queries, k):
    held = {d: t.lower().replace(".", " ").split() for d, t in docs}
    avg, df = sum(map(len, held.values())) / len(held), Counter(w for ws in held.values() for w in set(ws))
    idf = {w: math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = {}
    for q, text in queries:
        score = {}
        for d, ws in held.items():
            tf = Counter(ws)
            parts = [idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for w in set(text.split()) if w in tf]
            if parts:
                score[d] = sum(parts)
        out[q] = [d for d, _ in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return out


def test_text_index_is_exact_and_skips_blocks(spark, tmp_path):
    rng = np.random.RandomState(1)
    names = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    docs = [(i, "common " + " ".join(rng.choice(names, rng.randint(3, 60), p=share / share.sum())) + ".") for i in range(1500)] + [(2000, "")]
    queries = [(0, "common w250"), (1, "w0 w1"), (2, "w280 w290 absent"), (3, "common"), (4, "absent"), (5, "w3 w3 w200 common w0")]
    df = spark.createDataFrame([*docs, (2001, None)], "id long, t string").repartition(4)
    text_index.build(df, "id", "t", str(tmp_path / "t"), size=16)
    asked = spark.createDataFrame(queries, "id long, t string")
    got = {}
    for r in sorted(text_index.search(spark, str(tmp_path / "t"), asked, "id", "t", 5).collect(), key=lambda r: r["place"]):
        got.setdefault(r["query"], []).append(r["doc"])
    want = plain_bm25([*docs, (2001, "")], queries, 5)
    assert got == {q: d for q, d in want.items() if d}
    terms = text_index.asked_terms(spark, str(tmp_path / "t"), asked, "id", "t")
    chosen = {r["query"]: r["count"] for r in text_index.chosen_blocks(spark, str(tmp_path / "t"), terms, 5).groupBy("query").count().collect()}
    blocks = spark.read.parquet(str(tmp_path / "t" / "blocks"))
    held = {r["query"]: r["count"] for r in terms.select("query", "term").join(blocks, "term").groupBy("query").count().collect()}
    assert blocks.where("size(docs) > 16").count() == 0 and held[3] > 90
    assert chosen[3] < held[3] / 4 and chosen[1] < held[1], (chosen, held)


def test_text_index_shuffles_postings_once(spark, tmp_path):
    """Rows of one id and length are one document; otherwise the only shuffle of postings is the one into their order."""
    docs = [(i, f"w{i % 7} w{i % 5} w{i % 5} all") for i in range(300)]
    for name, rows in (("one", docs), ("two", [*docs, (3, "all all w1 w2"), (3, "w9")])):
        text_index.build(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", str(tmp_path / name), size=8)
        held = {}
        for r in spark.read.parquet(str(tmp_path / name / "blocks")).collect():
            assert 0 < len(r["docs"]) <= 8 and r["impacts"] == sorted(r["impacts"], reverse=True) and r["top"] == r["impacts"][0]
            held.setdefault(r["term"], []).extend(r["docs"])
        want = {(d, len(t.split()), w) for d, t in rows for w in t.split()}
        assert {t: sorted(d) for t, d in held.items()} == {w: sorted(d for d, _, x in want if x == w) for w in {w for *_, w in want}}
        blocks = spark.read.parquet(str(tmp_path / name / "blocks"))
        assert blocks.count() < sum(len(d) // 8 + 1 for d in held.values()) + 8
    asked = spark.createDataFrame([(1, "w1 w4")], "id long, t string")
    plan = text_index.search(spark, str(tmp_path / "one"), asked, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(term") == 0 and plan.count("BroadcastHashJoin") == 1
    plan = text_index._counted(spark.createDataFrame([(1, ["a"])], "doc long, w array<string>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
