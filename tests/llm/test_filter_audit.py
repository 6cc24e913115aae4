"""The filter audit against applying the filters one after the other, for each of the 120 orders."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from brindle.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, failed string, quality string, digest string"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(row, first):
    doc, text, _ = row
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    found["E"] = doc is not None and first[text] is not None and first[text] < doc
    return {f for f, x in found.items() if x}


def plain(rows, labels):
    first = defaultdict(lambda: None)
    for doc, text, _ in rows:
        if doc is not None and (first[text or ""] is None or doc < first[text or ""]):
            first[text or ""] = doc
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    docs = [(s or "", fails((d, t, s), first), d in good, d in toxic) for d, t, s in rows]
    out, credit = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(here), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in here), sum(d[3] for d in here)]
                credit[part, f] += len(here)
                gone += here
    return {k: (*v, credit[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def odd_rows():
    long = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", " ", long, long + " $", ("same " * 300), "UPPER " * 220, long.upper(), "short & SHORT", "ünï " * 90, long + "\x0b more", "very long text " * 60_000]
    rows = [(i, t, ("s1", "s2", None, "", "s3")[i % 5]) for i, t in enumerate(texts * 3)]
    return [*rows, rows[3], rows[3], (None, long, "s1"), (None, None, None), (-5, "short & SHORT", "s2")]


@pytest.mark.parametrize("held", [1, 256])
def test_audit_equals_filtering(spark, held, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", held)
    rows = odd_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 30)] + [(3, None, 1), (4, 0, None), (4, 1, 0), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, "p", "f", "q", "d") for r in rows], SCHEMA).repartition(3)
    got = filter_audit.op13_filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(rows, labels)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert tuple(r[c] for c in COUNTS) == want[r["part"], r["filter_order"], r["step"]]


def test_parts_are_flushed(spark):
    rows = [(i, "text", f"part {i}") for i in range(600)]
    docs = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA).coalesce(1)
    got = filter_audit.op13_filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.groupBy("part").count().where("count = 600").count() == 600
    assert got.where("removed > 0").select("filter_order", "step").distinct().count() == 120 + 60


def test_empty_tables(spark):
    empty = filter_audit.op13_filter_audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.collect() == []
