"""Conversation repair against exhaustive search and a plain version of the whole contract."""

from __future__ import annotations

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import defaultdict

import pytest

from brindle.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, copies string, head string"
SF = "/root/testdata/sf0.001"


def brute(rows):
    """Least (cost, audit) by best-first search over label strings; rows: (initial, fault)."""
    queue = [(0, "", 0, "")]
    while queue:
        cost, audit, at, out = heapq.heappop(queue)
        if not re.fullmatch(r"(s?(ua)*u?)?", out):
            continue
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", out):
            return cost, audit
        for x in "ua":
            heapq.heappush(queue, (cost + 5, audit + "I", at, out + x))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, out))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 * (fault == repair.TRUNCATED)
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, out + (initial or "?")))
                for x in "ua":
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, out + x))


def coded(rows):
    return bytes(4 * ("sua".index(x) if x and x in "sua" else 3) + f for x, f in rows)


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_edits_equal_exhaustive_search(seed):
    rng = random.Random(seed)
    for _ in range(120):
        rows = [(rng.choice("ssuuuaaax"), rng.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(rng.randint(0, 6))]
        assert repair.cheapest(coded(rows)) == brute(rows), rows


def test_long_conversations_are_linear():
    rows = [("u", 0), ("a", 0)] * 50_000
    assert repair.cheapest(coded(rows)) == (0, "K" * 100_000)
    assert repair.cheapest(coded([("s", 0), *rows, ("u", 0)])) == (2, "K" * 100_001 + "D")
    assert repair.cheapest(b"") == (0, "")


def plain(data):
    """The contract by hand: conv_id -> its columns."""
    convs = defaultdict(list)
    for conv, turn, role, text in data:
        rows = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn is not None, turn or 0, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        rows += [] if fate == 0 else [row] * (2 if fate == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (*r[:3], hashlib.sha256(r[3].encode()).digest()))
        seen, kinds = set(), []
        for _, _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            kinds.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for known, t, *_ in rows if known}
        cost, audit = repair.cheapest(coded([(r[2][:1], k) for r, k in zip(rows, kinds, strict=True)])) if len(rows) > 7 else brute([(r[2][:1], k) for r, k in zip(rows, kinds, strict=True)])
        said, left, turn = [], iter(rows), 0
        for label in audit:
            row = None if label == "I" else next(left)
            if label == "D":
                continue
            turn += not (label == "K" and row[2].startswith("s"))
            said.append(f"{row[2] if label == 'K' else 'user' if turn % 2 else 'assistant'}:{row[3] if row else ''}")
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "Ünï.\x0b", "same?", "same?", "a. b. c", "long words. " * 30_000]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "unknown", "tool"]
    data = [(c, t, rng.choice(roles), rng.choice(texts[:-1])) for c in range(60) for t in range(rng.randint(1, 6))]
    data += [(70, t, "user", "again.") for t in range(400)] + [(71, None, "user", "x."), (71, None, "assistant", "y."), (71, 5, "user", "x."), (71, -3, None, None)]
    data += [(72, 0, "user", texts[-1]), (72, 1, "assistant", "short."), (None, 0, "user", "null id."), (None, None, "assistant", "still."), (73, 1, "user", "rep."), (73, 1, "user", "rep."), (73, 1, "user", "rep.")]
    return data + [(74 + i, 0, "user", "One row.") for i in range(40)]


def test_repair_equals_plain_version(spark):
    data = odd_rows()
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in data], SCHEMA).repartition(3)
    got = repair.op12_repair(df).collect()
    want = plain(data)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[n] for n in NAMES) == want[r["conv_id"]], r["conv_id"]
    assert any(w[6] == "" and w[1:4] == (0, 0, 0) for w in want.values())  # a conversation that lost all its rows


def test_repaired_rows_keep_the_grammar(spark):
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in odd_rows()], SCHEMA)
    rows = repair.damaged(df)
    heads = repair.summaries(rows)
    back = defaultdict(list)
    for r in repair.repaired_rows(rows, heads).collect():
        back[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for r in repair.digests(rows, heads).collect():
        turns = sorted(back[r["conv_id"]])
        assert [p for p, _, _ in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in turns))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest() == r["repaired_sha256"]


def test_empty_table(spark):
    assert repair.op12_repair(spark.createDataFrame([], SCHEMA)).collect() == []
