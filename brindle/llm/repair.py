"""Conversation structure repair by weighted finite-state composition.

Three machines: an acceptor of a conversation's rows in order, a transducer of edits (keep, rerole, delete, insert) and an
acceptor of the role initials `(s?(ua)+)?`. Their composition is never built: `arcs` makes the arcs of a pair (row,
grammar state) when they are first asked for. Its states are ordered by rows read, so one backward sweep in that order
gives each state its cheapest way to the end, with weights (cost, label string) compared in that order. From a state each
label leads to one next state, and a label string fixes its cost, so the least first label of the cheapest arcs is the
least string's first label, and a state needs to remember that label only: four bytes a row.

Two passes, each a sort by conversation and turn that Arrow batches stream through. The first sees narrow rows (a digest
for the text) and holds one byte a row of the conversation at hand, as many as the audit it returns has letters. In the
second each conversation's audit comes ahead of its rows, which are edited and hashed one after the other; nothing else is
held. A conversation is read by one task, for its digest is one sequential hash; rows of equal turn, role and text are
counted before that and travel as one in the first pass. Which row of equal role and text comes first is found by
aggregation and a join on all columns, so a text said very often is no hot key.

Nulls, ties and repeats: null roles and texts are one space, and a null in the damage key too; a null id is a conversation
of its own; rows of equal turn follow each other by role, then by the SHA-256 of the text; an exactly repeated row is a
duplicate. A role's initial is its first character, so any role with the initial u may stand where a user may. Very long
texts and conversations are repaired whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACES, released, written

#: The acceptor of role initials: state -> initial -> next state, from state 0 to a state in FINAL.
GRAMMAR, FINAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = ("su", "ua", "au")
INITIALS = "sua"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@cache
def arcs(row: int | None, state: int) -> tuple[tuple[int, str, bool, int], ...]:
    """(cost, label, whether it reads the row, next state) from a state of the composition; row: 4 * initial + fault, None at the end."""
    found = [(INSERT, "I", False, GRAMMAR[state][out]) for out in ROLES if out in GRAMMAR[state]]
    if row is None:
        return tuple(found)
    initial, fault = INITIALS[row // 4 : row // 4 + 1], row % 4
    found.append((DELETE, "D", True, state))
    if fault not in (BLANK, DUPLICATE):
        extra = UNFINISHED if fault == TRUNCATED else 0
        if initial in GRAMMAR[state]:
            found.append((KEEP + extra, "K", True, GRAMMAR[state][initial]))
        found += [(REROLE + extra, "R", True, GRAMMAR[state][out]) for out in ROLES if out in GRAMMAR[state]]
    return tuple(found)


@lru_cache(1 << 16)
def _before(row: int | None, after: tuple[int, ...]) -> tuple[tuple[int, ...], bytes]:
    """Cheapest costs to the end, and first labels, of a row's four states, from those after it."""
    reading = [min(((c + after[to], label) for c, label, reads, to in arcs(row, s) if reads), default=(0 if s in FINAL else 1 << 40, "")) for s in range(len(GRAMMAR))]
    best = reading
    for _ in GRAMMAR:  # an insertion stays at its row; a path inserts in each state at most once
        best = [min([reading[s], *((c + best[to][0], label) for c, label, reads, to in arcs(row, s) if not reads)]) for s in range(len(GRAMMAR))]
    return tuple(c for c, _ in best), "".join(label or " " for _, label in best).encode()


def step(row: int | None, state: int, label: str) -> int:
    return next(to for _, name, _, to in arcs(row, state) if name == label)


def cheapest(rows: bytes | bytearray) -> tuple[int, str]:
    """The least (cost, audit) of a conversation."""
    after, label = _before(None, (0,) * len(GRAMMAR))
    ahead, labels = 0, [label]
    for row in reversed(rows):
        after, label = _before(row, after)
        least = min(after)  # costs relative to the least: few distinct ones, so that most rows are looked up
        ahead, after = ahead + least, tuple(c - least for c in after)
        labels.append(label)
    labels.reverse()
    audit, at, state = bytearray(), 0, 0
    while (label := labels[at][state : state + 1]) != b" ":
        state = step(rows[at] if at < len(rows) else None, state, label.decode())
        at += label != b"I"
        audit += label
    return ahead + after[0], audit.decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: the row is dropped, 2: it stands twice) after the damage of its key's checksum."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fate, text = F.crc32(key.cast("binary")) % 20, F.coalesce(F.col("text").cast("string"), space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, F.lit(0)).when(fate == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def _digest() -> F.Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n (equal rows), fault (of the first of them; the rest are duplicates unless blank)."""
    solid = F.translate("text", SPACES, "")
    fault = F.when(F.length(solid) == 0, F.lit(BLANK)).when(F.substring(solid, -1, 1).isin(".", "!", "?"), F.lit(SOUND)).otherwise(F.lit(TRUNCATED))
    narrow = rows.select("conv_id", "turn", "role", _digest(), fault.alias("fault"), "copies")
    counted = written(narrow.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n")), "repair-rows")
    firsts = counted.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first")).select("conv_id", "role", "digest", "first.turn", F.lit(True).alias("is_first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "turn", "role", "digest")]
    met = counted.alias("a").join(firsts.alias("b"), same, "left")
    seen = F.when((F.col("fault") != BLANK) & F.col("is_first").isNull(), F.lit(DUPLICATE)).otherwise(F.col("fault"))
    return met.select("a.conv_id", "a.turn", "a.role", "a.digest", "a.n", seen.alias("fault"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of sorted rows `conv_id, turn, initial, n, fault`."""
    names = ["conv_id", *(c.split()[0] for c in SUMMARY.split(", "))]
    kinds = [*[pa.int64()] * 7, pa.string()]
    done: list[tuple] = []
    now: int | None = None
    codes: bytearray | None = None
    first = last = None
    turns = illegal = 0
    before = ""

    def ended() -> None:
        if codes is not None:
            faulty = [sum(codes.count(4 * i + f) for i in range(len(INITIALS) + 1)) for f in (BLANK, DUPLICATE, TRUNCATED)]
            done.append((now, last - first + 1 - turns if turns else 0, *faulty, illegal, *cheapest(codes)))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for rows in batches:
        for conv, turn, initial, n, fault in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if codes is None or conv != now:
                ended()
                now, codes, first, last, turns, illegal, before = conv, bytearray(), None, None, 0, 0, ""
            if not n:
                continue
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
            code = 4 * (INITIALS.index(initial) if initial and initial in INITIALS else len(INITIALS))
            illegal += (len(codes) > 0 and before + initial not in LEGAL) + n - 1
            codes.append(code + fault)
            codes += bytes([code + (fault if fault == BLANK else DUPLICATE)]) * (n - 1)
            before = initial
        yield batch()
    ended()
    yield batch()


def summaries(conversations: DataFrame) -> DataFrame:
    """Per original conversation, for its rows as given by `damaged`: conv_id and SUMMARY."""
    rows = faults(conversations).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "fault").mapInArrow(released(_summaries), f"conv_id long, {SUMMARY}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, summary, None, None, None) ahead of each conversation, then (conv_id, None, label, role, text) of its edits but for deletions."""
    now, audit, at, state = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            initial = next(out for out in ROLES if out in GRAMMAR[state])
            at, state = at + 1, GRAMMAR[state][initial]
            yield now, None, "I", ROLES[initial], ""

    for rows in batches:
        for conv, head, role, text, copies in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if head is not None:
                yield from inserted()
                now, audit, at, state = conv, head["audit"], 0, 0
                yield conv, head, None, None, None
                continue
            for _ in range(copies):
                yield from inserted()
                label, at = audit[at], at + 1
                if label == "R":
                    role = ROLES[next(out for out in ROLES if out in GRAMMAR[state])]
                if label != "D":
                    state = GRAMMAR[state][role[0]]
                    yield conv, None, label, role, text
    yield from inserted()


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """conv_id, head, role, text, copies: each conversation's summary, then its rows in order."""
    head = F.struct(*[c.split()[0] for c in SUMMARY.split(", ")])
    both = heads.select("conv_id", head.alias("head")).unionByName(rows.where("copies > 0").withColumn("digest", _digest()), allowMissingColumns=True)
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    return placed.select("conv_id", "head", "role", "text", "copies")


def repaired_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place, edit (K, R or I), role, text."""

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(_edited(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in batch], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "edit", "role", "text"])

    def batches_of(events: Iterator[tuple]) -> Iterator[list[tuple]]:
        out, place, size = [], 0, 0
        for conv, head, label, role, text in events:
            if head is not None:
                place = 0
                continue
            out.append((conv, place, label, role, text))
            place, size = place + 1, size + len(text)
            if len(out) == 4096 or size > 16 << 20:
                yield out
                out, size = [], 0
        yield out

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return _with_heads(rows, heads).mapInArrow(released(edited), "conv_id long, place long, edit string, role string, text string")


def digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """conv_id, SUMMARY and repaired_sha256 of the repaired rows, `role:text` joined by newlines."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(kinds)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *names, "repaired_sha256"])

        def ended() -> None:
            if summary is not None:
                done.append((now, *(summary[n] for n in names), said.hexdigest()))

        done, now, summary, said, any_row = [], None, None, hashlib.sha256(), False
        for conv, head, _, role, text in _edited(batches):
            if head is not None:
                ended()
                now, summary, said, any_row = conv, head, hashlib.sha256(), False
                if len(done) == 4096:
                    yield batch()
            else:
                said.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
                any_row = True
        ended()
        yield batch()

    return _with_heads(rows, heads).mapInArrow(released(hashed), f"conv_id long, {SUMMARY}, repaired_sha256 string")


def op12_repair(conversations: DataFrame) -> DataFrame:
    rows = damaged(conversations)
    return digests(rows, written(summaries(rows), "repair-audits"))
