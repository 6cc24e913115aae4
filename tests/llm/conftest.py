from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, key string, kind string, hash string, component string"


def prose(rng: random.Random, words: int, vowels: str = "aeiou") -> str:
    out = []
    for i in range(words):
        w = "".join(rng.choice("bcdfglmnprst") + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(["", "", "", ".", ",", ".\n"]))
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty, odd and very long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    texts: list[str | None] = [None, "", " ", "\n\t ", "ok", "one two three", "no letters 12345 !!", "123 456", "  lead and  double\t tab\x0bvt ", "Ünïcode ΟΔΟΣ 日本語 text. End"]
    base = [prose(rng, n) for n in (30, 60, 120, 300, 300)]
    texts += base + base[:3]
    for b in base[1:]:
        w = b.split(" ")
        for k in (1, 2):
            v = list(w)
            v[len(v) // (k + 1)] = "changed"
            texts.append(" ".join(v))
    texts.append(" ".join(base) * 40)  # very long
    texts.append("Same line here.\n" * 30)
    texts.append("mail me.x+1@mail.example.com or call +1 (555) 010-9999, again 5550109999. Card 4111 1111 1111 1111 and 4111111111111111; host 10.0.0.1, not 999.1.1.1. a@b @ +1 +12345678")
    out = [(i, t, ("en", "fr", None)[i % 3] if t else None, ("s1", "s2", "s1", None)[i % 4], len(t or ""), "x", "y", "z", "q", "h", "c") for i, t in enumerate(texts)]
    out.append(out[11])  # a repeated row
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def with_null_id(spark, rows):
    return spark.createDataFrame([*rows, (None, rows[12][1], "en", "s1", 1, *rows[0][5:])], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
