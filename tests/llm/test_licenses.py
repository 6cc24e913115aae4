"""The licence scan against a plain scan of every position, and wordings that it must tell apart."""

from __future__ import annotations

import math
import random
import re

import pytest

from brindle.llm import licenses

SCHEMA = "doc_id long, text string, words string, found string, base string, source string"
BASE = [("mit", "under the mit license".split()), ("apache-2", "apache license version 2".split()), ("cc-by-nc", "cc by nc".split())]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def at(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def plain(texts):
    """Per text the contract's columns, trying every notice at every place of its first phrase."""
    library = licenses.library()
    held = [set(words_of(t)) for t in texts]
    weight = {w: math.log(1 + len(texts) / (sum(w in h for h in held) + 1)) for _, ws, _ in library for w in ws}
    out = []
    for t in texts:
        ws, labels, best = words_of(t), set(), 0.0
        for label, wording, phrases in library:
            spots = [[p - at(wording, q)[0] for p in at(ws, q)] for q in phrases]
            for s in spots[0]:
                if all(any(abs(x - s) <= 8 for x in other) for other in spots[1:]):
                    window = ws[max(s - 8, 0) : max(s - 8, 0) + len(wording) + 16]
                    own = set(wording)
                    score = sum(weight[w] for w in own if w in window) / sum(weight[w] for w in own)
                    if score >= 0.6:
                        labels.add(label)
                        best = max(best, score)
        base = [(label, p) for label, phrase in BASE for p in at(ws, phrase)]
        places = [p for _, p in base]
        out.append((len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), round(best, 5)))
    return out


def odd_texts():
    rng = random.Random(8)
    wording = {label: text for label, text, _ in reversed(licenses.NOTICES)}
    prose = lambda n: " ".join(rng.choice("the and of in to software license under free version use any rights copy public ümlaut x9 by cc".split()) for _ in range(n))
    texts = [None, "", " \n\t", "...", "Released under the MIT License.", "UNDER-THE_mit/LICENSE", "under the mitt license", "Licensed under CC BY-NC 4.0.", "cc\x00by\x7fnc cc by nc"]
    texts += ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Apache license, version 3", "cc by cc by nc nc under the under the mit license", "K cc by nc İ"]
    for label, text in wording.items():
        texts += [text, prose(40) + " " + text + " " + prose(40), text.replace(" the ", "\n * the ")]
        cut = text.split()
        texts += [" ".join(cut[: len(cut) // 2]), " ".join(w for w in cut if rng.random() < 0.85)]
    two = next(t for label, t, _ in licenses.NOTICES if label == "bsd")
    half = two.split(" with")[0], two.split("provided that ")[1]
    texts += [f"{half[0]} {prose(n)} {half[1]}" for n in (0, 3, 5, 9, 14, 30)] + [f"{half[1]} {half[0]}", " ".join(wording.values())]
    return texts + [prose(n) for n in (5, 50, 500)] + [(prose(6000) + " " + " ".join(wording.values()) + " ") * 3, "under the mit license " * 4000]


def test_scan_equals_every_position(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "w", "f", "b", "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 5)) for r in licenses.op11_licenses(df).collect()}
    want = plain(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i] and texts[i][:200]


def test_every_notice_is_found_and_prose_is_clean(spark):
    texts = [text for _, text, _ in licenses.NOTICES]
    clean = ["We licensed the general public to view version 3 of the work.", "The Apache tribe; a license. Version 2 of the tale", "mit license under the", "free of charge permission is granted"]
    df = spark.createDataFrame([(i, t, "", "", "", "") for i, t in enumerate(texts + clean)], SCHEMA)
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.op11_licenses(df).collect()}
    assert all(label in got[i] for i, (label, _, _) in enumerate(licenses.NOTICES))
    assert all(got[len(texts) + i] == [""] for i in range(len(clean)))


def test_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "cc by nc", "", "", "", ""), (1, "cc by nc", "", "", "", ""), (1, "cc by nc", "", "", "", "")], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in licenses.op11_licenses(df).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert licenses.op11_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("notice", range(3))
def test_base_phrases_come_first(notice):
    label, phrase = BASE[notice]
    assert licenses.library()[notice] == (label, phrase, [phrase])
