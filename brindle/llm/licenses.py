"""Licence scan by a positional index of rare tokens, on DataFrame functions alone.

A library of short notices and the phrases that a notice must hold. The index has one posting per phrase under the
phrase's rarest word: which notice it belongs to, and where in it. Rarity is measured on the corpus: one pass counts the
documents that hold each licence word, of which there are as many as the library has. In the second pass a file's licence
words are ranked by inverse document frequency and looked up; each place of a rare word proposes where its phrase would
begin, and the words at the other relative positions must agree. Phrases of one notice intersect where their beginnings
imply the same beginning of the notice, give or take SLACK words; the notice is found if every one of its phrases stands
there and the window holds at least COVERED of its words, weighed by rarity. The best share is the score.

The three base phrases are notices that consist of one phrase, so every place of theirs is found, with score 1.

Both passes are projections of whole rows: nothing is shuffled but one count per licence word and task.

Nulls, ties and repeats: a null text is empty, has no words and score 0; each row has a result, a null id too; places may
overlap and all count; of equally rare words of a phrase the first in alphabetical order is looked up. Very long texts are
scanned whole, in time linear in their words. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK, COVERED = 8, 0.6
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())

#: Phrase -> label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, wording of a notice, phrases that it must hold.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction including without limitation")),
    ("mit", "SPDX-License-Identifier: MIT", ("license identifier mit",)),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", ("license identifier apache 2",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "endorse or promote products derived from this software")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license as published by the free software foundation", "version 2")),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license as published by the free software foundation", "version 3")),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0", ("license identifier gpl 3",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the GNU Affero General Public License, version 3", ("gnu affero general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2",)),
    ("epl-2", "made available under the terms of the Eclipse Public License v. 2.0", ("eclipse public license v 2",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("to the extent possible under law", "related and neighboring rights")),
    ("cc0", "released under CC0 1.0 Universal", ("cc0 1 0",)),
    ("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("software is provided as is without any express or implied warranty", "authors be held liable for any damages arising from the use of this software")),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1",)),
)

Notice = tuple[str, list[str], list[list[str]]]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, UPPER.lower())))


def library() -> list[Notice]:
    """Label, words and mandatory phrases of each notice; the base phrases come first."""
    notices = [(label, words_of(phrase), [words_of(phrase)]) for phrase, label in BASE.items()]
    return notices + [(label, words_of(text), [words_of(p) for p in phrases]) for label, text, phrases in NOTICES]


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def word_array(text: Column) -> Column:
    """The words of a text: A-Z in lower case, anything else in ASCII but letters and digits between them."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BREAKS, UPPER.lower() + " " * len(BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def rarities(docs: DataFrame, notices: list[Notice]) -> dict[str, float]:
    """Inverse document frequency of each word of the library over all documents; as many rows as the library has words."""
    vocabulary = sorted({w for _, words, _ in notices for w in words})
    held = F.array_append(F.array_intersect(word_array(F.col("text")), _constant(vocabulary, "array<string>")), F.lit(""))
    counts = {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log(1 + counts.get("", 0) / (counts.get(w, 0) + 1)) if counts.get("", 0) else 1.0 for w in vocabulary}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found_notices(words: Column, notices: list[Notice], rarity: dict[str, float]) -> Column:
    """Array of (notice, start, score) of the notices found among `words`, an array column."""
    ranked = sorted(rarity, key=lambda w: (-rarity[w], w))
    postings, wordings = [], []
    for n, (_, text, phrases) in enumerate(notices):
        for p in phrases:
            rare = min(p, key=lambda w: (-rarity[w], w))
            postings.append({"notice": n, "place": _place(text, p), "words": p, "rare": rare, "at": p.index(rare)})
        own = sorted(set(text), key=ranked.index)
        wordings.append({"notice": n, "phrases": len(phrases), "size": len(text), "words": [{"word": w, "weight": rarity[w]} for w in own], "total": sum(rarity[w] for w in own)})
    index = _constant(postings, "array<struct<notice:int,place:int,words:array<string>,rare:string,at:int>>")
    known = _constant(wordings, "array<struct<notice:int,phrases:int,size:int,words:array<struct<word:string,weight:double>>,total:double>>")
    vocabulary = _constant(ranked, "array<string>")

    def places(held: Column) -> Column:
        """(notice, place, starts) of each posting whose words the file holds."""
        asked = F.filter(index, lambda e: F.array_contains(held, e["rare"]) & (F.size(F.array_except(e["words"], held)) == 0))

        def looked_up(entries: Column) -> Column:
            rare = F.array_distinct(F.transform(entries, lambda e: e["rare"]))
            all_hits = lambda r: F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains(r, h["word"]))

            def begun(hits: Column) -> Column:
                def starts(e: Column) -> Column:
                    proposed = F.transform(F.filter(hits, lambda h: h["word"] == e["rare"]), lambda h: h["at"] - e["at"])
                    return F.filter(proposed, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, F.size(e["words"])) == e["words"]))

                return F.transform(entries, lambda e: F.struct(e["notice"].alias("notice"), e["place"].alias("place"), starts(e).alias("starts")))

            return _let(_let(rare, all_hits), begun)

        return F.filter(_let(asked, looked_up), lambda p: F.size(p["starts"]) > 0)

    def verified(met: Column) -> Column:
        def of_notice(t: Column) -> Column:
            mine = F.filter(met, lambda p: p["notice"] == t["notice"])
            begins = F.array_sort(F.flatten(F.transform(mine, lambda p, k: F.transform(p["starts"], lambda s: F.struct((s - p["place"]).alias("s"), k.alias("k"))))))
            # A phrase begins at most once a word, so what lies within SLACK of a beginning are its next few neighbours.
            near = t["phrases"] * (2 * SLACK + 1)

            def agreeing(all_of: Column) -> Column:
                leads = F.filter(F.transform(all_of, lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), i.alias("i"))), lambda x: x["k"] == 0)

                def together(x: Column) -> Column:
                    around = F.filter(F.slice(all_of, F.greatest(x["i"] - near, F.lit(0)) + 1, 2 * near + 1), lambda y: F.abs(y["s"] - x["s"]) <= SLACK)
                    return (t["phrases"] == 1) | (F.size(F.array_distinct(F.transform(around, lambda y: y["k"]))) == t["phrases"])

                return F.filter(leads, together)

            def scored(x: Column) -> Column:
                window = F.slice(words, F.greatest(x["s"] - SLACK, F.lit(0)) + 1, t["size"] + 2 * SLACK)
                share = lambda w: F.aggregate(t["words"], F.lit(0.0), lambda sum_, v: sum_ + F.when(F.array_contains(w, v["word"]), v["weight"]).otherwise(F.lit(0.0)))
                return F.struct(t["notice"].alias("notice"), x["s"].alias("start"), F.round(_let(window, share) / t["total"], 6).alias("score"))

            whole = F.size(mine) == t["phrases"]
            return F.when(whole, F.filter(F.transform(_let(begins, agreeing), scored), lambda m: m["score"] >= COVERED)).otherwise(F.expr("cast(array() as array<struct<notice:int,start:int,score:double>>)"))

        return F.flatten(F.transform(known, of_notice))

    none = F.expr("cast(array() as array<struct<notice:int,start:int,score:double>>)")
    held = F.array_intersect(vocabulary, F.array_intersect(words, vocabulary))
    return _let(_let(held, places), lambda met: F.when(F.size(met) > 0, verified(met)).otherwise(none))


def scan(docs: DataFrame, notices: list[Notice] | None = None, rarity: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, found: (notice's place in the library, start word, score) of each notice found."""
    notices = library() if notices is None else notices
    rarity = rarities(docs, notices) if rarity is None else rarity
    return docs.select("doc_id", word_array(F.col("text")).alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), found_notices(F.col("words"), notices, rarity).alias("found"))


def op11_licenses(docs: DataFrame) -> DataFrame:
    notices = library()
    names = F.array(*[F.lit(label) for label, _, _ in notices])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: F.get(names, m["notice"])))), ",")
    base = scan(docs, notices).withColumn("base", F.filter("found", lambda m: m["notice"] < len(BASE)))
    starts = F.transform("base", lambda m: m["start"])
    return base.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
