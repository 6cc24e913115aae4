"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to LONGEST, over words padded with '_') in order of
frequency. A document's own most frequent n-grams are ranked the same way; its distance to a language is the sum over
its n-grams of how far out of place each is in the profile, at most the profile's length for one that is missing. The
nearest language wins (ties: the smaller name). The score is 1 - distance / greatest possible distance.

Profiles are fitted on a sample bounded by `per_language` expected documents of each language, chosen by a hash of the
id; prediction reads whole texts and nothing but the text.

Nulls, ties and repeats: a null text or one without a letter is `und` with score 0; so is every document if no row has a
label, or the table is empty. Rows with a null id or label are not learned from. n-grams of equal count rank by a fixed
hash. Every row is predicted, from its whole text. Other columns are not read. The driver holds one row a language, and
KEPT n-grams of each: labels are languages, not free text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import released, slices, texts

LONGEST, KEPT, UNKNOWN = 3, 300, "und"
LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_profiles(labelled: DataFrame, per_language: int = 1500) -> dict[str, list[str]]:
    """Language -> its KEPT most frequent n-grams, from `doc_id, text, lang` rows."""
    usable = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("lang"))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, 16):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            out = []
            for lang, seen in words.items():
                found: Counter = Counter()
                for word, n in seen.items():
                    for g in grams(word):
                        found[g] += n
                out += [(lang, g, n) for g, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    ranked = drawn.mapInArrow(released(counted), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = ranked.withColumn("place", place).where(F.col("place") <= KEPT).collect()
    profiles: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _key(gram: str) -> int:
    """An n-gram of up to three code points as one number, 21 bits each."""
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


class Ranker:
    """Distances of documents to profiles. The n-grams of a batch's distinct words are numbered together."""

    def __init__(self, profiles: dict[str, list[str]], cap: int = 300_000) -> None:
        self.names = sorted(profiles)
        self.cap, self.ties = cap, {}
        self.known = np.array(sorted({_key(g) for grams_ in profiles.values() for g in grams_}), np.int64)
        # The last column is that of n-grams in no profile.
        self.places = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            for place, g in enumerate(profiles[name]):
                self.places[i, np.searchsorted(self.known, _key(g))] = place

    def _tie(self, key: int) -> int:
        if (found := self.ties.get(key)) is None:
            gram = "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)
            found = self.ties[key] = xxhash.xxh3_64_intdigest(gram) & ((1 << 32) - 1)
        return found

    def _numbered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of all words as numbers, and which of them each word has: places among them, word after word, and how many."""
        chars = np.frombuffer(("_" + "__".join(words) + "_").encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), sizes)
        keys, of = [], []
        for n in range(1, LONGEST + 1):
            same = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            key = chars[same]
            for j in range(1, n):
                key = key << 21 | chars[same + j]
            real = key != ord("_")
            keys.append(key[real])
            of.append(owner[same][real])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        owners = np.concatenate(of)
        return every, inverse[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        index: dict[str, int] = {}
        seen = []
        for text in texts:
            found = Counter(LETTERS.findall(text.lower()))
            seen.append((np.array([index.setdefault(w, len(index)) for w in found], np.int64), np.fromiter(found.values(), np.int64, len(found))))
        if not self.names or not index:
            return [(UNKNOWN, 0.0)] * len(texts)
        every, grams_, sizes = self._numbered(list(index))
        if len(self.ties) > self.cap:
            self.ties.clear()
        ties = np.fromiter(map(self._tie, every.tolist()), np.int64, len(every))
        at = np.minimum(np.searchsorted(self.known, every), len(self.known) - 1)
        places = self.places[:, np.where(self.known[at] == every, at, len(self.known))]
        starts = np.cumsum(sizes) - sizes
        return [self._nearest(w, n, text, grams_, starts, sizes, ties, places) for (w, n), text in zip(seen, texts, strict=True)]

    def _nearest(self, words: np.ndarray, times: np.ndarray, text: str, grams_: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ties: np.ndarray, places: np.ndarray) -> tuple[str, float]:
        if not len(words) or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        each = sizes[words]
        ends = np.cumsum(each)
        counts = np.bincount(grams_[np.repeat(starts[words] - ends + each, each) + np.arange(ends[-1])], np.repeat(times, each), minlength=len(ties)).astype(np.int64)
        found = np.flatnonzero(counts)
        order = (counts.max() - counts[found] << 32) | ties[found]
        if len(found) > KEPT:
            first = np.argpartition(order, KEPT - 1)[:KEPT]
            found, order = found[first], order[first]
        ranked = found[np.argsort(order, kind="stable")]
        here = places[:, ranked]
        out = np.where(here < 0, KEPT, np.abs(here - np.arange(len(ranked)))).sum(axis=1)
        best = int(np.argmin(out))
        return self.names[best], max(0.0, 1.0 - float(out[best]) / (KEPT * len(ranked)))


def identify(docs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ranker(profiles)
        for batch in slices(batches, 1024, 4):
            found = model.predict_all(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(predicted), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: dict[str, list[str]], least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is known and whose score is at least `least`."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ranker(profiles)
        for batch in slices(batches, 1024, 4):
            found = model.predict_all(texts(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(released(kept), docs.schema)


def op1_langid(docs: DataFrame) -> DataFrame:
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
