"""Token counts without tokens: the best unigram segmentation's piece count and score.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character; dynamic programming
keeps the best score and its piece count per position. Ties go as in the unigram tokenizer: positions are expanded from
left to right and only a strictly better score replaces one, so of equal paths the one whose last piece starts first
stays. A character that is no piece of its own costs the lowest score less `UNKNOWN`; neighbouring unknown characters
count as one piece.

Spaces become the meta symbol and one is put in front. Where no piece has the meta symbol after another character, the
text falls apart before each meta symbol that follows another character, so distinct words are counted once per worker.

Nulls, ties and repeats: null and empty texts have 0 tokens and score 0; every row is counted, a null id too, and very
long texts whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import released, slices

META = "▁"
UNKNOWN = 10.0
_LOADED: dict[str, "Counter"] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], cap: int = 1_000_000) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.lowest = min((s for _, s in pieces), default=0.0)
        self.splits = not any(META in p.lstrip(META) for p, _ in pieces)
        # Words that are remembered, as arrays: pieces, score, whether the first and the last piece are unknown.
        self.cap, self.known = cap, (pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, bool))

    def count(self, text: str) -> tuple[int, float, bool, bool]:
        """Pieces and score of a text whose spaces are meta symbols, and whether it starts and ends with an unknown."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(text):
            ends[last + 1].append((length, score))
        best = [0.0] * (n + 1)
        count, unknown, first = [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, back, plain = None, 0, False
            # Longer pieces start earlier: their paths were there first.
            for length, score in sorted(ends[end], reverse=True):
                if top is None or best[end - length] + score > top:
                    top, back, plain = best[end - length] + score, length, True
            if not any(length == 1 for length, _ in ends[end]):
                score = best[end - 1] + self.lowest - UNKNOWN
                if top is None or score > top:
                    top, back, plain = score, 1, False
            at = end - back
            best[end], unknown[end] = top, not plain
            count[end] = count[at] + (plain or not unknown[at])
            first[end] = first[at] if at else not plain
        return count[n], best[n], first[n], unknown[n]

    def total(self, text: str) -> tuple[int, float]:
        """The same for a whole plain text."""
        if not text:
            return 0, 0.0
        count, score, _, _ = self.count(META + text.replace(" ", META))
        return count, score

    def remembered(self, words: pa.Array) -> list[np.ndarray]:
        """count() of distinct words; only those that are not remembered are counted. When `cap` words are, the last batch's stay."""
        names, *columns = self.known
        at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        found = [self.count(META + k) for k in fresh.to_pylist()]
        at[new] = len(names) + np.arange(len(new))
        columns = [np.concatenate([c, np.array([f[i] for f in found], c.dtype)]) for i, c in enumerate(columns)]
        here = [c[at] for c in columns]
        self.known = (pa.concat_arrays([names, fresh]), *columns) if len(names) + len(new) <= self.cap else (words, *here)
        return here

    def totals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.splits:
            both = [self.total(t) for t in text.to_pylist()]
            return np.array([c for c, _ in both], np.int64), np.array([s for _, s in both], np.float64)
        # Runs of spaces are pieces of their own kind: such texts are counted whole.
        whole = pc.match_substring_regex(text, f"  |^ | $|{META}").to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(text, " ")
        words = cut.flatten().dictionary_encode()
        codes, bounds = np.asarray(words.indices), np.asarray(cut.offsets)
        # An unknown end meets an unknown start: one piece. A start is the meta symbol, which is mostly known.
        pieces, worth, opens, closes = (c[codes] for c in self.remembered(words.dictionary))
        joined = np.zeros(len(codes), np.int64)
        joined[1:] = opens[1:] & closes[:-1]
        joined[bounds[:-1][bounds[:-1] < len(codes)]] = 0
        counts = np.concatenate([[0], np.cumsum(pieces - joined)])
        scores = np.concatenate([[0.0], np.cumsum(worth)])
        n, s = counts[bounds[1:]] - counts[bounds[:-1]], scores[bounds[1:]] - scores[bounds[:-1]]
        for i in np.flatnonzero(whole):
            n[i], s[i] = self.total(text[int(i)].as_py())
        empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
        n[empty], s[empty] = 0, 0.0
        return n, s


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(vocabulary(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, score (the sum of the best path's piece scores, which are integers in rank-scored files)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in slices(batches, 4096, 16):
            n, score = model.totals(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(counted), "doc_id long, n_tokens long, score double")
