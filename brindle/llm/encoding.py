"""Token ids of whole texts with the tokenizers library, each distinct word encoded once while a worker remembers it."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides space and newline, by Python's or the tokenizers' rules.
ODD = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that are encoded in one call, by whether the vocabulary is byte-level.
UNSAFE = {True: f"[{ODD}]|[ \n][ \n]|^ | $", False: f"[{ODD}]"}
#: Words that an encoder remembers with their ids, as Arrow and NumPy arrays: about 40 bytes each.
CAP = 600_000
_LOADED: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, byte_level: bool) -> "Encoder":
    """The worker's encoder of a vocabulary file, which outlives a task with the words that it remembers."""
    if (path, byte_level) not in _LOADED:
        _LOADED[path, byte_level] = Encoder(path, byte_level)
    return _LOADED[path, byte_level]


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each start and length, one after the other."""
    ends = np.cumsum(lens)
    out = np.repeat((starts - ends + lens).astype(np.int32), lens)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    """Ids equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    No token of either vocabulary family reaches from a non-space to the white space after it, so a text falls apart
    before every single space or newline. Texts with runs of white space, unusual white space or the string of a special
    token, in any case of letters, take one whole call. When CAP words are remembered, those of the last batch stay.
    """

    def __init__(self, path: str, byte_level: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = byte_level
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe = "(?i)" + "|".join([UNSAFE[byte_level], *special])
        self.mark = self.whole("\n" if byte_level else "|")[0]
        self.known = (pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _joined(self, words: pa.Array, lead: str, size: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's start and how many they are. Words go out many in a call, told apart by
        a mark that none of them contains; a call that gives another number of marks is done again word by word."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, between = ("\n" + lead, "\n" + lead) if self.byte_level else ("| ", " | ")
        edges = np.append(np.arange(0, len(words), size), len(words))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words)
        calls = pc.binary_join_element_wise(pa.scalar(first, pa.large_string()), pc.binary_join(lists, pa.scalar(between, pa.large_string())), pa.scalar("", pa.large_string()))
        ids, starts, lens, at = [], [], [], 0
        for i, code in enumerate(self.tokenizer.encode_batch_fast(calls.to_pylist(), add_special_tokens=False)):
            found = np.asarray(code.ids, "<u4")
            cuts = np.flatnonzero(found == self.mark)
            if len(cuts) != edges[i + 1] - edges[i]:
                parts = [self.whole(lead + w if self.byte_level else w) for w in words.slice(edges[i], edges[i + 1] - edges[i]).to_pylist()]
                found = np.concatenate(parts)
                each = np.array([len(p) for p in parts], np.int64)
                begin = np.cumsum(each) - each
            else:
                begin = cuts + 1
                each = np.append(cuts[1:], len(found)) - begin
            ids.append(found)
            starts.append(begin + at)
            lens.append(each)
            at += len(found)
        return np.concatenate(ids), np.concatenate(starts), np.concatenate(lens)

    def _remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and lengths of distinct words; only those that are not remembered are encoded."""
        names, ids, starts, lens = self.known
        at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        found, begin, each = self._words(fresh)
        at = at.astype(np.int64)
        at[new] = len(names) + np.arange(len(new))
        ids, starts, lens = np.concatenate([ids, found]), np.concatenate([starts, begin + len(ids)]), np.concatenate([lens, each])
        if len(names) + len(new) <= CAP:
            self.known = (pa.concat_arrays([names, fresh]), ids, starts, lens)
        else:
            own = lens[at]
            self.known = (words, ids[_ranges(starts[at], own)], np.cumsum(own) - own, own)
        return ids, starts[at], lens[at]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words as the splits below leave them."""
        n = len(words)
        if self.byte_level:
            # After a newline, or at a text's start (marked by a return), a word has no space in front.
            newline = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
            bare = newline | pc.starts_with(words, "\r").to_numpy(zero_copy_only=False)
            groups = [(np.flatnonzero(~bare), " ", False), (np.flatnonzero(bare), "", True)]
        else:
            piped = pc.match_substring(words, "|").to_numpy(zero_copy_only=False)
            groups = [(np.flatnonzero(~piped), "", False)]
        ids, starts, lens, at = [], np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for places, lead, cut in groups:
            some = words.take(pa.array(places))
            found, begin, each = self._joined(pc.utf8_slice_codeunits(some, 1) if cut else some, lead)
            if cut and len(places):
                # The newline itself is the mark just before the word's ids.
                found, begin, each = self._with_newlines(found, begin, each, newline[places])
            ids.append(found)
            starts[places], lens[places] = begin + at, each
            at += len(found)
        if not self.byte_level:
            for i in np.flatnonzero(piped):
                found = self.whole(words[int(i)].as_py())
                ids.append(found)
                starts[i], lens[i] = at, len(found)
                at += len(found)
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), starts, lens

    def _with_newlines(self, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray, newline: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = ids[_ranges(starts, lens)]
        ends = np.cumsum(lens)
        flat = np.insert(flat, (ends - lens)[newline], self.mark)
        each = lens + newline
        return flat, np.cumsum(each) - each, each

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), one after the other, and where each text's ids start and end."""
        text = pc.fill_null(column.cast(pa.large_string()), "")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        whole = np.flatnonzero(pc.match_substring_regex(text, self.unsafe).to_numpy(zero_copy_only=False))
        if len(whole):
            late = [self.whole(text[int(i)].as_py()) for i in whole]
            text = pc.if_else(pa.array(np.isin(np.arange(len(text)), whole)), pa.scalar("", pa.large_string()), text)
        if self.byte_level:
            spaced = pc.replace_substring(text, "\n", " \n")
            cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), spaced, pa.scalar("", pa.large_string())), " ")
        else:
            # Letters are lowered by the vocabulary's normaliser too; done before, fewer words differ.
            cut = pc.split_pattern(pc.replace_substring(pc.ascii_lower(text), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        bounds, codes = np.asarray(cut.offsets), np.asarray(words.indices)
        flat, starts, lens = self._remembered(words.dictionary)
        each = lens[codes]
        ids = flat[_ranges(starts[codes], each)]
        offsets = np.concatenate([[0], np.cumsum(each)])[bounds]
        if len(whole):
            pieces = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for i, x in zip(whole, late, strict=True):
                pieces[i] = x
            ids, offsets = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, offsets
