"""N-gram Jaccard join: every pair of documents whose shingle sets overlap enough ends up in one component.

1. One pass makes each document's set of 64-bit shingle hashes, its size and a 128-bit fingerprint. Equal sets are one
   class. The same pass counts words and shingles that recur within a batch; the most frequent ones (at most HOT of
   each) go last in the order below. These lists only speed the search, any order is right.
2. Prefix filter: shingles are ordered by recurrence, then by how frequent their words are, then by hash, so that a set's
   first ones are shared with its near copies and hardly with any other. If x, no larger than y, links with y, at least k
   of x's first |x| - ceil(2t/(1+t) |x|) + k shingles are among y's first |y| - ceil(t |y|) + k. The lists are
   range-partitioned by shingle and set size, which spreads a frequent shingle over tasks. With k a share of |x|, a
   document stays only if that many of its entries stand beside one of another document of compatible size: documents
   that share a passage, but little else, go. With k = 1 (x's index prefix, y's probe prefix), each entry that is left is
   tied to the last index entry before it if their sizes are compatible: one row an entry at most. What a range begins
   with is tied to what the ranges before it end with. The ties' components hold every linking pair.
3. T-occurrence search in blocks of at most BLOCK shingles: inverted lists, of which the long ones are set aside
   (DivideSkip), the short ones are merged by a heap that skips (MergeSkip), and candidates are probed in the long ones
   by binary search. Counts are exact overlaps. Sets stand by size, and each range of sizes has its own threshold: a set
   with more shingles of its own than a link allows there ends its merge early. Sets are searched for until those not
   yet searched for are one group, and a set's search ends when it links with that group: a large group of near copies
   takes neither a search for each pair nor a whole one for each set.
4. A component of several blocks is cut smaller first: its shingles are counted, exactly now, and step 2 is repeated with
   the rarest first. What is still larger is finished exactly: leaders of each block's linked groups are searched among
   themselves; then the sets outside the component's largest linked group are searched for, in chunks, in those blocks
   whose set sizes are compatible. A task holds one chunk and one block.

Links of different texts are never dropped: two sets either share a block, or both lie in the linked group, or one of
them is searched for in the other's block.

Nulls, ties and repeats: a null text has no shingles and links with nothing; a null id links with nothing and has a null
component; rows of equal id are one node. Texts with fewer words than a shingle are one shingle; very long texts are
handled whole. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import released, slices, with_group, written
from brindle.llm.components import connected_components

HOT, HOT_LEAST, WORD_LEAST, LEADERS = 200_000, 3, 8, 16
#: Shingles of a block, nodes whose ties a task holds, and the k of the prefix filter as a percentage of the smaller set.
BLOCK, HELD, BESIDE = 1 << 20, 300_000, 6
#: A search goes by ranges of set sizes, each as wide as this part of the size searched for. The more ASIDE, the fewer lists are set aside.
RANGES, ASIDE = 64, 0.001


class Rule(NamedTuple):
    """Shingles of `words` words; sets link if den * shared >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100


def _fold(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring word hashes."""
    n = len(w) - k + 1
    h = w[:n].copy()
    for j in range(1, k):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


#: Bytes as they count: A-Z lower-cased, what parts words as spaces.
FOLDED = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)), np.uint8)
#: Words up to this many bytes are hashed all at once, eight bytes at a time.
SHORT = 64


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start and end. A-Z are lower-cased."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    size = int(ends[-1] - ends[0])
    folded = np.zeros(size + 8, np.uint8)
    if size:
        np.take(FOLDED, np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]], out=folded[:size])
    ends = ends - ends[0]
    inside = folded[:size] != 32
    edge = np.zeros(size + 1, bool)
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    # Eight bytes from each place on; those beyond a word's end are masked.
    eights = np.ndarray((size + 1,), np.dtype("<u8"), folded, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    hashes = _mix((eights[start] & masks[np.minimum(length, 8)]) ^ _mix(length.astype(np.uint64)))
    more = np.flatnonzero((length > 8) & (length <= SHORT))
    at = 8
    while len(more):
        hashes[more] = _mix(hashes[more] * np.uint64(0x9E3779B97F4A7C15) ^ eights[start[more] + at] & masks[np.minimum(length[more] - at, 8)])
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > SHORT).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(folded[start[i] : start[i] + length[i]].tobytes())
    return hashes, np.searchsorted(start, ends)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _sets(words: np.ndarray, bounds: np.ndarray, k: int, weights: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's sorted distinct shingle hashes, and the sums of their words' weights."""
    n = len(words) - k + 1
    every = _fold(words, k) if n > 0 else np.zeros(0, np.uint64)
    none = np.zeros(0, np.int64)
    sums = sum(weights[j : j + n] for j in range(k)) if weights is not None and n > 0 else none
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            if weights is None:
                out.append((_distinct(every[a : b - k + 1]), none))
            else:
                order = np.argsort(every[a : b - k + 1])
                found = every[a : b - k + 1][order]
                new = np.concatenate([[True], found[1:] != found[:-1]])
                out.append((found[new], sums[a : b - k + 1][order[new]]))
        else:
            out.append((_fold(words[a:b], b - a) if b > a else np.zeros(0, np.uint64), np.zeros(int(b > a), np.int64)))
    return out


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for s, _ in _sets(*_words(column), k)]


def _need(n: int, rule: Rule) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-rule.num * n // rule.den)


def _least_equal(n: int, rule: Rule) -> int:
    """The least overlap of a set of n with one that is no smaller and links with it."""
    return -(-2 * rule.num * n // (rule.num + rule.den))


def _beside(n: int) -> int:
    """The k of the prefix filter for a smaller set of n."""
    return max(1, n * BESIDE // 100)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def described(docs: DataFrame, rule: Rule) -> DataFrame:
    """kind 0: doc_id, n, f1, f2 of each document; kind 1: shingle f1 that n documents of one batch have; kind 2: word f1 that occurs n times in one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192, 16):
            words, bounds = _words(batch.column(1))
            sets = [s for s, _ in _sets(words, bounds, rule.words)]
            prints = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            found, times = np.unique(np.concatenate(sets), return_counts=True)
            coded = pa.array(words).dictionary_encode()
            hashed = np.asarray(coded.dictionary)
            uses = np.bincount(np.asarray(coded.indices), minlength=len(hashed))
            often, used = times >= HOT_LEAST, uses >= WORD_LEAST
            m = int(often.sum() + used.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1, 2], np.int32), [len(sets), often.sum(), used.sum()])),
                    pa.concat_arrays([batch.column(0), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([[len(s) for s in sets], times[often], uses[used]]).astype(np.int64)),
                    pa.array(np.concatenate([prints[:, 0], found[often].view(np.int64), hashed[used].view(np.int64)])),
                    pa.array(np.concatenate([prints[:, 1], np.zeros(m, np.int64)])),
                ],
                names=["kind", "doc_id", "n", "f1", "f2"],
            )

    return _docs(docs).mapInArrow(released(rows), "kind int, doc_id long, n long, f1 long, f2 long")


def _frequent(facts: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the HOT most frequent shingles (1) or words (2), by hash."""
    rows = facts.where(F.col("kind") == kind).groupBy("f1").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "f1").limit(HOT).collect()
    hashes = np.array([r["f1"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in rows], np.int64)[order]


def _places(known: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `found` hashes are in sorted `known` ones, and which are there at all."""
    if not len(known):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return at, known[at] == found


def prefix_entries(docs: DataFrame, rule: Rule, shingles: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, place, doc_id of the first shingles of all documents. place is four times the set's size, and 1 more beyond
    the index prefix and 2 more beyond the probe prefix of k = 1. shingles, words: hashes and counts of frequent ones (at most HOT each).
    """
    spark = docs.sparkSession
    rank = np.argsort(np.lexsort(shingles)) + 1
    shared = spark.sparkContext.broadcast((shingles[0], rank, words[0], np.log2(words[1] + 1).astype(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks, common, logs = shared.value
        mask = np.uint64((1 << 22) - 1)
        perhaps = np.zeros(1 << 22, bool)
        perhaps[known & mask] = True
        seen: set[bytes] = set()
        for batch in slices(batches, 8192, 8):
            ids, places, tokens = [], [], []
            words, bounds = _words(batch.column(1))
            coded = pa.array(words).dictionary_encode()
            at, there = _places(common, np.asarray(coded.dictionary))
            weights = np.where(there, logs[at] if len(logs) else 0, 0)[np.asarray(coded.indices)]
            for doc, (s, weight) in zip(batch.column(0).to_pylist(), _sets(words, bounds, rule.words, weights), strict=True):
                if doc is None or not len(s):
                    continue
                if (f := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(f)
                n = len(s)
                some = np.flatnonzero(perhaps[s & mask])
                at, there = _places(known, s[some])
                place = weight.copy()
                place[some[there]] += ranks[at[there]] << 16
                need, equal = _need(n, rule), _least_equal(n, rule)
                cold = s[np.lexsort((s, place))[: max(n - need + _beside(need) + 1, n - equal + _beside(n))]]
                ids.append(doc)
                tokens.append(cold)
                at = np.arange(len(cold))
                places.append(4 * n + (at > n - equal) + (at > n - need))
            if ids:
                each = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.repeat(np.array(ids, np.int64), each))],
                    names=["token", "place", "doc_id"],
                )

    return written(_docs(docs).mapInArrow(released(prefixes), "token long, place int, doc_id long"), "jaccard-prefixes")


def rarest_entries(sets: DataFrame, rule: Rule) -> DataFrame:
    """prefix_entries of `doc_id, n, shingles` rows, with shingles in order of how many of these rows have them, and then by hash.

    Only shingles of several rows are entries: the others tie nothing. So a set with enough shingles of its own has none,
    whatever passages it shares with many others.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 8):
            each = np.asarray(batch.column(1))
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(np.asarray(batch.column(0)), each)), pa.array(np.repeat(each, each))], names=["token", "doc_id", "n"])

    rows = sets.select("doc_id", "n", "shingles").mapInArrow(released(exploded), "token long, doc_id long, n int")
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    shared = with_group(rows, ["token"], F.count("*").alias("df"), total=total).where("df > 1")
    per = shared.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"))
    n = F.col("n").cast("long")
    own, probe = n - F.size("x"), n - F.ceil(n * rule.num / F.lit(rule.den)) + 1
    index = n - F.ceil(2 * n * rule.num / F.lit(rule.num + rule.den)) + 1
    cut = F.slice("x", F.lit(1), F.greatest(probe - own, F.lit(0)).cast("int"))
    each = per.select("doc_id", n.alias("n"), (index - own).alias("upto"), F.posexplode(cut).alias("i", "x"))
    return written(each.select(F.col("x.token").alias("token"), (4 * F.col("n") + (F.col("i") >= F.col("upto")).cast("int")).cast("int").alias("place"), "doc_id"), "jaccard-rarest")


def beside_others(entries: DataFrame, rule: Rule) -> DataFrame:
    """The entries that stand beside another document's of the same shingle and compatible size, of documents that have enough of them."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Each batch starts with the last row of the one before it. A part's own ends count as being beside another.
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            token, size = np.asarray(rows.column(0)), np.asarray(rows.column(1)).astype(np.int64) >> 2
            near = (token[1:] == token[:-1]) & (rule.num * size[1:] <= rule.den * size[:-1])
            busy = np.concatenate([[last is None or held], near]) | np.concatenate([near, [False]])
            last, held = rows.slice(rows.num_rows - 1), bool(busy[-1])
            yield rows.slice(0, rows.num_rows - 1).filter(pa.array(busy[:-1]))
        if last is not None:
            yield last

    found = entries.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(released(beside), entries.schema)
    n = F.shiftright("place", 2).cast("long")
    need = F.greatest(F.lit(1), F.floor(F.ceil(n * rule.num / F.lit(rule.den)) * BESIDE / F.lit(100)))
    count = F.count("*").over(Window.partitionBy("doc_id", n))
    return written(found.withColumn("beside", count).where(F.col("beside") >= need).drop("beside"), "jaccard-beside")


def tied_edges(entries: DataFrame, rule: Rule) -> DataFrame:
    """Edges a, b whose components hold every linking pair that has entries in common."""
    spark = entries.sparkSession

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: edge a, b. kind 1: b, of size n, is to be tied to what came before this part. kind 2: the part's first token a and last token b, and its last index entry n, doc of that."""
        part = TaskContext.get().partitionId()
        parent: dict[int, int] = {}
        first = last = index = None
        for batch in batches:
            token, place, doc = (np.asarray(c) for c in batch.columns)
            if not len(token):
                continue
            # Shingles of a single document need no look, except at the edges of a batch.
            alike = np.concatenate([[False], token[1:] == token[:-1]])
            busy = alike | np.concatenate([alike[1:], [True]])
            busy[0] = True
            open_ = []
            for t, at, d in zip(token[busy].tolist(), place[busy].tolist(), doc[busy].tolist(), strict=True):
                if t != last:
                    first, last, index = (t if first is None else first), t, None
                if index is None:
                    if t == first:
                        open_.append((at >> 2, d))
                elif rule.num * (at >> 2) <= rule.den * index[0]:
                    _union(parent, index[1], d)
                if not at & 3:
                    index = (at >> 2, d)
            if open_:
                yield _ties(1, part, None, [d for _, d in open_], [n for n, _ in open_])
            if len(parent) > HELD:
                yield _stars(part, parent)
                parent = {}
        yield _stars(part, parent)
        if first is not None:
            n, d = index or (None, None)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((2, part, first, last, n, d), TIES.values(), strict=True)], names=list(TIES))

    ties = written(entries.where("place % 4 < 2").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(released(tied), "kind int, part int, a long, b long, n long, doc long"), "jaccard-ties")
    # One row per part goes to the driver.
    before, carried = None, []
    for r in ties.where("kind = 2").orderBy("part").collect():
        if before and before[0] == r["a"]:
            carried.append((r["part"], *before[1:]))
        if r["doc"] is not None:
            before = (r["b"], r["n"], r["doc"])
        elif not (before and before[0] == r["a"] == r["b"]):
            before = None
    edges = ties.where("kind = 0").select("a", "b")
    if carried:
        ends = spark.createDataFrame(carried, "part int, before long, a long")
        late = ties.where("kind = 1").select("part", "b", "n").join(F.broadcast(ends), "part").where(F.col("n") * rule.num <= F.col("before") * rule.den)
        edges = edges.unionByName(late.select("a", "b"))
    return edges


ORDER = ["token", "place", "doc_id"]
TIES = {"kind": pa.int32(), "part": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "doc": pa.int64()}


def _ties(kind: int, part: int, a: list[int] | None, b: list[int], n: list[int] | None) -> pa.RecordBatch:
    none = pa.nulls(len(b), pa.int64())
    columns = [pa.array(np.full(len(b), kind, np.int32)), pa.array(np.full(len(b), part, np.int32)), none if a is None else pa.array(a, pa.int64()), pa.array(b, pa.int64()), none if n is None else pa.array(n, pa.int64()), none]
    return pa.RecordBatch.from_arrays(columns, names=list(TIES))


def _stars(part: int, parent: dict[int, int]) -> pa.RecordBatch:
    """A task's ties as stars, which take few rounds to connect."""
    pairs = [(root, d) for d in list(parent) if (root := _find(parent, d)) != d]
    return _ties(0, part, [p[0] for p in pairs], [p[1] for p in pairs], None)


def _find(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def _union(parent: dict[int, int], x: int, y: int) -> bool:
    x, y = _find(parent, x), _find(parent, y)
    if x == y:
        return False
    parent[max(x, y)] = min(x, y)
    return True


class Index:
    """Inverted lists over the sets of one block."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # A list of one set meets no other.
        several = counts > 1
        keep = several[inverse]
        owner, inverse = owner[keep], (np.cumsum(several) - 1)[inverse[keep]]
        order = np.argsort(inverse, kind="stable")
        ends = np.cumsum(counts[several])
        self.lists = [p.tolist() for p in np.split(owner[order], ends[:-1])] if len(ends) else []
        self.of = np.split(inverse, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])

    def search(self, query: int, least: int, after: int, rule: Rule, done) -> Iterator[int]:
        """Positions past `after` that link with `query`, by DivideSkip with threshold `least` or more; done(p) ones are passed over. Sets stand by size.

        The larger the other set, the larger the overlap of a link: each range of sizes has the threshold of its smallest.
        """
        mine = self.sizes[query]
        by_length = sorted(self.of[query].tolist(), key=lambda t: len(self.lists[t]))
        at = max(after + 1, bisect_left(self.sizes, -(-rule.num * mine // rule.den)))
        end = bisect_right(self.sizes, rule.den * mine // rule.num)
        ranges = []
        while at < end:
            ranges.append((at, to := bisect_right(self.sizes, self.sizes[at] + mine // RANGES, at, end)))
            at = to
        # The nearest sizes first: a link is likely there, and may end the search.
        for start, to in sorted(ranges, key=lambda r: abs(2 * query - r[0] - r[1])):
            need = max(least, -(-rule.num * (mine + self.sizes[start]) // (rule.num + rule.den)))
            if len(by_length) >= need:
                yield from self._merged(query, by_length, need, start, to, rule, done)

    def _merged(self, query: int, by_length: list[int], least: int, start: int, end: int, rule: Rule, done) -> Iterator[int]:
        """Positions from `start` to before `end` that link with `query`, whose lists come by length."""
        # Where each list enters the range; one that has no other set there does not count.
        here = []
        for t in by_length:
            x = self.lists[t]
            i = bisect_left(x, start)
            if i < len(x) and x[i] == query:
                i += 1
            if i < len(x) and x[i] < end:
                here.append((i, x, t))
        if len(here) < least:
            return
        mine, longest = self.sizes[query], len(here[-1][1])
        aside = min(least - 1, int(least / (ASIDE * max(longest, 2).bit_length() + 1)))
        short, long = here[: len(here) - aside], np.array(sorted(t for _, _, t in here[len(here) - aside :]), np.int64)
        need = least - aside
        heap = [(x[i], k, i) for k, (i, x, _) in enumerate(short)]
        heapq.heapify(heap)
        while len(heap) >= need:
            at = heap[0][0]
            popped = []
            while heap and heap[0][0] == at:
                popped.append(heapq.heappop(heap))
            if len(popped) >= need:
                # den * o >= num * (mine + other - o)
                wanted = -(-rule.num * (mine + self.sizes[at]) // (rule.num + rule.den))
                # A set's own shingles are in no list.
                if at != query and len(held := self.of[at]) >= wanted and not done(at):
                    # The long lists that hold `at` are among its own.
                    if len(popped) + np.count_nonzero(held[np.minimum(np.searchsorted(held, long), len(held) - 1)] == long) >= wanted:
                        yield at
                for _, k, i in popped:
                    if i + 1 < len(x := short[k][1]) and x[i + 1] < end:
                        heapq.heappush(heap, (x[i + 1], k, i + 1))
            else:
                while heap and len(popped) < need - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    return
                to = heap[0][0]
                for _, k, i in popped:
                    if (j := bisect_left(x := short[k][1], to, i)) < len(x) and x[j] < end:
                        heapq.heappush(heap, (x[j], k, j))


def block_links(rows: list[tuple[int, int, bool, np.ndarray]], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect all linking sets of which one is asked for. rows: id, linked group, whether it is asked for, set; by set size.

    Sets are searched for until those not searched for yet are in one group: between them there is nothing left to find.
    A set that links with the group that waits waits with it: the sets outside find their own links with it.
    """
    parent: dict[int, int] = {}
    first: dict[int, int] = {}
    size = [1] * len(rows)

    def join(p: int, q: int) -> int:
        p, q = _find(parent, p), _find(parent, q)
        if p != q:
            _union(parent, p, q)
            size[min(p, q)] += size[max(p, q)]
        return min(p, q)

    for p, (doc, group, _, _) in enumerate(rows):
        for key in (doc, group):
            join(first.setdefault(key, p), p)
    index = Index([r[3] for r in rows])
    links: list[tuple[int, int]] = []
    fixed = [p for p, r in enumerate(rows) if not r[2]]
    left = [p for p, r in enumerate(rows) if r[2]]
    while left:
        roots = {_find(parent, p) for p in fixed}
        if len({_find(parent, p) for p in left} | roots) == 1:
            break
        # The group whose sets wait: that of the sets not asked for, or the largest one.
        main = roots.pop() if len(roots) == 1 else None if roots else max({_find(parent, p) for p in left}, key=lambda r: (size[r], -r))
        grows = not fixed
        if grows and size[main] == 1:
            main = None
        waiting = []
        for p in left:
            if main is not None and _find(parent, p) == _find(parent, main):
                waiting.append(p)
                continue
            for other in index.search(p, _need(len(rows[p][3]), rule), -1, rule, lambda q, p=p: _find(parent, q) == _find(parent, p)):
                links.append((rows[p][0], rows[other][0]))
                root = join(p, other)
                if grows and size[root] > (size[_find(parent, main)] if main is not None else 1):
                    main = root
                if main is not None and _find(parent, main) == root:
                    waiting.append(p)
                    break
        left = waiting
    return links


def searched(rows: DataFrame, unit: list[str], rule: Rule) -> DataFrame:
    """Links a, b of `*unit, doc_id, grp, asked, n, shingles`, unit by unit."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        out: list[tuple[int, int]] = []
        for batch in slices(batches, 1024, 8):
            for *here, doc, group, asked, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != at:
                    out += block_links(held, rule) if len(held) > 1 else []
                    held, at = [], here
                held.append((doc, group, asked, np.frombuffer(raw, np.uint64)))
            yield _pairs(out)
            out = []
        yield _pairs(block_links(held, rule) if len(held) > 1 else [])

    dealt = rows.repartition(*unit).sortWithinPartitions(*unit, "n", "doc_id")
    return dealt.select(*unit, "doc_id", "grp", "asked", "shingles").mapInArrow(released(links), "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _blocked(rows: DataFrame, salt: int) -> DataFrame:
    """rows with `blocks` by their component's shingles, and a `block` by a salted hash of the id.

    Components of several blocks are at most one for every BLOCK / 2 shingles; a row of them is broadcast.
    """
    large = rows.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    sized = rows.drop("blocks", "block").join(F.broadcast(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return sized.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("blocks").cast("long")).cast("int"))


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with `grp`, the linked group so far."""
    groups = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("linked"))
    return rows.drop("grp").join(groups, "doc_id", "left").withColumn("grp", F.coalesce("linked", "doc_id")).drop("linked")


def _finished(several: DataFrame, links: DataFrame, rule: Rule) -> DataFrame:
    """The links that are left in components of several blocks: rows outside a component's largest group are searched for
    in blocks of all rows. Blocks hold sets of one size class, so a chunk meets those of its own class and the two beside it."""
    step = float(np.log(rule.den / rule.num)) if rule.num < rule.den else 1.0
    grouped = _grouped(several, links)
    sums = grouped.groupBy("component", "grp").agg(F.count("*").alias("rows"))
    main = sums.groupBy("component").agg(F.max_by("grp", F.struct("rows", "grp")).alias("main"))
    rest = written(grouped.join(F.broadcast(main), "component").withColumn("cls", F.floor(F.log("n") / step).cast("int")), "jaccard-rest")

    def counted(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy("component", "cls").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias(name))

    near = lambda c: F.explode(F.array(*[F.col(c) + F.lit(i) for i in (-1, 0, 1)]))
    one = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rest.where("grp <> main")
    blocks, chunks = counted(rest, "blocks"), counted(outside, "chunks")
    units = ["component", "cls", "block", "chunk_cls", "chunk"]
    columns = [*units, "doc_id", "grp", "asked", "n", "shingles"]
    rest = rest.drop("blocks", "block")
    index = rest.join(F.broadcast(blocks), ["component", "cls"]).withColumn("block", one("blocks", -1))
    index = index.withColumn("chunk_cls", near("cls")).join(F.broadcast(chunks.withColumnRenamed("cls", "chunk_cls")), ["component", "chunk_cls"]).withColumn("chunk", all_of("chunks")).withColumn("asked", F.lit(False))
    probes = outside.drop("blocks", "block").join(F.broadcast(chunks), ["component", "cls"]).withColumn("chunk", one("chunks", -2)).withColumnRenamed("cls", "chunk_cls")
    probes = probes.withColumn("cls", near("chunk_cls")).join(F.broadcast(blocks), ["component", "cls"]).withColumn("block", all_of("blocks")).withColumn("asked", F.lit(True))
    return searched(probes.select(*columns).unionByName(index.select(*columns)), units, rule)


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    facts = written(described(docs, rule), "jaccard-facts")
    own = facts.where("kind = 0")
    entries = prefix_entries(docs, rule, _frequent(facts, 1), _frequent(facts, 2))
    labels = connected_components(tied_edges(beside_others(entries, rule), rule)).select(F.col("node").alias("doc_id"), "component")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, 8):
            sets = shingle_sets(batch.column(1), rule.words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets])], names=["doc_id", "component", "n", "shingles"])

    # The candidates grow with the documents: both sides are dealt by id at every size, never broadcast.
    wanted = _docs(docs).join(labels.hint("merge"), "doc_id").select("doc_id", "text", "component")
    sets = written(wanted.mapInArrow(released(with_sets), "doc_id long, component long, n int, shingles binary").where("n > 0"), "jaccard-sets")
    block = ["component", "block"]
    alone = _blocked(sets.withColumn("grp", F.col("doc_id")).withColumn("asked", F.lit(True)), 0)
    links = written(searched(alone.where("blocks = 1"), block, rule), "jaccard-links")

    several = alone.where("blocks > 1")
    if not several.isEmpty():
        again = connected_components(tied_edges(rarest_entries(written(several, "jaccard-several"), rule), rule)).select(F.col("node").alias("doc_id"), "component")
        alone = written(_blocked(several.drop("component").join(again.hint("merge"), "doc_id"), 0), "jaccard-several")
        links = written(links.unionByName(searched(alone, block, rule)), "jaccard-links")
        several = alone.where("blocks > 1")
        leading, before, salt = several, several.count(), 1
        while before:
            place = F.row_number().over(Window.partitionBy(*block, "grp").orderBy("doc_id"))
            first = _grouped(leading, links).withColumn("place", place).where(F.col("place") <= LEADERS).drop("place")
            leading = written(_blocked(first, salt), "jaccard-leaders")
            links = written(links.unionByName(searched(leading, block, rule)), "jaccard-links")
            leading, salt = leading.where("blocks > 1"), salt + 1
            before, last = leading.count(), before
            if before >= last:
                break
        if salt > 1:
            links = written(links.unionByName(_finished(several, links, rule)), "jaccard-links")

    known = own.where("n > 0 AND doc_id IS NOT NULL")
    copies = with_group(known.select("doc_id", "n", "f1", "f2"), ["n", "f1", "f2"], F.min("doc_id").alias("b"), total=known.count()).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    final = connected_components(links.unionByName(copies)).select(F.col("node").alias("doc_id"), "component")
    return own.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
