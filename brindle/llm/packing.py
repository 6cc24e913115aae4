"""Packing along a space-filling curve: similar documents become neighbours in the training sequences.

Each document's byte 4-grams are hashed into a vector, the vector is projected to a few dimensions, and the projected
point's Hilbert index is the sort key. Rows are dealt to ranges of the curve that hold about as many bytes each, bounded
by whole keys at every size of the table; only rows of one and the same key, such as a large group of copies, are spread
over several ranges by a hash of id and text. Each range is sorted by key and packed as one stream: a sequence ends after
exactly `size` ids. What is left at the end of a range is cut into sequences of powers of two, which need no padding.

Nulls, ties and repeats: a null text is an empty document, which is one end id; a null id keeps its pieces; rows of equal
key follow each other by a hash of id and text; every row is packed. Very long texts are cut over as many sequences as
they need. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import released, slices, text_bytes, written
from brindle.llm.encoding import encoder

#: The bytes of a range, and the most ranges: beyond that they grow, which costs no memory as a range is streamed.
RANGE, RANGES = 16 << 20, 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hashed_vector(text: bytes, width: int = 256) -> np.ndarray:
    """Unit vector of hashed byte 4-gram counts."""
    raw = np.frombuffer(text + b"\0" * (4 - len(text) if len(text) < 4 else 0), np.uint8).astype(np.uint32)
    grams = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(24), minlength=256)[:width].astype(np.float64)
    return counts / np.linalg.norm(counts)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of each row of cell coordinates below 2**bits (the transpose form of the curve)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        low = bit - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


def curve_keys(texts: list[bytes], dims: int = 4, bits: int = 10, reach: float = 0.25) -> np.ndarray:
    """Hilbert keys of texts. The projection is a fixed Gaussian matrix; coordinates beyond +-reach share the outer cells."""
    if not texts:
        return np.zeros(0, np.int64)
    matrix = np.random.RandomState(7).normal(size=(256, dims)) / 16
    points = np.array([(hashed_vector(t)[:, None] * matrix).sum(axis=0) for t in texts])
    return hilbert_index(np.clip((points / reach + 1) * (1 << bits - 1), 0, (1 << bits) - 1).astype(np.int64), bits)


def with_curve_key(docs: DataFrame) -> DataFrame:
    """`doc_id, text` with `key`, the document's place on the curve."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, 16):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve_keys(text_bytes(batch.column(1))))], names=["doc_id", "text", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(keyed), "doc_id long, text string, key long")


def in_curve_ranges(keyed: DataFrame) -> DataFrame:
    """`doc_id, text, key, tie` in partitions that are ranges of the curve, each sorted by key.

    Ranges are bounded by whole keys, and by a hash only among rows of one key; Spark draws the bounds from a sample of the
    rows, which is written first so that a repeated task meets the same rows.
    """
    rows = written(keyed.withColumn("tie", F.xxhash64("doc_id", "text")), "packing-keys")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("n")).first()["n"] or 0
    return rows.repartitionByRange(max(1, min(RANGES, -(-total // RANGE))), "key", "tie").sortWithinPartitions("key", "tie")


class _Stream:
    """One range's sequences. Only the pieces of the open sequence, at most `size` ids, are held."""

    def __init__(self, part: int, size: int) -> None:
        self.size, self.sequence, self.filled, self.open = size, part << 40, 0, []
        self.rows: list[tuple] = []

    def _emit(self, doc: int | None, start: int, ids: bytes, total: int, at: int) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, at))

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.size - self.filled)
            self.open.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            self.filled += n
            start += n
            if self.filled == self.size:
                self._close(self.size)

    def _close(self, length: int) -> None:
        """Ends the sequence after `length` of the held ids; the rest stays open."""
        at, rest = 0, []
        for doc, start, ids, total in self.open:
            n = min(len(ids) // 4, length - at)
            if n > 0:
                self._emit(doc, start, ids[: 4 * n], total, at)
            if 4 * n < len(ids):
                rest.append((doc, start + max(n, 0), ids[4 * max(n, 0) :], total))
            at += max(n, 0)
        self.open, self.filled = rest, self.filled - length
        self.sequence += 1

    def end(self) -> None:
        while self.filled:
            self._close(1 << self.filled.bit_length() - 1)

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, byte_level: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, coder, end = _Stream(TaskContext.get().partitionId(), size), encoder(vocabulary, byte_level), np.uint32(end_id).tobytes()
        for batch in slices(batches, 8192, 24):
            ids, bounds = coder.encode(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                stream.add(doc, ids[a:b].tobytes() + end)
            yield stream.take()
        stream.end()
        yield stream.take()

    return in_curve_ranges(with_curve_key(docs)).select("doc_id", "text").mapInArrow(released(packed), PIECES)
