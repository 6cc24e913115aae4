"""Media columns: lossless 8-bit audio of a byte payload, and features read back from the stored form.

`encode` stores a payload as an 8-bit mono PCM file (a 44-byte header, then one byte per sample). `features` reads such
files: a polyphase FIR resampler by UP/DOWN, overlapped Hann frames, log-mel filterbanks, and segments by hysteresis on
frame energy (a segment starts at the high threshold and lasts until energy falls below the low one). Log-mel windows of
one fixed shape (FRAMES x MELS, the last padded with the floor) form an Arrow fixed-shape tensor column with the time
span of each window, kept as an Arrow IPC stream in a binary column. Media are a written table in the shared folder;
features come from what is read back of it.

Nulls, ties and repeats: a null text is empty and gives 64 zero bytes; equal texts give equal values; every row has a
result, a null id too. Very long texts are processed whole, their frames in blocks. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import released, slices, text_bytes, written

RATE, UP, DOWN, TAPS = 8000, 2, 5, 8
FRAME, HOP, MELS, FRAMES = 256, 128, 24, 8
HEADER = 44


def payload(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + b"\0" * (64 - len(text) if not text else -len(text) % 64)


def to_media(data: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; sizes beyond the header's 32 bits are written as the streaming marker."""
    size = min(len(data), 0xFFFFFFFF - 36)
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", size) + data


def from_media(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a stored file."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit PCM file of this writer")
    if struct.unpack("<HH", media[20:24]) != (1, 1) or struct.unpack("<H", media[34:36]) != (8,):
        raise ValueError("only 8-bit mono PCM is stored")
    return struct.unpack("<I", media[24:28])[0], media[HEADER:]


@cache
def _phases() -> np.ndarray:
    """UP rows of TAPS coefficients of a windowed-sinc low-pass at the lower of both half rates."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    h *= UP / h.sum()
    return h.reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP/DOWN of its rate; each output needs only its phase's TAPS coefficients."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    y = np.zeros(n, np.float32)
    for p in range(UP):
        # Outputs p, p + UP, ... all use one phase and step DOWN samples.
        at, phase = divmod(p * DOWN, UP)
        m = len(y[p::UP])
        for k, c in enumerate(_phases()[phase]):
            first = at + TAPS - 1 - k
            y[p::UP] += c * padded[first : first + m * DOWN : DOWN][:m]
    return y


@cache
def _bank() -> np.ndarray:
    """MELS triangular filters, evenly spaced on the mel scale."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1) / (rate / 2) * (FRAME // 2)
    bins = np.arange(FRAME // 2 + 1)[:, None]
    up, down = (bins - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - bins) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: bytes, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and log energies of all frames; at least one frame, the end padded with silence."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    count = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros((count - 1) * HOP + FRAME - len(y), np.float32)]) if (count - 1) * HOP + FRAME > len(y) else y
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:count]
    window = np.hanning(FRAME).astype(np.float32)
    mels, energies = [], []
    for i in range(0, count, block):
        part = frames[i : i + block] * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        mels.append(np.log(power @ _bank() + 1e-6))
        energies.append(np.log((part * part).mean(axis=1) + 1e-9))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energies)


def segments(energy: np.ndarray, high: float = 0.5, low: float = 0.1) -> list[tuple[int, int]]:
    """Frame spans [first, end): runs above the low threshold with a frame above the high one (in deviations from the median)."""
    middle, spread = np.median(energy), energy.std() + 1e-6
    above, strong = energy >= middle + low * spread, energy >= middle + high * spread
    edges = np.flatnonzero(np.diff(np.concatenate([[0], above.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(strong)])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if total[b] > total[a]]


def tensor_stream(mels: np.ndarray) -> bytes:
    """An IPC stream: tensor (fixed shape FRAMES x MELS), start_s and end_s per window."""
    count = -(-len(mels) // FRAMES)
    full = np.full((count * FRAMES, MELS), np.log(1e-6), np.float32)
    full[: len(mels)] = mels
    rate = RATE * UP / DOWN
    first = np.arange(count) * FRAMES
    last = np.minimum(first + FRAMES, len(mels)) - 1
    batch = pa.RecordBatch.from_arrays(
        [pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(count, FRAMES, MELS)), pa.array(first * HOP / rate), pa.array((last * HOP + FRAME) / rate)], names=["tensor", "start_s", "end_s"]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def encode(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, media."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048, 8):
            raw = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([to_media(payload(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(stored), "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, segments array<struct<start_s:double,end_s:double>>, tensor binary"


def features(media: DataFrame) -> DataFrame:
    """Per stored file: checksums of what was read back, segments in seconds, and the tensor stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = RATE * UP / DOWN
        spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in slices(batches, 2048, 8):
            rows = []
            for stored in batch.column(2).to_pylist():
                _, samples = from_media(stored)
                mels, energy = log_mel(samples)
                found = [{"start_s": a * HOP / rate, "end_s": ((b - 1) * HOP + FRAME) / rate} for a, b in segments(energy)]
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(mels), found, tensor_stream(mels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), spans, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[c.split()[0] for c in FEATURES.replace(":double,", "").split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(released(read), FEATURES)


def op4_audio(docs: DataFrame) -> DataFrame:
    """The contract's digests, then the segments and the tensor stream; feature is frames, segments and a checksum of that stream."""
    digest = F.concat_ws(":", F.col("frames").cast("string"), F.size("segments").cast("string"), F.hex(F.crc32("tensor")))
    return features(written(encode(docs), "audio-media")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", digest.alias("feature"), "segments", "tensor")
