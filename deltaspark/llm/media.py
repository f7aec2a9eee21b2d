"""Media columns: texts as WAV samples, and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded by zero bytes to a positive multiple of 64, are
the samples of a mono 8-bit WAV file. The file is read back by the wave
module, cut into Hann-windowed frames, and transformed (short-time Fourier).
In each of four frequency bands a frame's strongest bin is a peak if the band's
strength is a local maximum over time. Each peak is paired with the next
FAN peaks in order of time, at most REACH frames away; a pair is one 64-bit
code, its time in the upper bits and (bin, bin, distance) in the lower ones,
so a fingerprint is an array in order of time.

Defined results: a null or empty text is 64 zero bytes;
equal texts have equal values; repeated rows are repeated; an empty table gives
an empty result; further columns are ignored. Frames are transformed in blocks
of fixed size, so a very long text needs memory for its samples only.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import lean

RATE = 8000
FRAME = 256
HOP = 128
BANDS = ((2, 12), (12, 28), (28, 60), (60, 128))
FAN = 3
REACH = 24
BLOCK = 1024
UNIT = 64
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(samples: bytes) -> bytes:
    """A mono 8-bit WAV file of these samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("not a mono 8-bit file")
        return f.readframes(f.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band, the strongest bin and its magnitude."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    signal = np.zeros((frames - 1) * HOP + FRAME, dtype=np.float32)
    signal[: len(samples)] = samples
    signal[: len(samples)] -= 128
    cut = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    bins, strength = np.empty((frames, len(BANDS)), dtype=np.int64), np.empty((frames, len(BANDS)), dtype=np.float32)
    for a in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(cut[a : a + BLOCK] * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for k, (lo, hi) in enumerate(BANDS):
            best = power[:, lo:hi].argmax(axis=1)
            bins[a : a + BLOCK, k] = best + lo
            strength[a : a + BLOCK, k] = power[np.arange(len(best)), best + lo]
    return bins, strength


def fingerprint(samples: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of peaks, and the time-coded pairs in order of time."""
    bins, strength = band_peaks(samples)
    edge = np.zeros((1, len(BANDS)), dtype=np.float32)
    before, after = np.concatenate([edge, strength[:-1]]), np.concatenate([strength[1:], edge])
    times, bands = np.nonzero((strength > 1) & (strength > before) & (strength >= after))
    at = bins[times, bands]
    codes = []
    for step in range(1, FAN + 1):
        gap = times[step:] - times[:-step]
        near = gap <= REACH
        codes.append((times[:-step] << 24 | at[:-step] << 16 | at[step:] << 8 | gap)[near])
    return len(times), np.sort(np.concatenate(codes))


_DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_peaks long, n_pairs long, feature string, codes array<long>"


def media(docs: DataFrame, store: bool = False) -> DataFrame:
    """doc_id, digests of each text's media, `codes` (the fingerprint); with store also `media` (the file)."""
    schema = f"doc_id long, {_DIGESTS}" + (", media binary" if store else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]

    def one(text: bytes) -> tuple:
        payload = text + bytes(-len(text) % UNIT or (0 if text else UNIT))
        stored = to_wav(payload)
        back = from_wav(stored)
        peaks, codes = fingerprint(np.frombuffer(back, dtype=np.uint8))
        feature = f"{peaks}:{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()[:32]}"
        row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), peaks, len(codes), feature, codes)
        return row + ((stored,) if store else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                if part.num_rows:
                    rows = zip(*[one(bytes(t.as_buffer() or b"") if t.is_valid else b"") for t in part.column(1)])
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(rows, kinds[1:]))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)
