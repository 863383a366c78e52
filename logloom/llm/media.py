"""Media columns: texts' bytes as 8-bit WAV, spectra by short-time Fourier transform, peak-pair prints.

A payload (UTF-8, zero-padded to a positive multiple of 64) is written with the wave module as mono
8-bit samples, read back, and cut into frames of FRAME samples. Each frame's magnitude spectrum gives
its strongest bin in every frequency band; a peak is a bin that is at least the mean of its frame.
Every peak is paired with the peaks of the next FAN frames in the same band; a pair (bin, later bin,
distance) with its frame is one element of the print: a time-coded array.

One pass per row in Arrow batches, no shuffle. Memory is that of one text's spectra.

Defined results: null or empty text is 64 zero bytes. One row per input row, equal texts give equal
values, and columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, utf8, values

RATE, FRAME, FAN = 8000, 256, 3
#: Edges of the frequency bands, in bins of the half spectrum.
BANDS = (1, 8, 24, 56, 129)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def spectra(samples: bytes) -> np.ndarray:
    """Magnitudes, frames x bins; the last frame is padded with the middle level."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    n = -(-len(x) // FRAME)
    x = np.pad(x, (0, n * FRAME - len(x))).reshape(n, FRAME)
    return np.abs(np.fft.rfft(x * np.hanning(FRAME).astype(np.float32), axis=1))


def fingerprint(samples: bytes, chunk: int = 4096) -> np.ndarray:
    """Time-coded prints: rows (frame, code), code = bin * 2^16 + later bin * 2^4 + distance, in order."""
    bins, strong = [], []
    for at in range(0, len(samples), chunk * FRAME):
        mag = spectra(samples[at : at + chunk * FRAME])
        floor = mag.mean(axis=1)
        band_bins = np.stack([lo + mag[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:], strict=False)], axis=1)
        bins.append(band_bins)
        strong.append(np.take_along_axis(mag, band_bins, axis=1) >= floor[:, None])
    b, ok = np.concatenate(bins).astype(np.int64), np.concatenate(strong)
    found = []
    for gap in range(1, FAN + 1):
        if len(b) > gap:
            both = ok[:-gap] & ok[gap:]
            frame, band = np.nonzero(both)
            found.append(np.stack([frame, b[frame, band] * 65536 + b[frame + gap, band] * 16 + gap], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, wav (binary), times and codes (parallel arrays): the general operator."""

    def run(batch, _):
        wavs, times, codes = [], [], []
        for raw in utf8(batch, "_text"):
            wavs.append(to_wav(padded(raw)))
            rows = fingerprint(from_wav(wavs[-1]))
            times.append(rows[:, 0])
            codes.append(rows[:, 1])
        return {"doc_id": values(batch, "_id"), "wav": wavs, "times": times, "codes": codes}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), run, "doc_id long, wav binary, times array<long>, codes array<long>", step=64)


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same pass, with digests in place of the stored bytes and the prints."""

    def run(batch, _):
        out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for raw in utf8(batch, "_text"):
            stored = to_wav(padded(raw))
            back = from_wav(stored)
            rows = fingerprint(back)
            out["n_bytes"].append(len(raw))
            out["payload_bytes"].append(len(back))
            out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
            out["tail_crc32"].append(zlib.crc32(back[-64:]))
            out["media_bytes"].append(len(stored))
            out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            out["feature"].append(f"{-(-len(back) // FRAME)}:{len(rows)}:{hashlib.sha256(rows.astype('<i8').tobytes()).hexdigest()[:32]}")
        return {"doc_id": values(batch, "_id"), **out}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_columns(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), run, schema)
