"""Audio as columns: arrays of float samples, 16-bit PCM and WAV bytes.

Null stays null everywhere. Samples are dense arrays, so these run as pandas functions over numpy, one array at a time.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType

RATE = 16_000
HEADER = 44


def normalized(x: np.ndarray, gate_ratio: float = 0.1, gate_floor: float = 1e-5, target: float = 0.1, most_gain: float = 10.0, peak: float = 0.99, least_gain: float = 1.5) -> np.ndarray:
    """Samples around zero, those under a share of the level silenced, and quiet audio raised towards ``target``.

    The gain is bounded, keeps the largest sample under ``peak``, and is applied only above ``least_gain``."""
    x = np.asarray(x, np.float32)
    if not len(x):
        return x
    x = x - np.float32(x.mean(dtype=np.float64))
    level = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    if level < 1e-4:
        return x
    x = np.where(np.abs(x) < max(level * gate_ratio, gate_floor), np.float32(0), x)
    level = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    if not 1e-4 <= level < target:
        return x
    gain = min(target / level, most_gain, peak / float(np.abs(x).max()))
    # The bound on the peak is meant for gains above 1 alone.
    return x * np.float32(gain) if gain > least_gain else x


def to_pcm(x: np.ndarray) -> bytes:
    """16-bit little-endian samples, truncated towards zero and clamped."""
    scaled = np.trunc(np.asarray(x, np.float32) * np.float32(32767))
    return np.clip(scaled, -32768, 32767).astype("<i2").tobytes()


def from_pcm(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / np.float32(32768)


def wav_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    """A mono 16-bit WAV file."""
    data = to_pcm(x)
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16)
    return head + b"data" + struct.pack("<I", len(data)) + data


def wav_samples(raw: bytes, rate: int = RATE) -> np.ndarray:
    """All samples of a mono 16-bit WAV file of that rate; other files are refused."""
    channels, own_rate, bits = struct.unpack_from("<HI6xH", raw, 22)
    if raw[:4] != b"RIFF" or (channels, own_rate, bits) != (1, rate, 16):
        raise ValueError("not a mono 16-bit WAV file of the rate asked for")
    return from_pcm(raw[HEADER:])


def wav_range(raw: bytes, start_ms: int, end_ms: int, rate: int = RATE, most_ms: int = 60_000) -> np.ndarray | None:
    """The samples of [start, end), or None if that is empty, longer than ``most_ms`` or not all there."""
    first, last = HEADER + start_ms * rate * 2 // 1000 // 2 * 2, HEADER + end_ms * rate * 2 // 1000 // 2 * 2
    if not 0 < end_ms - start_ms <= most_ms or start_ms < 0 or len(raw) < last:
        return None
    return from_pcm(raw[first:last])


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None for v in x) else f(*x) for x in zip(*columns, strict=True)], dtype=object)


@pandas_udf(ArrayType(FloatType()))
def normalize_audio(x: pd.Series) -> pd.Series:
    return _each(normalized, x)


@pandas_udf(BinaryType())
def encode_pcm(x: pd.Series) -> pd.Series:
    return _each(to_pcm, x)


@pandas_udf(ArrayType(FloatType()))
def decode_pcm(raw: pd.Series) -> pd.Series:
    return _each(from_pcm, raw)


@pandas_udf(BinaryType())
def encode_wav(x: pd.Series) -> pd.Series:
    return _each(wav_bytes, x)


@pandas_udf(ArrayType(FloatType()))
def decode_wav(raw: pd.Series) -> pd.Series:
    return _each(wav_samples, raw)


@pandas_udf(ArrayType(FloatType()))
def decode_wav_range(raw: pd.Series, start_ms: pd.Series, end_ms: pd.Series) -> pd.Series:
    return _each(lambda r, s, e: wav_range(r, int(s), int(e)), raw, start_ms, end_ms)


def cut_samples(x: Column, from_ms: Column, until_ms: Column, rate: int = RATE) -> Column:
    """The samples between two times, both clamped to the array; empty where nothing is between."""
    at = lambda ms: F.greatest(F.lit(0), F.least(F.size(x), F.floor(ms * rate / 1000))).cast("int")
    return F.slice(x, at(from_ms) + 1, F.greatest(F.lit(0), at(until_ms) - at(from_ms)))


def level(x: Column) -> Column:
    """Root mean square; 0 for no samples."""
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(x) > 0, F.sqrt(total / F.size(x))).otherwise(0.0)
