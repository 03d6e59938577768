"""WAV and raw PCM files as chunks, mixed down or beamformed."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CHUNK = 3_200
RATE = 16_000


def wav_pcm(content: bytes, path: str) -> bytes:
    """The samples of a 16 kHz mono 16-bit WAV file; raw PCM as it is, without an odd last byte."""
    if not (path.lower().endswith(".wav") or content[:4] == b"RIFF"):
        return content[: len(content) // 2 * 2]
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError(f"{path}: no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data":
            if form is None or form[0] != 1 or (form[1], form[2], form[5]) != (1, RATE, 16):
                raise ValueError(f"{path}: not 16 kHz mono 16-bit PCM")
            return content[at + 8 : at + 8 + size // 2 * 2]
        at += 8 + size + size % 2
    raise ValueError(f"{path}: no data")


def chunks_of(df: DataFrame, content: str, key: str, chunk: int = CHUNK) -> DataFrame:
    """``key``, ``seq``, ``pcm`` of the audio files in a column (see ``wav_pcm``); an empty file has no rows."""

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, raw in zip(batch[key], batch[content]):
                pcm = wav_pcm(bytes(raw), str(name))
                out += [(name, i // chunk, pcm[i : i + chunk]) for i in range(0, len(pcm), chunk)]
            yield pd.DataFrame(out, columns=[key, "seq", "pcm"])

    return df.select(key, content).mapInPandas(cut, f"`{key}` {dict(df.dtypes)[key]}, seq bigint, pcm binary")


def read_pcm(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``path``, ``seq``, ``pcm`` of audio files; an empty file has no rows."""
    return chunks_of(spark.read.format("binaryFile").load(path), "content", "path", chunk)


def mix_down(pcm: bytes, channels: int, method: str = "mean") -> bytes:
    """Interleaved channels as one: the mean, truncated, or the clipped sum; an incomplete last frame is left out."""
    if channels < 2:
        raise ValueError("mixing needs at least two channels")
    x = np.frombuffer(pcm[: len(pcm) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).astype(np.int64)
    out = np.trunc(x.mean(axis=1)) if method == "mean" else np.clip(x.sum(axis=1), -32768, 32767)
    return out.astype("<i2").tobytes()


def mixed(df: DataFrame, pcm: str, channels: int, method: str = "mean") -> DataFrame:
    @F.pandas_udf(BinaryType())
    def mix(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda c: None if c is None else mix_down(bytes(c), channels, method))

    return df.withColumn(pcm, mix(F.col(pcm)))


def steering(positions: np.ndarray, direction: np.ndarray, frequency: float, speed: float = 343.0) -> np.ndarray:
    """Phases of a plane wave from ``direction`` at each microphone."""
    return np.exp(-2j * np.pi * frequency * (positions @ direction) / speed)


def steering_of(position: Column, frequency: Column, direction: list[float], speed: float = 343.0) -> Column:
    """``steering`` of a microphone (an array of three metres) at a frequency, as ``re`` and ``im``."""
    way = np.asarray(direction, float)

    @F.pandas_udf("re double, im double")
    def phases(at: pd.Series, hertz: pd.Series) -> pd.DataFrame:
        out = steering(np.array(at.tolist(), float).reshape(-1, 3), way, hertz.to_numpy(float), speed)
        return pd.DataFrame({"re": out.real, "im": out.imag})

    return phases(position, frequency)


def mixed_stream(df: DataFrame, key: str, order: str, pcm: str, channels: int, method: str = "mean") -> DataFrame:
    """``key``, ``order``, ``pcm`` of interleaved chunks mixed down in order: bytes left of a chunk go before the next.

    What is left at the end of a stream is no frame. Null chunks are empty ones. A stream is read in order by one task.
    """
    types = dict(df.dtypes)

    def mix(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, rest = None, b""
        for batch in batches:
            out = []
            for k, at, chunk in zip(batch[key], batch[order], batch[pcm]):
                if k != stream:
                    stream, rest = k, b""
                data = rest + bytes(chunk or b"")
                whole = len(data) // (2 * channels) * 2 * channels
                rest = data[whole:]
                out.append((k, at, mix_down(data[:whole], channels, method)))
            yield pd.DataFrame(out, columns=[key, order, pcm])

    ordered = df.select(key, order, pcm).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(mix, f"`{key}` {types[key]}, `{order}` {types[order]}, `{pcm}` binary")


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """The channels (rows by frame) of a PCM WAV file of 8, 16, 24 or 32 bits as -1..1, and its rate."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data":
            if form is None or form[0] not in (1, 3, 0xFFFE):
                raise ValueError("not PCM")
            kind, channels, rate, _, _, bits = form
            width = bits // 8
            raw = np.frombuffer(content[at + 8 : at + 8 + size][: size // (width * channels) * width * channels], np.uint8).reshape(-1, width)
            if kind == 3:
                x = np.ascontiguousarray(raw).view(f"<f{width}").astype(float)
            elif bits == 8:
                x = (raw.astype(float) - 128) / 128
            else:
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, 4 - width :] = raw
                x = wide.view("<i4").astype(float) / 2**31
            return x.reshape(-1, channels), rate
        at += 8 + size + size % 2
    raise ValueError("no data")


def resampled(x: np.ndarray, rate: int, to: int = RATE, taps: int = 32) -> np.ndarray:
    """A mono signal at another rate, by a windowed sinc below the lower of both bands' limits."""
    if rate == to or not len(x):
        return x
    n = int(np.ceil(len(x) * to / rate))
    band = min(1.0, to / rate)
    out = np.zeros(n)
    reach = int(np.ceil(taps / band))
    padded = np.pad(x, reach)
    for lo in range(0, n, 65_536):
        centre = np.arange(lo, min(n, lo + 65_536)) * (rate / to)
        first = np.floor(centre).astype(int)
        offsets = np.arange(-reach + 1, reach + 1)
        distance = centre[:, None] - (first[:, None] + offsets)
        weights = band * np.sinc(band * distance) * (0.5 + 0.5 * np.cos(np.pi * np.clip(distance / reach, -1, 1)))
        out[lo : lo + len(centre)] = (padded[first[:, None] + offsets + reach] * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-12)
    return out


def mono_slice(content: bytes, start_s: float = 0.0, seconds: float | None = None) -> np.ndarray:
    """``[start_s, start_s + seconds)`` of a WAV file as 16 kHz mono: the mean of its channels, resampled."""
    x, rate = wav_samples(content)
    mono = resampled(x.mean(axis=1), rate)
    first = int(start_s * RATE)
    return mono[first : None if seconds is None else first + int(seconds * RATE)]


def mono_of(df: DataFrame, content: str, key: str, start_s: float = 0.0, seconds: float | None = None) -> DataFrame:
    """``key`` and ``samples`` (floats at 16 kHz) of WAV files in a column, of any rate and number of channels."""

    def load(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "samples": [mono_slice(bytes(c), start_s, seconds).astype(np.float32) for c in batch[content]]})

    return df.select(key, content).mapInPandas(load, f"`{key}` {dict(df.dtypes)[key]}, samples array<float>")


def read_mono(spark: SparkSession, path: str, start_s: float = 0.0, seconds: float | None = None) -> DataFrame:
    """``path`` and ``samples`` (floats at 16 kHz) of WAV files of any rate and number of channels."""

    return mono_of(spark.read.format("binaryFile").load(path), "content", "path", start_s, seconds)


def beam_weights(channels: int, positions: np.ndarray, direction: np.ndarray, n_fft: int) -> np.ndarray:
    """Weights of each channel (columns) at each frequency of a block of ``n_fft`` samples."""
    return np.stack([steering(positions, direction, f) / channels for f in np.fft.rfftfreq(n_fft, 1 / RATE)])


def beams(chunks: list[bytes], channels: int, weights: np.ndarray, n_fft: int, most: int = 4_096) -> list[bytes]:
    """``delay_and_sum`` of several chunks, up to ``most`` blocks of them in one transform."""
    width = 2 * channels * n_fft
    counts = np.array([len(c) // width for c in chunks], int)
    data = np.frombuffer(b"".join(c[: n * width] for c, n in zip(chunks, counts)), "<i2").reshape(-1, n_fft, channels)
    out = np.empty((len(data), n_fft), "<i2")
    for lo in range(0, len(data), most):
        spectrum = np.fft.rfft(data[lo : lo + most].astype(float), axis=1)
        out[lo : lo + most] = np.clip(np.fft.irfft((weights.conj() * spectrum).sum(axis=2), n_fft, axis=1), -32768, 32767)
    ends = np.cumsum(counts)
    return [out[end - n : end].tobytes() for n, end in zip(counts, ends)]


def delay_and_sum(pcm: bytes, channels: int, positions: np.ndarray, direction: np.ndarray, n_fft: int = 512) -> bytes:
    """Channels steered to a direction and averaged, block by block of ``n_fft`` samples; a shorter tail is left out.

    With white noise the minimum-variance weights are these same ones.
    """
    return beams([pcm], channels, beam_weights(channels, positions, direction, n_fft), n_fft)[0]


def beamformed(df: DataFrame, pcm: str, channels: int, positions: list[list[float]], direction: list[float], n_fft: int = 512) -> DataFrame:
    weights = beam_weights(channels, np.asarray(positions, float), np.asarray(direction, float), n_fft)

    @F.pandas_udf(BinaryType())
    def beam(chunks: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(chunks), index=chunks.index, dtype=object)
        there = chunks.notna()
        out[there] = beams([bytes(c) for c in chunks[there]], channels, weights, n_fft)
        return out

    return df.withColumn(pcm, beam(F.col(pcm)))
