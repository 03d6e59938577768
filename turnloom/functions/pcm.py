"""16-bit little-endian PCM in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000


def check_pcm(pcm: Column, rate: Column | None = None, channels: Column | None = None) -> Column:
    """Why a chunk can't be used: a text, or null for a sound one (16 kHz, mono, an even number of bytes)."""
    out = F.when(F.octet_length(pcm) % 2 == 1, F.lit("odd number of bytes"))
    if rate is not None:
        out = F.when(rate != RATE, F.lit("not 16 kHz")).otherwise(out)
    return F.when(channels != 1, F.lit("not mono")).otherwise(out) if channels is not None else out


def samples(pcm: Column) -> Column:
    """Whole numbers -32768..32767 of a chunk; an odd number of bytes is an error."""
    at = F.sequence(F.lit(1), F.octet_length(pcm) - 1, F.lit(2))
    # Both bytes are read at once, as high * 256 + low of the other order.
    swapped = lambda i: F.conv(F.hex(F.substring(pcm, i, F.lit(2))), 16, 10).cast("int")
    value = lambda v: F.shiftleft(v.bitwiseAND(255), 8).bitwiseOR(F.shiftright(v, 8)).bitwiseXOR(32768) - 32768
    return (
        F.when(F.octet_length(pcm) % 2 == 1, F.raise_error(F.lit("odd number of bytes")))
        .when(F.octet_length(pcm) == 0, F.array().cast("array<int>"))
        .otherwise(F.transform(F.transform(at, swapped), value))
    )


def to_float(sample: Column) -> Column:
    return sample / F.lit(32768.0)


def to_int16(x: Column) -> Column:
    """-1..1 to -32767..32767, clipped and truncated."""
    return (F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int")


def seconds(pcm: Column) -> Column:
    return F.octet_length(pcm) / F.lit(2.0 * RATE)


def time_slice(pcm: Column, offset_s: Column, start_s: Column, end_s: Column) -> Column:
    """The bytes of ``[start_s, end_s)`` of a chunk that begins at ``offset_s``, whole samples, clamped; maybe empty."""
    n = F.floor(F.octet_length(pcm) / 2)
    a = F.least(F.greatest(((start_s - offset_s) * RATE).cast("long"), F.lit(0)), n)
    b = F.least(F.greatest(((end_s - offset_s) * RATE).cast("long"), F.lit(0)), n)
    return F.substring(pcm, (a * 2 + 1).cast("int"), (F.greatest(b - a, F.lit(0)) * 2).cast("int"))


def audio_message(pcm: Column) -> Column:
    """A chunk as the JSON message a transcriber takes."""
    return F.to_json(F.struct(F.lit("input_audio_chunk").alias("message_type"), F.base64(pcm).alias("audio_base_64")))


def window_offsets(n: Column, window: int, hop: int, flush: bool = True) -> Column:
    """Starts of the windows over ``n`` samples: the full ones, and with ``flush`` one more, padded, if any sample is left after the last hop."""
    full = F.when(n >= window, F.floor((n - window) / hop) + 1).otherwise(F.lit(0).cast("long"))
    total = full + (F.when(n - full * hop > 0, 1).otherwise(0) if flush else F.lit(0))
    return F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), total - 1), lambda i: i * hop)).otherwise(F.array().cast("array<bigint>"))
