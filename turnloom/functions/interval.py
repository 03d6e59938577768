"""Intervals ``[start, end)``: overlap, clipping, durations, frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length, 0 where there is none."""
    length = F.least(e1, e2) - F.greatest(s1, s2)
    return F.greatest(length, length * 0)


def clip(start: Column, end: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Start and end within ``[lo, hi)``, and whether anything is left."""
    s, e = F.greatest(start, lo), F.least(end, hi)
    return s, e, e > s


def duration(start: Column, end: Column) -> Column:
    """Length, at least 0."""
    return F.greatest(end - start, F.lit(0))


def duration_weight(start: Column, end: Column) -> Column:
    """Length as a weight; 1.0 where there is none."""
    d = duration(start, end)
    return F.when(d > 0, d).otherwise(F.lit(1.0))


def phrase_weight(seconds: Column) -> Column:
    """How much a phrase moves a centre: 0.02 under 1 s, 0.05 under 3 s, else 0.15."""
    return F.when(seconds < 1, 0.02).when(seconds < 3, 0.05).otherwise(0.15)


def frame_to_time(frame: Column, frames: Column, window_s: Column) -> Column:
    return frame / frames * window_s


def frames_of(start: Column, end: Column, step: float) -> Column:
    """All frame numbers an interval touches: ``int(start / step)`` up to ``int(end / step)``."""
    return F.sequence((start / step).cast("long"), (end / step).cast("long"))
