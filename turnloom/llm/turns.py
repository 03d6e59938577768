"""Speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .nearest_time import nearest_in_time
from .runs import collapse_runs

# What opens and closes a sound annotation.
OPENERS = {"[": "]", "(": ")", "{": "}", "<": ">", "*": "*", "#": "#", "~": "~", "♪": "♪", "♫": "♫", "【": "】", "（": "）"}

# Signs that also stand alone, as a mark, and what one of them still opens when its second is cut off.
NOTES = ("♪", "♫")
_MUSIC = re.compile(r"\s*(?:\w+\s+){0,2}(?:music|singing|humming)\s*", re.IGNORECASE)

# Sounds of hesitation, each letter as long as the speaker draws it.
FILLER = re.compile(r"u+[hm]+|u+-u+[hm]+|e+r+m*|e+h+m*|a+h+m*|h+m+|m{2,}|m+-?h+m+|u+h+-?h*u+h+|e+u+h+|[äæ]+h*m*|ö+h+m*")

_CUE = re.compile(r"(?:\d+:)?\d\d?:\d\d(?:[.,]\d+)?\s*-->\s*.*")
_TAG = re.compile(r"(?:>>|[-–—>])+\s*|<v\s+[^>]*>|(?:[A-Z]|\d{1,3}|(?:SPK|SPEAKER|Speaker|Spk)[ _-]?\w{1,4})\s*[:>]\s+|(?:SPK|SPEAKER|Speaker|Spk)[ _-]?\w{1,4}\s*[:>]\s*|(?:[A-Z]|\d{1,3}):$")
_HEADS = ("WEBVTT", "NOTE", "STYLE", "REGION")


def _opens(line: str, at: int) -> bool:
    """Whether an annotation starts here: a note without a second one on the line is a mark, unless only a music's name follows."""
    ch = line[at]
    return ch in OPENERS and (ch not in NOTES or ch in line[at + 1 :] or _MUSIC.fullmatch(line, at + 1) is not None)


def parse_line(line: str) -> str:
    """One line of a caption or transcript without cue times, speaker tags and sound annotations.

    A machine with the states *tag* (at the line's start), *text* and *annotation*: a tag leads back to
    *tag*, an opener to *annotation*, its closer, or the line's end, back to *text*. A lone note opens nothing
    and is left out as a mark.
    """
    if _CUE.fullmatch(line.strip()) or line.strip().isdigit() and len(line.strip()) < 6 or line.startswith(_HEADS):
        return ""
    out: list[str] = []
    at, state, closer, depth, opener, words = 0, "tag", "", 0, "", False
    while at < len(line):
        ch = line[at]
        if state == "tag":
            if ch.isspace() or ch in NOTES and not _opens(line, at):
                at += 1
            elif m := _TAG.match(line, at):
                at = m.end()
            elif _opens(line, at):
                opener, closer, depth, state = ch, OPENERS[ch], 1, "annotation"
                at += 1
            else:
                state = "text"
        elif state == "text":
            if _opens(line, at):
                opener, closer, depth, state = ch, OPENERS[ch], 1, "annotation"
                out.append(" ")
            elif ch in NOTES:
                out.append(" ")
            else:
                out.append(ch)
                words = words or not ch.isspace()
            at += 1
        else:
            if ch == closer:
                depth -= 1
            elif ch == opener:
                depth += 1
            at += 1
            if not depth:
                state = "text" if words else "tag"
    return "".join(out)


def clean_text(text: str | None) -> str:
    """The words of a text without annotations, marks, standalone fillers and broken-off repeats; "" if none remain."""
    if not text:
        return ""
    words = " ".join(parse_line(line) for line in text.splitlines()).split()
    kept: list[str] = []
    for word in words:
        core = re.sub(r"^[^\w]+|[^\w]+$", "", word)
        if not core or FILLER.fullmatch(core.lower()):
            continue
        if word[-1] in "-–—" and kept and kept[-1].lower().startswith(core.lower()):
            continue
        if kept and kept[-1][-1] in "-–—" and core.lower().startswith(kept[-1].rstrip("-–—").lower()):
            kept.pop()
        kept.append(word)
    return " ".join(kept)


@F.pandas_udf(StringType())
def cleaned(text: pd.Series) -> pd.Series:
    """``clean_text`` of a column, as Arrow batches; equal texts of a batch are parsed once."""
    known: dict[str | None, str] = {}
    return text.map(lambda t: known[t] if t in known else known.setdefault(t, clean_text(t)))


def speaker_turns(
    records: DataFrame, labels: DataFrame, entity: list[str], time: str, record_id: str, text: str, label_id: str, label: str, tolerance: int, max_gap: int, end: str | None = None
) -> DataFrame:
    """Turns: longest sequences of one speaker's records with content, no start more than ``max_gap`` after the one before.

    Each record gets the ``label`` nearest in time (see ``nearest_in_time``); records without one, and those
    whose text is null, blank or nothing but fillers, annotations and marks, are left out. Times are whole
    numbers in one unit. Result: the entity, ``speaker``, ``first_id``, ``last_id``, ``records``, ``start``,
    ``end``, ``text``. Ties are ordered by id, repeated records are records like others, empty tables give
    an empty result, other columns are ignored. Texts are parsed whole, whatever their length.
    """
    spoken = records.withColumn("__text", cleaned(F.col(text))).where(F.col("__text") != "")
    ended = spoken.withColumn("__end", F.col(end) if end else F.col(time)).withColumn("__time", F.col(time))
    matched = nearest_in_time(
        ended.withColumns({f"__own{i}": F.col(c) for i, c in enumerate(entity)}), labels.withColumn("__label", F.col(label)), entity, time, record_id, label_id, tolerance,
        left=[*(f"__own{i}" for i in range(len(entity))), "__time", "__end", "__text"], right=["__label"],
    )
    own = [f"__own{i}" for i in range(len(entity))]
    runs = collapse_runs(matched, own, "__time", record_id, "__label", max_gap, end="__end", text="__text", chunk=3_600_000_000)
    return runs.select(*[F.col(o).alias(c) for o, c in zip(own, entity)], F.col("__label").alias("speaker"), "first_id", "last_id", F.col("events").alias("records"), "start", "end", "text")


def content(text: Column) -> Column:
    """True where a text is more than fillers, annotations and marks."""
    return cleaned(text) != ""
