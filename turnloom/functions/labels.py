"""Speaker labels: cleaning, letters, prefixes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label kinds, and the letters an unnamed voice can get.
KINDS = ("registered", "stored", "auto")
LETTERS = "ABCDEFGHIJKLMNOPQRST"

#: White space of any width, zero-width characters and byte-order marks.
_BLANKS = r"[\s   -‏    ⁠　﻿]+"
_DEVICE = r"^(?:(?:dev(?:ice)?|mic|ch(?:annel)?) ?[_-]? ?\d+ ?[:/] ?)+"
_PARTS = r"^(registered|stored|auto) ?[:/] ?(.+)$"


def clean_label(label: Column) -> Column:
    """``registered:<name>``, ``stored:<name>`` or ``auto:<A..T>`` from any spelling, else null.

    Blanks of any kind, letter case, a full-width colon or a slash for the colon, blanks around it, words
    of a name joined by blanks or hyphens, and prefixes naming the device make no difference. Null, blank,
    "unknown" and everything that has no known kind give null: they name no speaker.
    """
    plain = F.translate(F.regexp_replace(label, _BLANKS, " "), "：／–‑", ":/--")
    bare = F.regexp_replace(F.trim(F.lower(plain)), _DEVICE, "")
    kind = F.regexp_extract(bare, _PARTS, 1)
    name = F.regexp_replace(F.regexp_extract(bare, _PARTS, 2), r"[ _-]+", "_")
    letter = F.upper(name)
    return (
        F.when((kind == "auto") & letter.rlike("^[A-T]$"), F.concat(F.lit("auto:"), letter))
        .when(kind.isin("registered", "stored") & ~name.isin("", "_", "unknown"), F.concat(kind, F.lit(":"), name))
    )


def label_kind(label: Column) -> Column:
    """The part before the first colon."""
    return F.split_part(label, F.lit(":"), F.lit(1))


def display_name(label: Column) -> Column:
    """The part after the first colon; a label without one stays as it is."""
    return F.regexp_replace(label, "^[^:]*:", "")


def index_to_label(idx: Column) -> Column:
    """``auto:<letter>`` of an index 0..19; outside of it an error."""
    return F.when(idx.between(0, len(LETTERS) - 1), F.concat(F.lit("auto:"), F.char(idx.cast("int") + 65))).otherwise(
        F.raise_error(F.concat(F.lit("no letter for index "), idx.cast("string")))
    )


def label_to_index(label: Column) -> Column:
    """The index of ``auto:<letter>``; null for anything else."""
    return F.when(label.rlike("^auto:[A-T]$"), F.ascii(F.substr(label, F.lit(6), F.lit(1))) - 65)


def wrapped_letter(idx: Column) -> Column:
    """A letter A..Z that starts again after Z."""
    return F.char(F.pmod(idx.cast("int"), F.lit(26)) + 65)


def with_device(device: Column, label: Column) -> Column:
    """``dev<i>:<label>``."""
    return F.concat(F.lit("dev"), device.cast("string"), F.lit(":"), label)
