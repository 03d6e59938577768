"""RTTM annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "uri string, t_start double, t_end double, speaker string"


def parse_rttm(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """``uri``, ``t_start``, ``t_end``, ``speaker`` of text rows (``value``).

    Strict: SPEAKER lines of at least nine fields. ``lenient``: any line of at least eight fields that is no
    comment. Lines whose times are no numbers are left out.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.trim("value").alias("v"), parts.alias("p"))
    kept = rows.where(~F.col("v").startswith(";") & (F.size("p") >= 8)) if lenient else rows.where(F.col("v").startswith("SPEAKER") & (F.size("p") >= 9))
    start, length = F.expr("try_cast(p[3] as double)"), F.expr("try_cast(p[4] as double)")
    return kept.select(F.col("p")[1].alias("uri"), start.alias("t_start"), (start + length).alias("t_end"), F.col("p")[7].alias("speaker")).where("t_start is not null and t_end is not null")


def read_rttm(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Turns of RTTM files; strict ones in the order of their start."""
    turns = parse_rttm(spark.read.text(path), lenient)
    return turns if lenient else turns.orderBy("t_start", "uri", "speaker")


def rttm_lines(turns: DataFrame) -> DataFrame:
    """One text row (``value``) for each turn longer than zero."""
    length = F.col("t_end") - F.col("t_start")
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "uri", "t_start", length, "speaker")
    return turns.where(length > 0).select(line.alias("value"))


def write_rttm(turns: DataFrame, path: str) -> None:
    rttm_lines(turns).write.mode("overwrite").text(path)
