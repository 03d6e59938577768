"""Queries of the general training-data operators (problems 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import clean_label
from ..operators.deliveries import first_delivery
from ..operators.periods import periods_and_gaps
from ..operators.schema_drift import drift_changes, unified_rows
from ..session import table

GAP_MS = 600_000


def milliseconds(seconds: F.Column) -> F.Column:
    """Whole milliseconds of seconds; null for a time that is null or no finite number."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 9e12)
    return F.when(finite, F.round(seconds * 1000).cast("long"))


def speaking_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "speaker_segment")
    values = {c: F.col(c) for c in ("label", "t_start", "t_end")}
    first = first_delivery(segments, ["session_id", "utterance_id"], "segment_id", {"session_id": F.col("session_id"), **values})
    return first.select("session_id", clean_label(F.col("label")).alias("label"), milliseconds(F.col("t_start")).alias("s"), milliseconds(F.col("t_end")).alias("t")).where("label is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods_and_gaps(speaking_intervals(spark, sf_dir), ["session_id", "label"], "s", "t", max_gap=GAP_MS)
    return found.select("session_id", "label", "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_changes(table(spark, sf_dir, "ablation_raw")).select("file_name", "field_path", "change_kind")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified_rows(table(spark, sf_dir, "ablation_raw"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_unified": p5_unified}

_CLEAN = r"""
  CASE WHEN kind = 'auto' AND regexp_full_match(upper(nm), '[A-T]') THEN 'auto:' || upper(nm)
       WHEN kind IN ('registered', 'stored') AND nm NOT IN ('', '_', 'unknown') THEN kind || ':' || nm END"""

def clean_sql(source: str, column: str) -> str:
    """A subquery over ``source`` that adds ``clean``, the clean label of ``column``."""
    bare = rf"""SELECT *, regexp_replace(trim(lower(translate(regexp_replace({column}, '[\s\x{{00A0}}\x{{200B}}\x{{FEFF}}]+', ' ', 'g'), '：', ':'))), '^(dev\d+ ?[:/] ?)+', '') AS bare FROM {source}"""
    parts = "^(registered|stored|auto) ?[:/] ?(.+)$"
    named = f"SELECT *, regexp_extract(bare, '{parts}', 1) AS kind, regexp_replace(regexp_extract(bare, '{parts}', 2), '[ _-]+', '_', 'g') AS nm FROM ({bare})"
    return f"(SELECT *, {_CLEAN} AS clean FROM ({named}))"


ORACLE = {
    "p3_found": r"""
WITH d AS (SELECT * FROM (SELECT session_id, label, t_start, t_end, row_number() OVER (PARTITION BY session_id, utterance_id ORDER BY segment_id) AS r FROM speaker_segment) WHERE r = 1),
v AS (SELECT session_id, clean AS label, CAST(round(t_start * 1000) AS BIGINT) AS s, CAST(round(t_end * 1000) AS BIGINT) AS t FROM """
    + clean_sql("d", "label")
    + r""" WHERE clean IS NOT NULL AND t_end > t_start),
f AS (SELECT *, CASE WHEN s > max(t) OVER (PARTITION BY session_id, label ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM v),
g AS (SELECT *, sum(o) OVER (PARTITION BY session_id, label ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS i FROM f),
p AS (SELECT session_id, label, min(s) AS s, max(t) AS t FROM g GROUP BY session_id, label, i),
n AS (SELECT *, lead(s) OVER (PARTITION BY session_id, label ORDER BY s) AS nx FROM p)
SELECT session_id, label, 'period' AS kind, s AS start_ms, t AS end_ms FROM n
UNION ALL SELECT session_id, label, 'gap', t, nx FROM n WHERE nx - t <= 600000""",
}
