"""Functions for SQL: plain SQL functions, which Catalyst inlines, and a table function for annotation lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Names, parameters, results and bodies.
SQL_FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "l2_normalize": ("v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y)))"),
    "cosine_sim": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))",
    ),
    "overlap_s": ("s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE", "DOUBLE", "greatest(0D, least(e1, e2) - greatest(s1, s2))"),
    "idx_to_label": ("i INT", "STRING", "CASE WHEN i BETWEEN 0 AND 19 THEN concat('auto:', char(65 + i)) END"),
}


@udtf(returnType="uri string, t_start double, t_end double, speaker string")
class RttmTurns:
    """``SELECT * FROM rttm_turns('SPEAKER a 1 0.5 1.0 <NA> <NA> S1 <NA> <NA>')``: the turn of a line, or nothing."""

    def eval(self, line: str) -> Iterator[tuple[str, float, float, str]]:
        parts = (line or "").split()
        if len(parts) >= 9 and parts[0] == "SPEAKER":
            try:
                start, length = float(parts[3]), float(parts[4])
            except ValueError:
                return
            yield parts[1], start, start + length, parts[7]


def register(spark: SparkSession) -> None:
    """Make the functions known to this session's SQL."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("rttm_turns", RttmTurns)
