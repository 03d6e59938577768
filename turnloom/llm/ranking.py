"""Ranks within groups that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_rank(df: DataFrame, group: list[str], order: list[Column], id_: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``rank`` (from 0) within ``group``: by bucket of a hash of ``id_``, then by ``order``.

    Buckets are counted first; each bucket's rows are then ranked by themselves and shifted by what the
    buckets before hold, so no task sorts more than a bucket. ``df`` is read twice: it should be cut.
    """
    placed = df.withColumn("__b", F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)] + [F.col("__b") == F.col("__bb")]
    own = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(*order)) - 1
    ranked = placed.withColumn("__r", own).join(shifts, same)
    return ranked.select(*df.columns, (F.col("__r") + F.col("__shift")).alias("rank"))
