"""Reports over result rows: best rows, averages by dimension, deltas, sensitivities, percentiles, resume sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_rows(df: DataFrame, metric: str, by: list[str], ties: list[str], keep: list[str]) -> DataFrame:
    """The row of the smallest ``metric`` in each group of ``by`` (all rows, if empty); ties by ``ties``; NaN and null never win."""
    sound = df.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    best = sound.groupBy(*by).agg(F.min(F.struct(metric, *ties, *[k for k in keep if k not in ties])).alias("b"))
    return best.select(*by, f"b.{metric}", *[f"b.{t}" for t in dict.fromkeys([*ties, *keep])])


def dense_averages(df: DataFrame, rows: str, columns: str, metric: str, digits: int = 4) -> DataFrame:
    """Average ``metric`` of every combination of the values of two dimensions; 0.0 where there is none."""
    grid = df.select(rows).distinct().crossJoin(df.select(columns).distinct())  # values of two dimensions
    averages = df.groupBy(rows, columns).agg(F.avg(metric).alias("__a"))
    return grid.join(averages, [rows, columns], "left").select(rows, columns, F.round(F.coalesce("__a", F.lit(0.0)), digits).alias("average"))


def delta_to_baseline(df: DataFrame, by: str, variant: str, metric: str, baseline: str) -> DataFrame:
    """``by``, ``variant``, ``average``, ``delta``: each variant's average minus the baseline's in the same group."""
    averages = df.groupBy(by, variant).agg(F.avg(metric).alias("average"))
    base = averages.where(F.col(variant) == baseline).select(by, F.col("average").alias("__base"))
    return averages.join(base, by, "left").select(by, variant, "average", (F.col("average") - F.col("__base")).alias("delta"))


def sensitivity(df: DataFrame, parameters: list[str], metric: str) -> DataFrame:
    """``parameter``, ``least``, ``most``, ``range`` of the averages of ``metric`` by the parameter's values."""
    long = df.select(metric, F.explode(F.create_map(*[x for p in parameters for x in (F.lit(p), F.col(p).cast("string"))])).alias("parameter", "value"))
    means = long.groupBy("parameter", "value").agg(F.avg(metric).alias("m"))
    return means.groupBy("parameter").agg(F.min("m").alias("least"), F.max("m").alias("most"), (F.max("m") - F.min("m")).alias("range"))


def spread(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """``mean``, population ``std``, and ``worst_z``: the largest deviation in standard deviations (plus 1e-9)."""
    stats = df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    far = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo"))
    return stats.select(*by, "mean", "std", (far / (F.col("std") + 1e-9)).alias("worst_z"))


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of a group, rank rounded half to even; null for an empty group.

    The values of a group are collected: for groups of bounded size, as the latencies of a session.
    """
    ordered = F.array_sort(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.rint((F.size(ordered) - 1) * (p / 100)) + 1).cast("int")))


def outstanding(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of ``grid`` that ``done`` doesn't hold yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def classify(value: Column, good: float, fair: float) -> Column:
    """``pass`` up to ``good``, ``partial`` up to ``fair``, else ``fail``; null stays null."""
    return F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string")).when(value <= good, "pass").when(value <= fair, "partial").otherwise("fail")
