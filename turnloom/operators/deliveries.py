"""Repeated deliveries of one record: only the first counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Of the rows with equal ``keys`` the one with the smallest ``order``: columns ``order`` and ``values``.

    Partial aggregation runs before the shuffle, so repeats within one partition never move. A row with a
    null in a key, or a null ``order``, repeats nothing and stays; of rows equal in keys and order, any one
    stays. Only ``keys``, ``order`` and ``values`` are read.
    """
    single = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.col(order).isNull().cast("int")) > 0
    lone = F.when(single, F.monotonically_increasing_id())
    rows = df.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        lone.alias("__lone"),
        F.col(order).alias("__o"),
        F.struct(F.col(order).alias(order), *[v.alias(n) for n, v in values.items()]).alias("__v"),
    )
    grouped = rows.groupBy(*[f"__k{i}" for i in range(len(keys))], "__lone")
    return grouped.agg(F.min_by("__v", F.coalesce("__o", F.lit(0))).alias("__v")).select("__v.*")
