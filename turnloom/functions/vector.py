"""Vectors as arrays of double: norms, dot products, cosines and means, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    pairs = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a vector with NaN or without length is an error."""
    n = norm(v)
    bad = F.exists(doubles(v), F.isnan) | (n == 0)
    return F.when(v.isNull(), F.lit(None)).when(bad, F.raise_error(F.lit("a vector with NaN or without length has no direction"))).otherwise(F.transform(doubles(v), lambda x: x / n))


def unit(v: Column) -> Column:
    """Unit vector of a usable one; of a vector without length nulls, and no error, so that it may be computed before unusable rows are left out."""
    # The length is an array's only element, else it would be computed again for every number.
    return F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: F.try_divide(x, n)))[0]


def l2_normalize_lenient(v: Column, least: float = 1e-9) -> Column:
    """Unit vector; one shorter than ``least`` stays as it is."""
    n = norm(v)
    return F.when(n < least, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of any length but zero."""
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """``max(0, 1 - cosine)`` of unit vectors."""
    return F.greatest(1 - dot(a, b), F.lit(0.0))


def argmax(v: Column) -> Column:
    """Index (from 0) of the first largest element."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1


# Which of three speakers each of seven powerset classes means.
POWERSET = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))


def powerset_to_speakers(scores: Column) -> Column:
    """Three 0/1 activities of the most likely of seven powerset classes."""
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in POWERSET])
    return F.element_at(table, argmax(scores) + 1)


def overlap_penalty(seg: Column, gamma: float = 3.0, beta: float = 10.0, floor: float = 1e-8) -> Column:
    """Activities weighted down where several speak: ``(s * softmax(beta s)) ** gamma`` of each, at least ``floor``."""
    top = F.array_max(seg)
    total = F.aggregate(doubles(seg), F.lit(0.0), lambda acc, x: acc + F.exp(beta * (x - top)))
    return F.transform(doubles(seg), lambda x: F.greatest(F.pow(x, F.lit(gamma)) * F.pow(F.exp(beta * (x - top)) / total, F.lit(gamma)), F.lit(floor)))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """``keys``, ``n`` and ``mean``: the (weighted) mean of a group's vectors, summed up by position.

    Sums by (group, position) combine before the shuffle, so a group of any size is a few numbers a task.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    long = df.select(*keys, w.alias("__w"), F.posexplode(doubles(F.col(vector))).alias("__p", "__x"))
    sums = long.groupBy(*keys, "__p").agg((F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("__m"), F.count("*").alias("__n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda s: s["__m"])
    return sums.groupBy(*keys).agg(F.max("__n").alias("n"), ordered.alias("mean"))


def centroids(df: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """Unit mean vectors of groups: ``keys``, ``n``, ``centroid``."""
    return mean_vectors(df, keys, vector, weight).select(*keys, "n", l2_normalize_lenient(F.col("mean")).alias("centroid"))
