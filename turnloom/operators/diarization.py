"""Diarization error and its parts, by a sweep over elementary intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assignment import assign
from .joins import interval_join
from .periods import periods_and_gaps


def cooccurrence(ref: DataFrame, hyp: DataFrame, uri: str, bucket: int) -> DataFrame:
    """``uri``, ``ref``, ``hyp``, ``together``: how long each pair of labels is active at once.

    ``ref`` and ``hyp`` have ``uri``, ``start``, ``end`` and ``label`` (whole numbers in one unit).
    """
    a = ref.select(uri, F.col("start").alias("__s1"), F.col("end").alias("__e1"), F.col("label").alias("ref"))
    b = hyp.select(uri, F.col("start").alias("__s2"), F.col("end").alias("__e2"), F.col("label").alias("hyp"))
    pairs = interval_join(a, b, [uri], ("__s1", "__e1"), ("__s2", "__e2"), bucket)
    shared = F.least("__e1", "__e2") - F.greatest("__s1", "__s2")
    return pairs.groupBy(uri, "ref", "hyp").agg(F.sum(shared).alias("together"))


def optimal_mapping(together: DataFrame, uri: str) -> DataFrame:
    """``uri``, ``hyp``, ``ref``: the one-to-one mapping of labels with the largest common time; one small matrix a recording."""
    kind = dict(together.dtypes)[uri]

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="ref", columns="hyp", values="together", fill_value=0).sort_index().sort_index(axis=1)
        pairs = [(key[0], table.columns[c], table.index[r]) for r, c in assign(-table.to_numpy(float)) if table.to_numpy()[r, c] > 0]
        return pd.DataFrame(pairs, columns=[uri, "hyp", "ref"])

    return together.groupBy(uri).applyInPandas(solve, f"`{uri}` {kind}, hyp string, ref string")


def error_parts(ref: DataFrame, hyp: DataFrame, uri: str, bucket: int, mapping: DataFrame | None = None, collar: int = 0, skip_overlap: bool = False) -> DataFrame:
    """``uri``, ``total``, ``miss``, ``false_alarm``, ``confusion`` (in the unit of time) and ``der``.

    ``mapping`` (``uri``, ``hyp``, ``ref``) says which hypothesis label is which reference label; without one,
    equal labels are. Within half a ``collar`` of each reference boundary, and with ``skip_overlap`` where
    two reference labels are active, nothing is counted. Intervals of one label that overlap count once.
    Recordings without reference speech have a null ``der``.
    """
    if mapping is not None:
        m = mapping.select(uri, F.col("hyp").alias("__h"), F.col("ref").alias("__r"))
        hyp = hyp.join(m, (hyp[uri] == m[uri]) & (hyp["label"] == m["__h"]), "left").select(hyp[uri], "start", "end", F.coalesce("__r", F.concat(F.lit("other:"), "label")).alias("label"))
    sound = lambda df, side: df.where("end > start and label is not null").select(uri, "start", "end", "label", F.lit(side).alias("side"))
    both = sound(ref, "r").unionByName(sound(hyp, "h"))
    if collar:
        half = collar // 2
        edges = ref.where("end > start and label is not null").select(uri, F.explode(F.array("start", "end")).alias("at"))
        both = both.unionByName(edges.select(uri, (F.col("at") - half).alias("start"), (F.col("at") + half).alias("end"), F.lit("").alias("label"), F.lit("x").alias("side")))
    # Cut every bucket at all boundaries in it; then each interval covers whole elementary intervals.
    pieces = both.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    pieces = pieces.select(uri, "b", "side", "label", F.greatest("start", F.col("b") * bucket).alias("s"), F.least("end", (F.col("b") + 1) * bucket).alias("e"))
    cuts = pieces.select(uri, "b", F.explode(F.array("s", "e")).alias("at")).distinct()
    line = Window.partitionBy(uri, "b").orderBy("at")
    elementary = cuts.withColumn("to", F.lead("at").over(line)).where("to is not null").withColumnsRenamed({uri: "u", "b": "bb"})
    inside = pieces.join(elementary, (pieces[uri] == F.col("u")) & (pieces["b"] == F.col("bb")) & (F.col("s") <= F.col("at")) & (F.col("to") <= F.col("e")))
    labels = inside.groupBy(uri, "b", "at", "to", "side", "label").agg(F.lit(1).alias("one"))
    per_label = labels.groupBy(uri, "b", "at", "to", "label").agg(F.max((F.col("side") == "r").cast("int")).alias("r"), F.max((F.col("side") == "h").cast("int")).alias("h"), F.max((F.col("side") == "x").cast("int")).alias("x"))
    counts = per_label.groupBy(uri, "b", "at", "to").agg(F.sum("r").alias("r"), F.sum("h").alias("h"), F.sum(F.col("r") * F.col("h")).alias("c"), F.max("x").alias("x"))
    counted = counts.where((F.col("x") == 0) & ((F.col("r") < 2) if skip_overlap else F.lit(True))).withColumn("d", F.col("to") - F.col("at"))
    zero = F.lit(0)
    parts = counted.groupBy(uri).agg(
        F.sum(F.col("r") * F.col("d")).alias("total"), F.sum(F.greatest(F.col("r") - F.col("h"), zero) * F.col("d")).alias("miss"),
        F.sum(F.greatest(F.col("h") - F.col("r"), zero) * F.col("d")).alias("false_alarm"), F.sum((F.least("r", "h") - F.col("c")) * F.col("d")).alias("confusion"),
    )
    return parts.withColumn("der", F.when(F.col("total") > 0, (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("total")))


def der(ref: DataFrame, hyp: DataFrame, uri: str, bucket: int, collar: int = 0, skip_overlap: bool = False) -> DataFrame:
    """``error_parts`` under the optimal mapping of labels."""
    # Overlapping intervals of one label are one, or they would weigh twice in the mapping.
    once = lambda df: periods_and_gaps(df, [uri, "label"], "start", "end", 0, max(1, 100 * bucket)).where("kind = 'period'").drop("kind")
    ref, hyp = once(ref), once(hyp)
    mapping = optimal_mapping(cooccurrence(ref, hyp, uri, bucket), uri)
    return error_parts(ref, hyp, uri, bucket, mapping, collar, skip_overlap)


def percentile_nearest(values: np.ndarray, p: float) -> float:
    """Nearest-rank percentile with half-even rounding of the rank."""
    ordered = np.sort(np.asarray(values, float))
    return float(ordered[int(np.rint(p / 100 * (len(ordered) - 1)))])
