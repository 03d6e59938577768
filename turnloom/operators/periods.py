"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def periods_and_gaps(
    df: DataFrame, entity: list[str], start: str, end: str, max_gap: int | None = None, chunk: int = 3_600_000
) -> DataFrame:
    """Continuous periods of each entity and the gaps between neighbouring ones.

    ``start`` and ``end`` are whole numbers in one unit, ``[start, end)``. Intervals that overlap, nest or
    touch are joined. Result: ``entity`` columns, ``kind`` (``period`` or ``gap``), ``start``, ``end``; with
    ``max_gap`` only gaps up to that length. Rows with a null or without ``end > start`` are no intervals.
    A null in an entity column is a value of its own. An empty table gives an empty result, equal rows count
    once in effect, and other columns of ``df`` are ignored whatever their names.

    An entity's timeline is worked on in slices of ``chunk`` units, so that an entity with a third of all
    rows spreads over many tasks: within a slice, starts are compared with the running maximum of the ends
    before; the slices' maxima then tell which periods go on from an earlier slice.
    """
    keys = [f"__e{i}" for i in range(len(entity))]
    rows = (
        df.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__t"))
        .where(F.col("__t") > F.col("__s"))
        .withColumn("__c", F.floor(F.col("__s") / chunk))
    )
    slice_ = Window.partitionBy(*keys, "__c").orderBy("__s", "__t")
    before = slice_.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("__s") > F.max("__t").over(before)).cast("int"), F.lit(1))
    islands = cut(
        rows.withColumn("__open", opens)
        .withColumn("__i", F.sum("__open").over(slice_.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__c", "__i")
        .agg(F.min("__s").alias("__s"), F.max("__t").alias("__t"))
    )
    # What reaches into a slice from the slices before: one row per entity and slice.
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        islands.groupBy(*keys, "__c")
        .agg(F.max("__t").alias("__m"))
        .select(*[F.col(k).alias(f"{k}r") for k in [*keys, "__c"]], F.max("__m").over(earlier).alias("__reach"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in [*keys, "__c"]]
    goes_on = F.coalesce(F.col("__s") <= F.col("__reach"), F.lit(False))
    joined = islands.join(reach, same).select(*keys, "__c", "__i", "__s", "__t", goes_on.alias("__on"))
    # Of each slice, what goes on from before becomes one row; those and the last can go on further, all others are whole.
    last = F.col("__i") == F.max("__i").over(Window.partitionBy(*keys, "__c"))
    edge = F.col("__on") | last
    merged = (
        joined.withColumn("__edge", edge)
        .groupBy(*keys, "__c", F.when(F.col("__on"), -1).otherwise(F.col("__i")).alias("__i"))
        .agg(F.min("__s").alias("__s"), F.max("__t").alias("__t"), F.first("__on").alias("__on"), F.first("__edge").alias("__edge"))
        .withColumn("__part", F.when(~F.col("__edge"), F.col("__c")))
    )
    whole = Window.partitionBy(*keys, "__part").orderBy("__c", "__i").rowsBetween(Window.unboundedPreceding, 0)
    periods = (
        merged.withColumn("__p", F.sum((~F.col("__on")).cast("int")).over(whole))
        .groupBy(*keys, "__part", "__p")
        .agg(F.min("__s").alias("__s"), F.max("__t").alias("__t"))
        .select(*keys, "__s", "__t")
    )
    # One row for a period, and its end and start as events: a gap lies between an end and the start that follows.
    event = F.explode(F.array(F.struct(F.col("__t").alias("at"), F.lit(0).alias("what")), F.struct(F.col("__s").alias("at"), F.lit(1).alias("what"))))
    events = periods.withColumn("__x", event).select(*keys, "__s", "__t", "__x.at", "__x.what").withColumn("__c", F.floor(F.col("at") / chunk))
    if max_gap is not None and max_gap <= chunk:
        # A start near the beginning of its slice is also seen from the slice before.
        near = F.when((F.col("what") == 1) & (F.col("at") - F.col("__c") * chunk <= max_gap), F.array("__c", F.col("__c") - 1)).otherwise(F.array("__c"))
        events = events.withColumn("__c", F.explode(near))
        line = Window.partitionBy(*keys, "__c").orderBy("at", "what")
    else:
        line = Window.partitionBy(*keys).orderBy("at", "what")
    following = F.lead(F.when(F.col("what") == 1, F.col("at"))).over(line)
    seen = events.withColumn("__next", following).withColumn("__home", F.floor(F.col("__s") / chunk))
    gap = (F.col("what") == 0) & F.col("__next").isNotNull() & (F.lit(True) if max_gap is None else F.col("__next") - F.col("at") <= max_gap)
    found = F.filter(
        F.array(
            F.when((F.col("what") == 1) & (F.col("__c") == F.col("__home")), F.struct(F.lit("period").alias("kind"), F.col("__s").alias("start"), F.col("__t").alias("end"))),
            F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("at").alias("start"), F.col("__next").alias("end"))),
        ),
        lambda x: x.isNotNull(),
    )
    return seen.select(*keys, F.explode(found).alias("__x")).select(*[F.col(k).alias(c) for k, c in zip(keys, entity)], "__x.kind", "__x.start", "__x.end")
