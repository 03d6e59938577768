"""Operators over ordered rows of a session: islands, merging, splitting, counting states."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """``df`` with the number (from 1) of the island a row is in; ``starts`` is true where a new one starts."""
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__new", F.coalesce(starts.cast("int"), F.lit(1))).withColumn(name, F.sum("__new").over(line)).drop("__new")


def _beside(rows: DataFrame, found: DataFrame, slices: list[str], value: str) -> DataFrame:
    """``rows`` with what ``found`` has for their slice in ``value``."""
    named = found.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(slices)], value)
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(slices)]).drop(*[f"__k{i}" for i in range(len(slices))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, chunk: int) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over a key's rows up to this one, in slices of ``chunk`` units of the first column of ``order``.

    A slice is a task of its own; only its total passes to the slices after it.
    """
    slices = [*keys, "__c"]
    placed = df.withColumn("__c", F.floor(F.col(order[0]) / chunk)).withColumn("__v", value)
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*slices).agg(F.sum("__v").alias("__n")).withColumn("__shift", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    line = Window.partitionBy(*slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _beside(placed, totals, slices, "__shift").withColumn(name, F.sum("__v").over(line) + F.col("__shift")).drop("__c", "__v", "__shift")


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str, chunk: int) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of a row among those of its key, worked in slices as in ``running_sum``."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, chunk)


def sliced_islands(df: DataFrame, keys: list[str], order: list[str], uses: list[str], starts: Callable[[Callable[[str], Column]], Column], chunk: int, name: str = "island") -> DataFrame:
    """``islands`` of a key with any number of rows: slices of ``chunk`` units of the first column of ``order`` are tasks of their own.

    ``starts`` is given a function from a column in ``uses`` to its value in the row before, which for the
    first row of a slice is the last one of the slice before it; a key's first row always starts an island.
    Only one row a slice passes between slices: its last row, and how many islands start in it.
    """
    slices = [*keys, "__c"]
    placed = df.withColumn("__c", F.floor(F.col(order[0]) / chunk)).withColumn("__here", F.struct(*uses))
    line, earlier = Window.partitionBy(*slices).orderBy(*order), Window.partitionBy(*keys).orderBy("__c")

    tails = placed.groupBy(*slices).agg(F.max_by("__here", F.struct(*order)).alias("__tail")).withColumn("__prev", F.lag("__tail").over(earlier))
    seen = _beside(placed, tails, slices, "__prev").withColumn("__before", F.coalesce(F.lag("__here").over(line), "__prev"))
    new = F.when(F.col("__before").isNull(), 1).otherwise(F.coalesce(starts(lambda c: F.col(f"__before.{c}")).cast("int"), F.lit(1)))
    marked = seen.withColumn("__new", new)
    counts = marked.groupBy(*slices).agg(F.sum("__new").alias("__n")).withColumn("__shift", F.coalesce(F.sum("__n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = _beside(marked, counts, slices, "__shift")
    island = F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__shift")
    return whole.withColumn(name, island).drop("__c", "__here", "__prev", "__before", "__new", "__shift")


def active_runs(frames: DataFrame, keys: list[str], frame: str, max_gap: int = 10, chunk: int = 10_000) -> DataFrame:
    """Runs of active frames: ``keys``, ``first_frame``, ``last_frame``, ``frames``; a step of more than ``max_gap`` starts a new one."""
    return sliced_islands(frames, keys, [frame], [frame], lambda before: F.col(frame) - before(frame) > max_gap, chunk).groupBy(*keys, "island").agg(
        F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("frames")
    ).drop("island")


def merge_consecutive(df: DataFrame, keys: list[str], order: list[str], label: str, start: str, end: str, text: str, chunk: int) -> DataFrame:
    """Consecutive rows with one label as one: ``keys``, ``label``, ``start``, ``end`` (the largest), ``text`` joined by blanks, ``parts``.

    ``chunk`` is the length of a slice in units of the first column of ``order``.
    """
    numbered = sliced_islands(df, keys, order, [label], lambda before: ~F.col(label).eqNullSafe(before(label)), chunk)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return numbered.groupBy(*keys, "island").agg(
        F.min(label).alias(label), F.min(start).alias(start), F.max(end).alias(end), F.array_join(F.transform(ordered, lambda s: s["__t"]), " ").alias(text), F.count("*").alias("parts")
    ).drop("island")


def split_phrases(words: DataFrame, keys: list[str], order: list[str], start: str, end: str, text: str, max_gap: int) -> DataFrame:
    """``words`` with ``part`` and ``reason``: a part ends after a word that ends a sentence, else before a gap of more than ``max_gap``.

    ``reason`` is what ends the part: ``sentence``, ``silence``, or ``none`` at the end of the phrase.
    """
    line = Window.partitionBy(*keys).orderBy(*order)
    following = F.lead(start).over(line)
    sentence = F.rtrim(F.col(text)).rlike("[.?!…]$")
    silence = F.coalesce(following - F.col(end) > max_gap, F.lit(False))
    marked = words.withColumn("__why", F.when(following.isNull(), "none").when(sentence, "sentence").when(silence, "silence"))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    parted = marked.withColumn("part", F.coalesce(F.count("__why").over(before), F.lit(0)))
    own = Window.partitionBy(*keys, "part")
    return parted.withColumn("reason", F.max("__why").over(own)).drop("__why")


def last_write_runs(segments: DataFrame, keys: list[str], seq: str, start: str, end: str, label: str, step: int, chunk: int = 10_000) -> DataFrame:
    """What a reader of frames sees: each frame has the label written last; runs of equal labels of consecutive frames.

    ``step`` is a frame's length in the unit of the times. Result: ``keys``, ``label``, ``first_frame``, ``end_frame``.
    """
    span = F.sequence(F.floor(F.col(start) / step), F.floor(F.col(end) / step))
    frames = segments.where(F.col(end) >= F.col(start)).select(*keys, F.explode(span).alias("frame"), seq, label)
    winner = frames.groupBy(*keys, "frame").agg(F.max_by(label, seq).alias(label))
    parts = sliced_islands(winner, keys, ["frame"], ["frame", label], lambda before: ~(F.col(label).eqNullSafe(before(label)) & (F.col("frame") - before("frame") == 1)), chunk)
    return parts.groupBy(*keys, "island").agg(
        F.min(label).alias(label), F.min("frame").alias("first_frame"), (F.max("frame") + 1).alias("end_frame")
    ).drop("island")


def merged_order(events: DataFrame, stream: str, seq: str, time: str) -> DataFrame:
    """``events`` with ``position``: the order in which a merge with one event of look-ahead for each stream emits them.

    An event can't come before those its stream holds in front of it, so its key is the largest time up to
    it (a null time holds back what follows); ties go to the stream, then its order. Positions are counted
    by hour first, so no single task ranks all events.
    """
    line = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    keyed = events.withColumn("__key", F.max(F.coalesce(F.col(time).cast("double"), F.lit(float("inf")))).over(line))
    keyed = keyed.withColumn("__slot", F.when(F.col("__key") == float("inf"), F.lit(1 << 60)).otherwise(F.floor(F.col("__key") / 3600).cast("long")))
    sizes = keyed.groupBy("__slot").agg(F.count("*").alias("__n"))
    shift = sizes.select("__slot", F.coalesce(F.sum("__n").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slot").orderBy("__key", stream, seq))
    return keyed.withColumn("__own", own).join(shift, "__slot").withColumn("position", (F.col("__own") + F.col("__before")).cast("long")).drop("__key", "__slot", "__own", "__before")


def covered_time(df: DataFrame, keys: list[str], start: str, end: str, chunk: int = 600_000) -> DataFrame:
    """``keys``, ``covered`` (time with at least one interval), ``overlapped`` (with two or more), ``most`` at once.

    A sweep over starts and ends: each adds or takes one, and counts hold until the next. Intervals are cut
    at the borders of slices of ``chunk`` units, so each slice is swept by itself and a hot key is many tasks.
    """
    slices = F.sequence(F.floor(F.col(start) / chunk), F.floor((F.col(end) - 1) / chunk))
    cut = df.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.explode(slices).alias("__b"))
    lo, hi = F.greatest(F.col("__s"), F.col("__b") * chunk), F.least(F.col("__e"), (F.col("__b") + 1) * chunk)
    points = cut.select(*keys, "__b", F.explode(F.array(F.struct(lo.alias("at"), F.lit(1).alias("step")), F.struct(hi.alias("at"), F.lit(-1).alias("step")))).alias("x"))
    steps = points.select(*keys, "__b", "x.*").groupBy(*keys, "__b", "at").agg(F.sum("step").alias("step"))
    line = Window.partitionBy(*keys, "__b").orderBy("at")
    swept = steps.withColumn("n", F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("long", F.lead("at").over(line) - F.col("at"))
    return swept.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("n") >= 1, F.col("long"))), F.lit(0)).cast("long").alias("covered"),
        F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("long"))), F.lit(0)).cast("long").alias("overlapped"),
        F.max("n").cast("long").alias("most"),
    )


def phrase_numbers(rows: DataFrame, keys: list[str], order: list[str], final: str, chunk: int = 1_000) -> DataFrame:
    """Final rows with ``phrase``: how many partial rows of their key came before (see ``running_sum``)."""
    return running_sum(rows, keys, order, F.when(F.col(final), 0).otherwise(1), "phrase", chunk).where(F.col(final))


def phrase_parts(words: DataFrame, phrase: list[str], order: list[str], start: str, end: str, text: str, max_gap: int) -> DataFrame:
    """``words`` with ``part`` (from 0) and ``reason`` of their ``phrase`` (the columns that name it).

    A part ends after a word that ends a sentence, else before a gap of more than ``max_gap`` within the
    phrase. ``reason`` tells of the whole phrase what ended its parts: ``sentence``, ``silence``, ``both`` or ``none``.
    """
    line, whole = Window.partitionBy(*phrase).orderBy(*order), Window.partitionBy(*phrase)
    sentence = F.coalesce(F.rtrim(F.col(text)).rlike("[.?!…]$"), F.lit(False))
    gap = F.coalesce(F.lead(start).over(line) - F.col(end) > max_gap, F.lit(False))
    marked = words.withColumn("__sentence", sentence).withColumn("__silence", ~F.col("__sentence") & gap)
    ends = (F.col("__sentence") | F.col("__silence")).cast("long")
    by_sentence, by_silence = F.bool_or("__sentence").over(whole), F.bool_or("__silence").over(whole)
    reason = F.when(by_sentence & by_silence, "both").when(by_sentence, "sentence").when(by_silence, "silence").otherwise("none")
    parted = marked.withColumn("part", F.coalesce(F.sum(ends).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parted.withColumn("reason", reason).drop("__sentence", "__silence")


def assembled_phrases(rows: DataFrame, keys: list[str], order: list[str], final: str, start: str, end: str, text: str) -> DataFrame:
    """Final rows up to the next partial one as one phrase: ``keys``, ``phrase``, ``start``, ``end``, ``text``, ``finals``."""
    numbered = phrase_numbers(rows, keys, order, final)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return numbered.groupBy(*keys, "phrase").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.array_join(F.transform(ordered, lambda s: s["__t"]), " ").alias(text), F.count("*").alias("finals")
    )


def first_time_of_labels(df: DataFrame, keys: list[str], order: list[str], label: str, time: str, labels: int = 2) -> DataFrame:
    """``keys``, ``reached``: the ``time`` of the first row by which ``labels`` distinct labels were seen; null if never."""
    first = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.min(F.struct(*order, F.col(time).alias("__t"))).alias("__f"))
    ranked = first.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__f")))
    reached = ranked.where(F.col("__n") == labels).select(*keys, F.col("__f.__t").alias("reached"))
    return df.select(*keys).distinct().join(reached, keys, "left")


def inherited_labels(df: DataFrame, keys: list[str], order: list[str], label: str, seconds: Column, least: float = 0.3, chunk: int = 3_600_000) -> DataFrame:
    """``df`` with ``inherited``: a row shorter than ``least`` takes over the label of the last longer one; the first keeps its own.

    Worked in slices of ``chunk`` units of the first column of ``order``; what a slice holds last passes on.
    """
    slices = [*keys, "__c"]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    placed = _beside(df.withColumn("__c", F.floor(F.col(order[0]) / chunk)), first, keys, "__first")
    own = F.when((seconds >= least) | (F.struct(*order) == F.col("__first")), F.struct(F.col(label).alias("v")))
    marked = placed.withColumn("__own", own)
    line = Window.partitionBy(*slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    held = marked.groupBy(*slices).agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.struct(*order))).alias("__tail"))
    carried = held.withColumn("__carry", F.last_value("__tail", ignoreNulls=True).over(earlier))
    found = F.coalesce(F.last_value("__own", ignoreNulls=True).over(line), "__carry")["v"]
    return _beside(marked, carried, slices, "__carry").withColumn("inherited", found).drop("__c", "__first", "__own", "__carry")


def speech_commits(frames: DataFrame, keys: list[str], frame: str, speech: str, silent_frames: int) -> DataFrame:
    """``keys``, ``commit_frame``: where, after speech, the silence has lasted ``silent_frames`` frames; once for each silence."""
    line = Window.partitionBy(*keys).orderBy(frame)
    numbered = islands(frames, keys, [frame], ~(F.col(speech) == F.lag(speech).over(line)))
    runs = numbered.groupBy(*keys, "island").agg(F.min(frame).alias("__f"), F.count("*").alias("__n"), F.max(speech).alias("__speech"))
    after = F.max(F.col("__speech").cast("int")).over(Window.partitionBy(*keys).orderBy("island").rowsBetween(Window.unboundedPreceding, -1)) == 1
    quiet = runs.withColumn("__after", after).where(~F.col("__speech") & F.col("__after") & (F.col("__n") >= silent_frames))
    return quiet.select(*keys, (F.col("__f") + silent_frames - 1).alias("commit_frame"))


def count_triggers(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """``df`` with ``batch`` (from 0): a new one after each ``every`` rows."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / every))


def adaptive_triggers(df: DataFrame, keys: list[str], order: list[str], time: str, every: int = 10, seconds: float = 30.0) -> DataFrame:
    """``keys``, ``fired``: the times at which, after a row, ``every`` rows have come or ``seconds`` have passed since the last firing.

    Both counts start again at a firing, so the rows of a key are read in order, as a sorted stream of which
    only two numbers are held; event time takes the place of a clock, and the first row starts it.
    """
    types = dict(df.dtypes)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, since = None, 0, 0.0
        for batch in batches:
            out = []
            for *own, at in batch[[*keys, "__t"]].itertuples(index=False, name=None):
                if own != key:
                    key, n, since = own, 0, at
                n += 1
                if n >= every or at - since >= seconds:
                    out.append((*own, at))
                    n, since = 0, at
            yield pd.DataFrame(out, columns=[*keys, "fired"])

    rows = df.select(*keys, F.col(time).cast("double").alias("__t"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))])
    return placed.select(*keys, "__t").mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", fired double")
