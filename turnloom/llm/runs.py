"""Repeated consecutive events: each run becomes one event with its count and duration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slabs import group_starts

_RUN = ["first_id", "last_id", "events", "start", "last_start", "end"]


def _machine(keys: list[str], same: str, max_gap: int, text: str | None):
    """The state machine over rows sorted by keys, slice, time and id; its state is the open run."""

    def step(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], pa.Table, np.ndarray]:
        rows = pa.Table.from_batches([batch])
        opens_slice = group_starts(rows, [*keys, "__c"])
        t = rows.column("__t").to_numpy()
        new = opens_slice | group_starts(rows, [same])
        new[1:] |= np.diff(t) > max_gap
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(t)) - 1
        ids, ends = rows.column("__id").to_numpy(), rows.column("__u").to_numpy()
        runs = {
            "first_id": ids[at], "last_id": ids[last], "events": last - at + 1, "start": t[at], "last_start": t[last],
            "end": np.maximum.reduceat(ends, at), "first": opens_slice[at],
        }
        if text:
            words = rows.column(text).to_pylist()
            runs["text"] = np.array([" ".join(w for w in words[a : b + 1] if w) for a, b in zip(at, last)], object)
        return runs, rows.select([*keys, "__c", same]).take(pa.array(at)), at

    def machine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: dict | None = None
        open_key: pa.Table | None = None

        def out(runs: dict[str, np.ndarray], key: pa.Table, last: np.ndarray) -> pa.RecordBatch:
            table = key
            for name in _RUN:
                table = table.append_column(name, pa.array(runs[name].astype(np.int64)))
            table = table.append_column("first", pa.array(runs["first"].astype(bool))).append_column("last", pa.array(last))
            if text:
                table = table.append_column("text", pa.array(list(runs["text"]), pa.string()))
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            runs, key, _ = step(batch)
            if open_run is not None:
                pair = pa.concat_tables([open_key, key.slice(0, 1)])
                other_slice = bool(group_starts(pair, [*keys, "__c"])[1])
                goes_on = not other_slice and not group_starts(pair, [same])[1] and runs["start"][0] - open_run["last_start"][0] <= max_gap
                if not other_slice:
                    runs["first"][0] = False
                if goes_on:
                    for name in ("first_id", "start", "first"):
                        runs[name][0] = open_run[name][0]
                    runs["events"][0] += open_run["events"][0]
                    runs["end"][0] = max(runs["end"][0], open_run["end"][0])
                    if text:
                        runs["text"][0] = " ".join(x for x in (open_run["text"][0], runs["text"][0]) if x)
                else:
                    yield out(open_run, open_key, np.array([other_slice]))
            if len(key) > 1:
                yield out({k: v[:-1] for k, v in runs.items()}, key.slice(0, len(key) - 1), runs["first"][1:].astype(bool))
            open_run, open_key = {k: v[-1:] for k, v in runs.items()}, key.slice(len(key) - 1)
        if open_run is not None:
            yield out(open_run, open_key, np.array([True]))

    return machine


def edit_similarity(a: str, b: str) -> float:
    """1 less the share of characters to change, add or take away (Levenshtein) in the longer text."""
    if a == b:
        return 1.0
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            diagonal, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, diagonal + (x != y))
    return 1 - line[-1] / max(len(a), len(b), 1)


def cosine_similarity(a: list[float], b: list[float]) -> float:
    x, y = np.asarray(a, float), np.asarray(b, float)
    return float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300)) if len(x) == len(y) else -1.0


def _near_anchor(entity: list[str], same: str, max_gap: int, similarity: Callable[[object, object], float], least: float):
    """A second state machine, over runs of equal events sorted by entity and time: each is compared with the anchor of the open run."""

    def machine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: dict | None = None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                goes_on = run is not None and all(row[k] == run[k] for k in entity) and row["start"] - run["last_start"] <= max_gap
                if goes_on and (row[same] == run[same] or similarity(run[same], row[same]) >= least):
                    run |= {"last_id": row["last_id"], "last_start": row["last_start"], "events": run["events"] + row["events"], "end": max(run["end"], row["end"])}
                    if "text" in run:
                        run["text"] = " ".join(x for x in (run["text"], row["text"]) if x)
                    continue
                if run is not None:
                    out.append(run)
                run = row
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
            last = batch.schema
        if run is not None:
            yield pa.RecordBatch.from_pylist([run], schema=last)

    return machine


def collapse_runs(
    df: DataFrame, entity: list[str], time: str, id_: str, same: str, max_gap: int, end: str | None = None, text: str | None = None, chunk: int = 3_600_000,
    similarity: Callable[[object, object], float] | None = None, least: float = 1.0,
) -> DataFrame:
    """Runs of consecutive events of one entity whose ``same`` value agrees with the run's anchor, its first event.

    Events are ordered by ``time``, then ``id_`` (whole numbers). A run ends where ``same`` differs from its
    anchor or where a time is more than ``max_gap`` after the one before. With ``similarity``
    (``edit_similarity`` of texts, ``cosine_similarity`` of vectors, or any function of two values) an event
    goes on with the run if its similarity to the anchor reaches ``least``; ``same`` is then the anchor's value. Result: the entity, ``same``, ``first_id``, ``last_id``,
    ``events``, ``start``, ``last_start``, ``end`` (largest ``end``, or time where that is null or not
    given), with ``text`` the run's non-blank texts in order. Rows with a null time, id or ``same`` are no
    events; repeated rows are events like others; an empty table gives an empty result; columns not named
    here are ignored.

    The state machine runs over each entity's time slices of ``chunk`` units, so a hot entity is many tasks.
    Only the first and last run of a slice can go on across its border: those, at most two a slice, are
    joined in a second pass. With ``similarity`` what a run takes depends on its anchor, however far back:
    the runs of equal events that are left of an entity then pass through one task as a sorted stream, of
    which only the open run is held.
    """
    keys = [f"__e{i}" for i in range(len(entity))]
    t = F.col(time).cast("long")
    rows = df.where(F.col(time).isNotNull() & F.col(id_).isNotNull() & F.col(same).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)],
        F.floor(t / chunk).alias("__c"),
        t.alias("__t"),
        F.col(id_).cast("long").alias("__id"),
        F.coalesce(F.col(end).cast("long"), t).alias("__u") if end else t.alias("__u"),
        F.col(same).alias("__same"),
        *([F.col(text).alias("__text")] if text else []),
    )
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "__c", "__same"]) + "".join(f", `{c}` bigint" for c in _RUN) + ", first boolean, last boolean" + (", text string" if text else "")
    placed = rows.repartition(*keys, "__c").sortWithinPartitions(*keys, "__c", "__t", "__id")
    runs = placed.mapInArrow(_machine(keys, "__same", max_gap, "__text" if text else None), schema)
    edge = F.col("first") | F.col("last")
    line = Window.partitionBy(*keys, F.when(~edge, F.col("__c"))).orderBy("start", "first_id")
    # In the partition of the edges, a run that opens a slice follows the one that closed the slice before.
    joins = F.col("first") & (F.lag("__same").over(line) == F.col("__same")) & (F.col("start") - F.lag("last_start").over(line) <= max_gap)
    whole = runs.withColumn("__joins", F.coalesce(joins, F.lit(False))).withColumn("__part", F.when(~edge, F.col("__c")))
    numbered = whole.withColumn(
        "__run", F.sum((~F.col("__joins")).cast("long")).over(Window.partitionBy(*keys, "__part").orderBy("start", "first_id").rowsBetween(Window.unboundedPreceding, 0))
    )
    first = F.struct("start", "first_id")
    final = F.struct("last_start", "last_id")
    runs = (
        numbered.groupBy(*keys, "__part", "__run")
        .agg(
            F.first("__same").alias(same),
            F.min(first).alias("__a"),
            F.max(final).alias("__z"),
            F.sum("events").alias("events"),
            F.max("end").alias("end"),
            *([F.array_sort(F.collect_list(F.struct("start", "first_id", "text"))).alias("__texts")] if text else []),
        )
        .select(
            *[F.col(k).alias(c) for k, c in zip(keys, entity)], same, "__a.first_id", "__z.last_id", "events", "__a.start", "__z.last_start", "end",
            *([F.concat_ws(" ", F.filter(F.col("__texts.text"), lambda x: x != "")).alias("text")] if text else []),
        )
    )
    if similarity is None:
        return runs
    fields = ", ".join(f"`{c}` {t}" for c, t in runs.dtypes)
    sorted_runs = runs.repartition(*entity).sortWithinPartitions(*entity, "start", "first_id")
    return sorted_runs.mapInArrow(_near_anchor(entity, same, max_gap, similarity, least), fields)
