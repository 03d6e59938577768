"""Filling containers of fixed capacity with items of varying length: bulk-synchronous best fit.

Sizes and gaps are whole numbers up to the capacity, so items of one size, and containers with one gap, are
interchangeable. Best fit is run over these classes: from the largest size down, the items of a size are
matched with the successor of that size among the gaps, as many as there are, then the next; gaps are updated
and the sweep goes on. What a match says of its items, by their rank within the size, places every row.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranking import spread_rank


#: Matches of a kind are sent to every task, 32 bytes each. They are about two for each size and gap, so a multiple of the capacity.
MOST_MATCHES = 2_000_000


def best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Matches ``(size, first rank, first container, items a container)`` of best fit over size classes, largest first.

    Within a size, ranks from one match's first rank up to the next one's fill containers in turn. This is
    what best fit gives item by item: an item goes to the fullest container it fits in, ties to the one
    opened first, and a container that takes one item of a size goes on taking them while they fit.
    """
    gaps: list[int] = []  # ascending, each once
    holders: dict[int, list[tuple[int, int]]] = {}  # of a gap, runs of containers: first number, count
    matches: list[tuple[int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap <= 0 or not count:
            return
        if gap not in holders:
            bisect.insort(gaps, gap)
            holders[gap] = []
        holders[gap].append((first, count))

    for size in sorted(sizes, reverse=True):
        left, rank = sizes[size], 0
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, count = holders[gap].pop(0)
                each = gap // size
                used = min(count, -(-left // each))
                if used < count:
                    holders[gap].insert(0, (first + used, count - used))
                if not holders[gap]:
                    del holders[gap]
                    gaps.pop(at)
            else:
                gap, each = capacity, capacity // size
                used = -(-left // each)
                first, opened = opened, opened + used
            taken = min(left, used * each)
            matches.append((size, rank, first, each))
            full = taken // each
            put(gap - each * size, first, full)
            if full < used:
                put(gap - (taken - full * each) * size, first + full, 1)
            left, rank = left - taken, rank + taken
    return matches


def containers_in(matches: list[tuple[int, int, int, int]], sizes: dict[int, int]) -> int:
    """How many containers the matches of ``best_fit``, in ascending order, use."""
    most = 0
    for (size, rank, first, each), following in zip(matches, [*matches[1:], (0, 0, 0, 0)]):
        end = following[1] if following[0] == size else sizes[size]
        most = max(most, first + -(-(end - rank) // each))
    return most


def pieces_of(specs: list[tuple[str, int]], id_: str):
    """Cuts items into pieces for every kind: full ones, numbered within their task, and the rest."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), {kind: 0 for kind, _ in specs}
        for batch in batches:
            tokens = np.maximum(np.nan_to_num(batch.column("tokens").to_numpy(zero_copy_only=False)).astype(np.int64), 0)
            for kind, capacity in specs:
                n = np.maximum(-(-tokens // capacity), 1)
                at = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                size = np.minimum(capacity, tokens[at] - piece * capacity)
                full = size == capacity
                nth = np.where(full, np.cumsum(full) - 1 + before[kind], -1)
                before[kind] += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(at), pa.string()), batch.column(id_).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size),
                        pa.array(np.full(len(at), part, np.int32)), pa.array(nth.astype(np.int64)),
                    ],
                    names=["container_kind", id_, "piece", "start_token", "tokens", "part", "nth"],
                )

    return pieces


def pack_items(items: DataFrame, specs: list[tuple[str, int]], id_: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Where every item goes, for each kind of container.

    ``items`` has ``id_`` (unique) and ``tokens``; ``specs`` are kinds and capacities. Result:
    ``container_kind``, ``container_id``, ``id_``, ``piece``, ``start_token``, ``tokens``. An item is split only if it exceeds the
    capacity, into full pieces and a rest. Items with null, zero or negative tokens take no room and have a
    null ``container_id``; a null id is an item of its own; an empty table gives an empty result; other
    columns are ignored.

    Full pieces are numbered by their task and place in it, without a shuffle. Of the others only the number
    of each size comes to the driver, at most ``capacity`` numbers a kind; ranks within a size are taken in
    as many buckets as its number asks for.
    """
    spark = items.sparkSession
    kind_of_id = dict(items.dtypes)[id_]
    rows = items.select(F.col(id_).alias(id_), F.col(tokens).cast("double").alias("tokens"))
    schema = f"container_kind string, `{id_}` {kind_of_id}, piece int, start_token bigint, tokens bigint, part int, nth bigint"
    each = cut(rows.mapInArrow(pieces_of([(k, int(c)) for k, c in specs], id_), schema))
    counts = each.where("tokens > 0 and nth < 0").groupBy("container_kind", "tokens").agg(F.count("*").alias("n")).collect()
    found: dict[str, tuple[np.ndarray, ...]] = {}
    opened_by: list[tuple[str, int]] = []
    for kind, capacity in specs:
        sizes = {r.tokens: r.n for r in counts if r.container_kind == kind}
        matches = best_fit(sizes, int(capacity))
        if len(matches) > MOST_MATCHES:
            raise ValueError(f"{kind}: {len(matches)} matches are more than the {MOST_MATCHES} a task may be sent")
        found[kind] = tuple(np.array(sorted(matches), np.int64).reshape(-1, 4).T)
        opened_by.append((kind, containers_in(sorted(matches), sizes)))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("container_kind").to_pylist(), object)
            size, rank = batch.column("tokens").to_numpy(), batch.column("rank").to_numpy()
            out = np.full(len(names), -1, np.int64)
            for kind, (sizes, ranks, firsts, eachs) in found.items():
                at = np.flatnonzero((names == kind) & (size > 0))
                if not len(at):
                    continue
                span = np.int64(max(int(ranks.max()), int(rank[at].max())) + 1)
                m = np.searchsorted(sizes * span + ranks, size[at] * span + rank[at], side="right") - 1
                out[at] = firsts[m] + (rank[at] - ranks[m]) // eachs[m]
            arrays = [batch.column("container_kind"), pa.array(out, mask=out < 0), *[batch.column(c) for c in (id_, "piece", "start_token", "tokens")]]
            yield pa.RecordBatch.from_arrays(arrays, names=["container_kind", "container_id", id_, "piece", "start_token", "tokens"])

    columns = ["container_kind", "container_id", id_, "piece", "start_token", "tokens"]
    buckets = max(1, -(-max((r.n for r in counts), default=0) // 50_000))
    ranked = spread_rank(each.where("nth < 0").drop("part", "nth"), ["container_kind", "tokens"], [F.col(id_), F.col("piece")], id_, buckets)
    others = ranked.mapInArrow(place, f"container_kind string, container_id bigint, `{id_}` {kind_of_id}, piece int, start_token bigint, tokens bigint")
    # Containers of full pieces come after all others: those of the tasks before, then the place within the task.
    opened = spark.createDataFrame(opened_by, "__k string, opened bigint")
    full = each.where("nth >= 0")
    ahead = Window.partitionBy("container_kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = full.groupBy("container_kind", "part").agg(F.count("*").alias("n")).select(F.col("container_kind").alias("__k"), F.col("part").alias("__p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    shifts = shifts.join(opened, "__k").select("__k", "__p", (F.col("shift") + F.col("opened")).alias("shift"))
    numbered = full.join(shifts, (F.col("container_kind") == F.col("__k")) & (F.col("part") == F.col("__p"))).withColumn("container_id", F.col("shift") + F.col("nth"))
    return others.select(columns).unionByName(numbered.select(columns))


def fill_report(placed: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """For each kind: containers, pieces, tokens, and the share of the room that is filled."""
    capacity = placed.sparkSession.createDataFrame([(k, int(c)) for k, c in specs], "container_kind string, capacity bigint")
    used = placed.where("container_id is not null").groupBy("container_kind").agg(
        (F.max("container_id") + 1).alias("containers"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens")
    )
    return used.join(capacity, "container_kind").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
