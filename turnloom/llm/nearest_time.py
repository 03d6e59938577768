"""Matching records by nearest time: x-fast tries of time stamps per entity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slabs import group_starts, slabs


class XFastTrie:
    """Predecessor and successor of many keys at once.

    Keys are non-negative integers below ``2**bits``. Each level has a hash table of the prefixes of that
    length and, for each, its first and last leaf; a binary search over the prefix length finds the deepest
    node on a query's path in ``log2(bits)`` table look-ups.
    """

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.bits = np.unique(keys), bits
        self._levels: dict[int, tuple[pd.Index, np.ndarray, np.ndarray]] = {}

    def _level(self, length: int) -> tuple[pd.Index, np.ndarray, np.ndarray]:
        if length not in self._levels:
            prefix = self.keys >> (self.bits - length)
            first = np.flatnonzero(np.diff(prefix, prepend=prefix[:1] - 1))
            self._levels[length] = pd.Index(prefix[first]), first, np.append(first[1:], len(prefix)) - 1
        return self._levels[length]

    def neighbours(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the largest key at most, and of the smallest key at least, each query; -1 for none."""
        n = len(query)
        if not len(self.keys):
            return np.full(n, -1), np.full(n, -1)
        depth, top = np.zeros(n, np.int64), np.full(n, self.bits, np.int64)  # the deepest known node, the deepest possible
        low, high = np.zeros(n, np.int64), np.full(n, len(self.keys) - 1, np.int64)
        while (active := np.flatnonzero(depth < top)).size:
            middle = (depth[active] + top[active] + 1) // 2
            for length in np.unique(middle):
                rows = active[middle == length]
                index, first, last = self._level(int(length))
                at = index.get_indexer(query[rows] >> (self.bits - length))
                hit, missed = rows[at >= 0], rows[at < 0]
                depth[hit], low[hit], high[hit] = length, first[at[at >= 0]], last[at[at >= 0]]
                top[missed] = length - 1
        exact = depth == self.bits
        bit = (query >> np.maximum(self.bits - depth - 1, 0)) & 1
        # The node has no child on the query's side: all its leaves lie on the other.
        before = np.where(exact, low, np.where(bit == 1, high, low - 1))
        after = np.where(exact, low, np.where(bit == 1, high + 1, low))
        return before, np.where(after < len(self.keys), after, -1)


def _match(bits: int, tolerance: int, keys: list[str], left: list[str], right: list[str]):
    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, [*keys, "__c"]):
            code = np.cumsum(group_starts(slab, [*keys, "__c"])) - 1
            side = slab.column("__side").to_numpy()
            key = (code << bits) | slab.column("__r").to_numpy()
            ids = slab.column("__id").to_numpy()
            rows, queries = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            if not len(rows) or not len(queries):
                continue
            order = rows[np.lexsort((ids[rows], key[rows]))]
            leaf = order[np.flatnonzero(np.diff(key[order], prepend=-1))]  # of equal times the smallest id
            trie = XFastTrie(key[leaf], bits + int(code[-1]).bit_length())
            before, after = trie.neighbours(key[queries])
            far = np.int64(tolerance) + 1

            def gap(at: np.ndarray) -> np.ndarray:
                ok = (at >= 0) & (code[leaf[at]] == code[queries])
                return np.where(ok, np.minimum(np.abs(key[leaf[at]] - key[queries]), far), far)

            d0, d1 = gap(before), gap(after)
            i0, i1 = ids[leaf[before]], ids[leaf[after]]
            later = (d1 < d0) | ((d1 == d0) & (i1 < i0))
            found = np.minimum(d0, d1) <= tolerance
            take_left = queries[found]
            take_right = leaf[np.where(later, after, before)[found]]
            own, other = slab.take(pa.array(take_left)), slab.take(pa.array(take_right))
            arrays = [own.column(c) for c in left] + [other.column(c) for c in right] + [pa.chunked_array([pa.array(np.minimum(d0, d1)[found])])]
            yield from pa.Table.from_arrays(arrays, names=[*left, *right, "distance"]).to_batches()

    return match


def nearest_in_time(
    records: DataFrame,
    candidates: DataFrame,
    entity: list[str],
    time: str,
    left_id: str,
    right_id: str,
    tolerance: int,
    left: list[str] = (),
    right: list[str] = (),
    chunk: int = 600_000_000,
) -> DataFrame:
    """For each record the candidate of the same entity nearest in time, if within ``tolerance``.

    ``time`` and ``tolerance`` are whole numbers in one unit (microseconds suit the default ``chunk``); the
    ids are whole numbers. Of equally near candidates the smallest id is taken. Result: ``left_id``,
    ``right_id``, ``distance`` and the payload columns ``left`` of the record and ``right`` of the candidate,
    whose names must differ. Records without a candidate near enough, and rows with a null in the entity,
    the time or the id, give no row. Repeated records each give their row; an empty table on either side
    gives an empty result; other columns, even with equal names on both sides, are ignored.

    Both sides are spread by entity and time slice; a candidate near a slice's border is sent to both
    slices, so a hot entity is split without losing a match. Within a task the slices' tries share one set of
    prefix tables.
    """
    keys = [f"__e{i}" for i in range(len(entity))]
    bits = int(chunk + 2 * tolerance).bit_length()

    def side(df: DataFrame, which: int, own: list[str], id_: str) -> DataFrame:
        t = F.col(time).cast("long")
        base = df.where(F.greatest(*[F.col(c).isNull() for c in [*entity, time, id_]]) == F.lit(False))
        other, mine = (right, left) if which == 0 else (left, right)
        types = dict((candidates if which == 0 else records).dtypes)
        slices = F.array(F.floor(t / chunk)) if which == 0 else F.sequence(F.floor((t - tolerance) / chunk), F.floor((t + tolerance) / chunk))
        named = [(left_id, right_id), (right_id, left_id)][which]
        cols = {named[0]: F.col(id_), **{c: F.col(c) for c in mine}}
        blank = {c: F.lit(None).cast(types[c]) for c in [named[1], *other]}
        both = cols | blank
        return base.select(
            *[F.col(c).alias(k) for c, k in zip(entity, keys)],
            F.explode(slices).alias("__c"),
            t.alias("__t"),
            F.col(id_).cast("long").alias("__id"),
            F.lit(which).alias("__side"),
            *[both[c].alias(c) for c in [left_id, *left, right_id, *right]],
        ).withColumn("__r", F.col("__t") - F.col("__c") * F.lit(chunk) + F.lit(tolerance)).drop("__t")

    both = side(records, 0, list(left), left_id).unionByName(side(candidates, 1, list(right), right_id))
    placed = both.repartition(*keys, "__c").sortWithinPartitions(*keys, "__c")
    lefts, rights = [left_id, *left], [right_id, *right]
    types = dict(both.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*lefts, *rights]) + ", distance bigint"
    return placed.mapInArrow(_match(bits, tolerance, keys, lefts, rights), schema)
