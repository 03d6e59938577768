"""Joins Spark has no operator for: by overlapping intervals, as of a time, and by nearest vector."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot
from ..session import cut


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: tuple[str, str], right_on: tuple[str, str], bucket: int, how: str = "inner", most: int = 64) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals ``[start, end)`` overlap.

    Both sides are spread over the time buckets they touch, joined on key and bucket, and a pair is kept in
    the first bucket it shares: an equi-join, which a hot key does not skew beyond its bucket. ``bucket``
    should be near the usual length. An interval that touches more than ``most`` buckets (a damaged end) is
    placed in buckets 64 times as long instead; every row of the other side looks for such ones in one or
    two of these, where only long ones are met. Apart from ``keys`` the sides' columns must differ in name. Rows
    with a null or empty interval, or a null key, match nothing; ``left`` keeps them, with nulls on the right
    (``left`` is then written once, so that its rows keep their numbers).
    """
    ls, le = (F.col(c) for c in left_on)
    rs, re_ = (F.col(c) for c in right_on)
    wide = bucket * 64

    def touched(s: Column, e: Column, width: int) -> Column:
        return F.sequence(F.floor(s / width), F.floor((e - 1) / width))

    def spread(df: DataFrame, s: Column, e: Column, long_roles: list[int], short_role: int) -> DataFrame:
        """One row for each role and bucket: short intervals in usual buckets (role 0) and, to be met by long ones of the other side, in one wide bucket."""
        long = F.floor((e - 1) / bucket) - F.floor(s / bucket) >= most
        placed = lambda role, width: F.transform(touched(s, e, width), lambda b: F.struct(F.lit(role).alias("r"), b.alias("b")))
        keys_of = F.when(long, F.concat(*[placed(r, wide) for r in long_roles])).otherwise(F.concat(placed(0, bucket), placed(short_role, wide)))
        return df.where(e > s).withColumn("__k", F.explode(keys_of)).withColumn("__r", F.col("__k.r")).withColumn("__b", F.col("__k.b")).drop("__k")

    numbered = cut(left.withColumn("__row", F.monotonically_increasing_id())) if how == "left" else left
    # Long ones of the left meet all of the right in role 1, short ones of the left the long ones of the right in role 2.
    a, b = spread(numbered, ls, le, [1], 2), spread(right, rs, re_, [1, 2], 1)
    width = F.when(F.col("__r") == 0, bucket).otherwise(wide)
    meets = (ls < re_) & (rs < le) & (F.col("__b") == F.floor(F.greatest(ls, rs) / width))
    pairs = a.join(b, [*keys, "__r", "__b"]).where(meets).drop("__r", "__b")
    if how == "inner":
        return pairs
    alone = numbered.join(pairs.select("__row").distinct(), "__row", "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True).drop("__row")


def dominant_overlap(phrases: DataFrame, segments: DataFrame, keys: list[str], phrase_id: str, phrase_on: tuple[str, str], segment_on: tuple[str, str], label: str, bucket: int, fallback: str = "unknown") -> DataFrame:
    """The label that overlaps each phrase longest: ``phrase_id``, ``label``, ``overlap``.

    Overlaps of a label add up; of equal ones the label whose segment starts first, then the smaller label,
    is taken. A phrase without any gets ``fallback`` and 0. Segments with a null label count as none.
    """
    named = segments.where(F.col(label).isNotNull()).select(*keys, *[F.col(c) for c in segment_on], label)
    pairs = interval_join(phrases.select(*keys, phrase_id, *phrase_on), named, keys, phrase_on, segment_on, bucket)
    shared = F.least(F.col(phrase_on[1]), F.col(segment_on[1])) - F.greatest(F.col(phrase_on[0]), F.col(segment_on[0]))
    per = pairs.groupBy(phrase_id, label).agg(F.sum(shared).alias("overlap"), F.min(segment_on[0]).alias("__first"))
    # The largest overlap, then the earliest start, then the smallest label: a maximum, so it combines before the shuffle.
    best = per.groupBy(phrase_id).agg(F.min(F.struct(-F.col("overlap"), F.col("__first"), F.col(label).alias("l"))).alias("__b"))
    found = best.select(phrase_id, F.col("__b.l").alias(label), (-F.col("__b.col1")).alias("overlap"))
    all_ = phrases.select(phrase_id).distinct().join(found, phrase_id, "left")
    return all_.select(phrase_id, F.coalesce(label, F.lit(fallback)).alias(label), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], forward: bool = False, exact: bool = True, chunk: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` at or before its time (``forward``: the earliest at or after).

    Both sides have ``keys`` and ``time``. One union and one sorted pass, no pairs. With ``exact`` rows of
    the same time match. Of rows of ``right`` with equal times the one with the largest (``forward``:
    smallest) values is taken. Left rows without a match get nulls.

    With ``chunk`` (times must be numbers) a key's rows are sorted slice by slice, and what the slices before
    hold last is carried over: a hot key is then many tasks.
    """
    columns = [c for c in left.columns if c not in (*keys, time)]
    one = F.struct(F.lit(1).alias("hit"), *[F.col(v) for v in values])
    kind = lambda df, x: df.select(x.alias("x")).schema["x"].dataType
    a = left.select(*keys, time, F.struct(*columns).alias("__l"), F.lit(None).cast(kind(right, one)).alias("__r"), F.lit(1).alias("__side"))
    b = right.select(*keys, time, F.lit(None).cast(kind(left, F.struct(*columns))).alias("__l"), one.alias("__r"), F.lit(0 if exact else 2).alias("__side"))
    both = a.unionByName(b)
    if chunk is not None:
        both = both.withColumn("__c", F.floor(F.col(time) / chunk))
    slices = [*keys, "__c"] if chunk is not None else keys
    order = [F.col(time), F.col("__side"), F.col("__r")] if not forward else [F.col(time).desc(), F.col("__side").asc(), F.col("__r").desc()]
    line = Window.partitionBy(*slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__m", F.last_value("__r", ignoreNulls=True).over(line)).where("__side = 1")
    if chunk is not None:
        held = F.when(F.col("__side") != 1, F.struct(F.col(time).alias("t"), F.col("__r").alias("r")))
        tails = both.groupBy(*slices).agg((F.min(held) if forward else F.max(held)).alias("__tail"))
        earlier = Window.partitionBy(*keys).orderBy(F.col("__c").desc() if forward else F.col("__c")).rowsBetween(Window.unboundedPreceding, -1)
        carried = tails.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(slices)], F.last_value("__tail", ignoreNulls=True).over(earlier).alias("__carry"))
        same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(slices)]
        seen = seen.join(carried, same).withColumn("__m", F.coalesce("__m", "__carry.r"))
    return seen.select(*keys, time, "__l.*", *[F.col(f"__m.{v}").alias(v) for v in values])


class _Known:
    """Known vectors as matrices, by the values they are joined on and their length; rows in the order of their keys."""

    def __init__(self, table: pa.Table, on: list[str], key: str):
        keys = table.column(key).to_pylist()
        rank = sorted(range(len(keys)), key=lambda i: tuple(keys[i].values()) if isinstance(keys[i], dict) else keys[i])
        table = table.take(pa.array(rank, pa.int64()))
        self.keys = table.column(key).combine_chunks()
        groups = list(zip(*[table.column(c).to_pylist() for c in on], table.column("__k").to_pylist()))
        rows: dict[tuple, list[int]] = {}
        for i, (*where, vector) in enumerate(groups):
            rows.setdefault((*where, len(vector)), []).append(i)
        self.parts = {k: (np.array(at), np.array([groups[i][-1] for i in at], float)) for k, at in rows.items()}
        self.places = {k: i for i, k in enumerate(self.keys.to_pylist())} if pa.types.is_integer(self.keys.type) else {}

    def best(self, batch: pa.RecordBatch, on: list[str], probe_id: str, not_itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the batch that can be compared, the known row most similar to each, and how similar it is."""
        column = batch.column("__p")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(lengths) - lengths
        where: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in on], lengths.tolist())):
            where.setdefault(k, []).append(i)
        ids = batch.column(probe_id)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for k, at in where.items():
            if k not in self.parts or not k[-1]:
                continue
            rows, known = self.parts[k]
            for lo in range(0, len(at), 4096):
                part = np.array(at[lo : lo + 4096])
                s = flat[starts[part, None] + np.arange(k[-1])] @ known.T
                if not_itself:
                    own = np.array([self.places.get(x, -1) for x in ids.take(pa.array(part)).to_pylist()])
                    s[rows[None, :] == own[:, None]] = -np.inf
                top = s.argmax(axis=1)
                out.append((part, rows[top], s[np.arange(len(part)), top]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _comparable(known: DataFrame, on: list[str], key: str, vector: str) -> tuple[DataFrame, int]:
    """Known rows with a key and a vector without null or NaN (``__k``), and the bytes of all their numbers."""
    rows = known.select(*on, F.col(key), F.col(vector).cast("array<double>").alias("__k"))
    sound = rows.where(F.col(key).isNotNull() & F.col("__k").isNotNull() & F.forall("__k", lambda x: x.isNotNull() & ~F.isnan(x)))
    return sound, 8 * (sound.agg(F.sum(F.size("__k"))).first()[0] or 0)


def nearest_vector(
    probes: DataFrame, known: DataFrame, probe_id: str, probe_vector: str, known_key: str, known_vector: str, least: float, on: list[str] = (), max_bytes: int = 64 << 20, not_itself: bool = False,
) -> DataFrame:
    """For each probe the most similar known unit vector, if the dot product reaches ``least``: ``probe_id``, ``known_key``, ``similarity``.

    Ties go to the smallest ``known_key``; vectors of different lengths, null vectors and null keys are not
    compared; with ``not_itself`` a probe is not compared with the known vector of its own id. The numbers in
    ``known`` are counted first: up to ``max_bytes`` they are sent to every task as matrices, and a batch of
    probes is one product. Beyond, both sides are joined on ``on`` (for example the model), or, without it,
    both are cut into blocks, each pair of which is a task: the way for a stated set of probes against all rows.
    """
    on = list(on)
    types = dict(known.dtypes)
    schema = f"`{probe_id}` {dict(probes.dtypes)[probe_id]}, `{known_key}` {types[known_key]}, similarity double"
    small, size = _comparable(known, on, known_key, known_vector)
    left = probes.select(*on, probe_id, F.col(probe_vector).cast("array<double>").alias("__p"))

    def found(have: _Known, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, which, s = have.best(batch, on, probe_id, not_itself)
        ok = s >= least
        return pa.RecordBatch.from_arrays([batch.column(probe_id).take(pa.array(rows[ok])), have.keys.take(pa.array(which[ok])), pa.array(s[ok])], names=[probe_id, known_key, "similarity"])

    if size <= max_bytes:
        table = small.toArrow()  # bounded by max_bytes

        def product(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = _Known(table, on, known_key)
            for batch in batches:
                yield found(have, batch)

        return left.mapInArrow(product, schema)
    if on:
        scored = left.join(small, on).withColumn("similarity", dot(F.col("__p"), F.col("__k"))).where(F.col("similarity") >= least)
        if not_itself:
            scored = scored.where(F.col(probe_id) != F.col(known_key))
        pairs = scored.select(probe_id, known_key, "similarity")
    else:
        across, down = -(-size // max_bytes), max(1, -(-left.count() // 200_000))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(n) - 1).cast("long")))
        a = left.withColumn("__a", F.pmod(F.xxhash64(probe_id), F.lit(int(down)))).withColumn("__b", every(across))
        b = small.withColumn("__b", F.pmod(F.xxhash64(known_key), F.lit(int(across)))).withColumn("__a", every(down))

        def block(one: pa.Table, other: pa.Table) -> pa.Table:
            batches = one.combine_chunks().to_batches()
            parts = [found(_Known(other, on, known_key), x) for x in batches] if other.num_rows else []
            return pa.Table.from_batches(parts) if parts else pa.table({probe_id: one.column(probe_id).slice(0, 0), known_key: other.column(known_key).slice(0, 0), "similarity": pa.array([], pa.float64())})

        pairs = a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInArrow(block, schema)
    best = pairs.groupBy(probe_id).agg(F.min(F.struct(-F.col("similarity"), F.col(known_key).alias("k"))).alias("__b"))
    return best.select(probe_id, F.col("__b.k").alias(known_key), (-F.col("__b.col1")).alias("similarity"))


def three_tiers(
    probes: DataFrame, registered: DataFrame, stored: DataFrame, probe_id: str, vector: str, key: str, known_vector: str, least_registered: float = 0.70, least_stored: float = 0.75, on: list[str] = (), max_bytes: int = 64 << 20,
) -> DataFrame:
    """The registered speaker of each probe, else the stored one, else null: ``probe_id``, ``tier``, ``key``, ``similarity``.

    As in ``nearest_vector`` the known vectors are counted; up to ``max_bytes`` a batch of probes meets both
    tiers in one pass.
    """
    on = list(on)
    (one, size1), (two, size2) = (_comparable(x, on, key, known_vector) for x in (registered, stored))
    if size1 + size2 <= max_bytes:
        tables = one.toArrow(), two.toArrow()  # bounded by max_bytes

        def both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiers = [_Known(t, on, key) for t in tables]
            for batch in batches:
                n = batch.num_rows
                tier, which, score = np.full(n, "none", object), np.full(n, -1), np.zeros(n)
                for name, have, least, shift in (("stored", tiers[1], least_stored, len(tiers[0].keys)), ("registered", tiers[0], least_registered, 0)):
                    rows, found, s = have.best(batch, on, probe_id, False)
                    ok = s >= least
                    tier[rows[ok]], which[rows[ok]], score[rows[ok]] = name, found[ok] + shift, s[ok]
                keys = pa.concat_arrays([t.keys for t in tiers]).take(pa.array(which, mask=which < 0))
                yield pa.RecordBatch.from_arrays([batch.column(probe_id), pa.array(tier, pa.string()), keys, pa.array(score, mask=which < 0)], names=[probe_id, "tier", key, "similarity"])

        left = probes.select(*on, probe_id, F.col(vector).cast("array<double>").alias("__p"))
        return left.mapInArrow(both, f"`{probe_id}` {dict(probes.dtypes)[probe_id]}, tier string, `{key}` {dict(registered.dtypes)[key]}, similarity double")
    first = nearest_vector(probes, registered, probe_id, vector, key, known_vector, least_registered, on)
    second = nearest_vector(probes, stored, probe_id, vector, key, known_vector, least_stored, on)
    one = first.select(F.col(probe_id).alias("__p1"), F.col(key).alias("__k1"), F.col("similarity").alias("__s1"))
    two = second.select(F.col(probe_id).alias("__p2"), F.col(key).alias("__k2"), F.col("similarity").alias("__s2"))
    joined = probes.select(probe_id).join(one, F.col(probe_id) == F.col("__p1"), "left").join(two, F.col(probe_id) == F.col("__p2"), "left")
    tier: Column = F.when(F.col("__p1").isNotNull(), "registered").when(F.col("__p2").isNotNull(), "stored").otherwise("none")
    return joined.select(probe_id, tier.alias("tier"), F.coalesce("__k1", "__k2").alias(key), F.coalesce("__s1", "__s2").alias("similarity"))
