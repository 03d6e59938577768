"""Streams: sliding windows over PCM, ring buffers, labels by session, event-time summaries."""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.labels import LETTERS
from ..operators.clustering import OnlineCenters


def frames(messages: DataFrame) -> DataFrame:
    """Binary frames of mixed messages (``session_id``, ``seq``, ``pcm``, ``text``) as chunks, with ``last``.

    A text message is no audio and is skipped, but for ``{"type": "eof"}``, which becomes an empty chunk with
    ``last``; text that is no JSON is skipped, too. Works on a stream and on a table alike.
    """
    ends = F.coalesce(F.get_json_object("text", "$.type") == "eof", F.lit(False))
    kept = messages.where(F.col("pcm").isNotNull() | ends)
    others = [c for c in messages.columns if c not in ("pcm", "text")]
    return kept.select(*others, F.when(ends, F.lit(b"")).otherwise(F.col("pcm")).alias("pcm"), ends.alias("last"))


def until_end(chunks: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """The chunks of each session (see ``frames``) before its first ``last`` one; sessions without one are whole."""
    ends = chunks.where("last").groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__end"))
    open_ = chunks.join(ends, F.col(key).eqNullSafe(F.col("__k")), "left")
    return open_.where(F.col("__end").isNull() | (F.col(order) < F.col("__end"))).drop("__k", "__end", "last")


def with_eof(chunks: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Chunks with ``text``, and after the last of each session the message that ends it: what a replay sends."""
    ends = chunks.groupBy(key).agg((F.max(order) + 1).alias(order)).withColumn("text", F.lit('{"type":"eof"}'))
    return chunks.withColumn("text", F.lit(None).cast("string")).unionByName(ends, allowMissingColumns=True)


def kept_by_queue(events: DataFrame, key: str, order: list[str], puts: str, capacity: int = 100) -> DataFrame:
    """The rows put into a bounded queue that drops the newest: those for which there was room.

    ``puts`` is true for a row put in and false for one taken out; taking from an empty queue does nothing.
    Each key is one queue, read in order as a sorted stream.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, held = None, 0
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (k, put) in enumerate(zip(batch[key], batch[puts])):
                if k != queue:
                    queue, held = k, 0
                if put:
                    keep[i] = held < capacity
                    held += int(keep[i])
                else:
                    held = max(0, held - 1)
            yield batch[keep]

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, events.schema)


def retried(write: Callable[[DataFrame, int], None], delays: tuple[float, ...] = (1.0, 2.0, 4.0), skip: bool = False, sleep: Callable[[float], None] = clock.sleep) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a write that fails is tried again after each of ``delays`` seconds; the last error is raised, or with ``skip`` the batch is left out.

    The write must replace what an earlier attempt left, as that of ``fan_out`` does.
    """

    def tried(batch: DataFrame, batch_id: int) -> None:
        for delay in (*delays, None):
            try:
                return write(batch, batch_id)
            except Exception:
                if delay is None:
                    if skip:
                        return None
                    raise
                sleep(delay)

    return tried


def stream_windows(chunks: DataFrame, window: int = 160_000, hop: int = 16_000, idle_ms: int | None = None) -> DataFrame:
    """Windows over each session's PCM as it arrives: ``session_id``, ``win_idx``, ``first_sample``, ``samples`` (bytes).

    ``chunks`` has ``session_id``, ``seq`` and ``pcm`` (int16, mono), in order of ``seq`` within a batch, and
    may have ``last`` (see ``frames``). The state of a session is what is not yet consumed, shorter than a
    window. A ``last`` chunk, or with ``idle_ms`` a session that was silent for so long, ends it: what is left
    is one more window, padded with zeros, and the state is removed.
    """
    marked = chunks if "last" in chunks.columns else chunks.withColumn("last", F.lit(False))

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, index = state.get if state.exists else (b"", 0)
        data, ends = bytes(tail), state.hasTimedOut
        if not ends:
            rows = pd.concat(list(batches)).sort_values("seq")
            stop = np.flatnonzero(rows["last"].fillna(False).to_numpy(bool))
            ends = len(stop) > 0
            data += b"".join(bytes(p) for p in rows.pcm.iloc[: stop[0] if ends else None])
        out, at = [], 0
        while len(data) - at >= 2 * window:
            out.append((key[0], index, index * hop, data[at : at + 2 * window]))
            at, index = at + 2 * hop, index + 1
        rest = data[at:]
        if ends:
            if rest:
                out.append((key[0], index, index * hop, rest + bytes(2 * window - len(rest))))
            if state.exists:
                state.remove()
        else:
            state.update((rest, index))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "win_idx", "first_sample", "samples"])

    schema = "session_id string, win_idx bigint, first_sample bigint, samples binary"
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return marked.groupBy("session_id").applyInPandasWithState(step, schema, "tail binary, win_idx bigint", "append", timeout)


def stream_labels(windows: DataFrame, delta_new: float = 1.0, rho: float = 0.3, most: int = 20, tau_active: float = 0.0, idle_ms: int | None = None) -> DataFrame:
    """Global labels of local speakers, window by window, as in ``online_labels``; the state is the session's centres.

    ``windows`` has ``session_id``, ``win_idx``, ``spk``, ``embedding`` and ``activity``; a window's rows come in
    one batch. With ``idle_ms`` a session that was silent for so long is over and its centres are forgotten.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["session_id", "win_idx", "spk", "label"])
            return
        centers = OnlineCenters(delta_new, rho, most, tau_active)
        if state.exists:
            centers.sums = [np.array(x) for x in state.get[0]]
        out = []
        for window, part in pd.concat(list(batches)).sort_values(["win_idx", "spk"]).groupby("win_idx", sort=True):
            found = centers.assign(np.stack(part.embedding.to_numpy()), part.activity.to_numpy(float))
            out += [(key[0], int(window), int(s), f"auto:{LETTERS[c]}" if c >= 0 else None) for s, c in zip(part.spk, found)]
        state.update(([x.tolist() for x in centers.sums],))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "win_idx", "spk", "label"])

    schema = "session_id string, win_idx bigint, spk int, label string"
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return windows.groupBy("session_id").applyInPandasWithState(step, schema, "sums array<array<double>>", "append", timeout)


def stream_activity(segments: DataFrame, time: str = "ingest_ts", late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Segments and distinct labels (estimated) by session and time window; rows later than ``late`` are dropped by the watermark."""
    slot = F.window(time, window)
    return segments.withWatermark(time, late).groupBy("session_id", slot.alias("slot")).agg(F.count("*").alias("segments"), F.approx_count_distinct("label").alias("labels"))


def stream_sessions(segments: DataFrame, time: str = "ingest_ts", late: str = "10 minutes", gap: str = "30 seconds") -> DataFrame:
    """Stretches of activity of a session without a pause of ``gap``."""
    return segments.withWatermark(time, late).groupBy("session_id", F.session_window(time, gap).alias("stretch")).agg(F.count("*").alias("segments"))


def first_deliveries(segments: DataFrame, keys: list[str], time: str = "ingest_ts", late: str = "10 minutes") -> DataFrame:
    """Rows of a stream without those that repeat a key within the watermark."""
    return segments.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def paced(spark, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of parquet chunks as a stream, ``files`` at a time: the rate limit that stands for bounded queues."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def fan_out(sinks: dict[str, str]):
    """For ``foreachBatch``: each batch goes to several folders, filtered by a condition, and a repeated batch replaces itself.

    ``sinks`` maps a folder to a SQL condition. A batch that is tried again after a failure overwrites what
    its first attempt wrote, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for path, condition in sinks.items():
                batch.where(condition).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
