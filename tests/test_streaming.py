"""A stream gives what the batch gives."""

import numpy as np

from turnloom.operators.clustering import online_labels
from turnloom.streaming import sessions


def drain(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_windows_over_chunks(spark, tmp_path):
    data = np.arange(1000, dtype="<i2").tobytes()
    for i in range(4):
        part = [("s", i, data[i * 500 : (i + 1) * 500])]
        spark.createDataFrame(part, "session_id string, seq bigint, pcm binary").write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session_id string, seq bigint, pcm binary").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    rows = sorted(drain(spark, sessions.stream_windows(source, 400, 100), "windows"), key=lambda r: r.win_idx)
    assert [r.first_sample for r in rows] == [0, 100, 200, 300, 400, 500, 600]
    assert all(bytes(r.samples) == data[2 * r.first_sample :][:800] for r in rows)


def test_labels_equal_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [("s", w, k, (np.eye(8)[(w + k) % 3] + r.normal(0, 0.05, 8)).tolist(), 0.9) for w in range(12) for k in range(2)]
    schema = "session_id string, win_idx bigint, spk int, embedding array<double>, activity double"
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.stream_labels(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), delta_new=0.5)
    got = {(x.win_idx, x.spk): x.label for x in drain(spark, stream, "labels")}
    want = {(x.win_idx, x.spk): x.label for x in online_labels(batch, "session_id", "win_idx", "spk", "embedding", "activity", 0.5).collect()}
    assert got == want and set(want.values()) == {"auto:A", "auto:B", "auto:C"}


def chunks_in(spark, folder, rows, schema):
    for row in rows:
        spark.createDataFrame([row], schema).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_the_end_flushes_a_padded_window(spark, tmp_path):
    data = np.arange(500, dtype="<i2").tobytes()
    schema = "session_id string, seq bigint, pcm binary, text string"
    rows = [("s", 0, data[:600], None), ("s", 1, None, "hello"), ("s", 2, data[600:], None), ("s", 3, None, '{"type":"eof"}')]
    batch = spark.createDataFrame(rows, schema)
    assert sessions.until_end(sessions.frames(batch)).count() == 2
    assert sorted(r.seq for r in sessions.frames(sessions.with_eof(batch.where("pcm is not null").drop("text"))).where("last").collect()) == [3]
    stream = sessions.stream_windows(sessions.frames(chunks_in(spark, str(tmp_path / "in"), rows, schema)), 200, 100)
    found = sorted(drain(spark, stream, "flushed"), key=lambda r: r.win_idx)
    assert [r.first_sample for r in found] == [0, 100, 200, 300, 400]
    assert bytes(found[-1].samples) == data[800:] + bytes(200)


def test_a_silent_session_is_flushed(spark, tmp_path):
    import time

    schema = "session_id string, seq bigint, pcm binary"
    stream = sessions.stream_windows(chunks_in(spark, str(tmp_path / "in"), [("s", 0, b"\1\0" * 150)], schema), 100, 100, idle_ms=1)
    q = stream.writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while spark.table("idle").count() < 2 and time.time() < until:
            time.sleep(0.5)
        assert sorted(r.win_idx for r in spark.table("idle").collect()) == [0, 1]
    finally:
        q.stop()


def test_a_full_queue_drops_the_newest(spark):
    rows = [("q", i, put) for i, put in enumerate([True, True, True, False, True, True, False, False, False, True])]
    found = sessions.kept_by_queue(spark.createDataFrame(rows, "k string, i int, put boolean"), "k", ["i"], "put", 2)
    assert sorted(r.i for r in found.collect()) == [0, 1, 4, 9]


def test_retries_wait_and_give_up():
    calls, waits = [], []

    def failing(batch, batch_id):
        calls.append(batch_id)
        if len(calls) < 3:
            raise OSError("gone")

    sessions.retried(failing, sleep=waits.append)(None, 7)
    assert calls == [7, 7, 7] and waits == [1.0, 2.0]

    def never(batch, batch_id):
        raise OSError("gone")

    import pytest

    with pytest.raises(OSError):
        sessions.retried(never, sleep=waits.append)(None, 8)
    assert sessions.retried(never, skip=True, sleep=waits.append)(None, 9) is None
