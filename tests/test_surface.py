"""SQL functions, data sources, reports and sinks."""

import pytest

from turnloom.functions import register
from turnloom.sources import datasource, messages, report
from turnloom.streaming import sessions


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("SELECT cosine_sim(array(1D, 0D), array(1D, 1D)) c, overlap_s(0, 5, 3, 9) o, idx_to_label(2) l, idx_to_label(20) n, l2_normalize(array(3D, 4D)) u, vec_dot(array(2D), array(4D)) d").first()
    assert row.c == pytest.approx(0.5**0.5) and (row.o, row.l, row.n, row.u, row.d) == (2.0, "auto:C", None, [0.6, 0.8], 8.0)
    assert [tuple(r) for r in spark.sql("SELECT * FROM rttm_turns('SPEAKER a 1 0.5 1.0 <NA> <NA> S1 <NA> <NA>')").collect()] == [("a", 0.5, 1.5, "S1")]
    assert spark.sql("SELECT * FROM rttm_turns('no turn')").count() == 0


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "x.rttm").write_text("SPEAKER a 1 0.5 1.0 <NA> <NA> S1 <NA> <NA>\n; note\n")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "y.pcm").write_bytes(bytes(range(11)))
    assert [tuple(r) for r in spark.read.format("rttm").load(str(tmp_path / "x.rttm")).collect()] == [("a", 0.5, 1.5, "S1")]
    chunks = spark.read.format("pcm_chunks").option("chunk", "4").load(str(tmp_path / "p")).orderBy("seq").collect()
    assert b"".join(bytes(c.pcm) for c in chunks) == bytes(range(10)) and len(chunks) == 3
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("rttm").load(str(tmp_path / "nowhere")).collect()


def test_reports_and_results(spark, tmp_path):
    rows = spark.createDataFrame([("a<b", 0.12345, None), ("c", float("nan"), 2)], "name string, x double, n int")
    page = report.html_table(rows, "T & U")
    assert "a&lt;b" in page and "0.1234" in page or "0.1235" in page
    assert page.count("–") == 2
    with pytest.raises(ValueError):
        report.html_table(rows, "T", most=1)
    (tmp_path / "r.csv").write_text("model,der,note\nm1,0.5,x\nm2,bad,y\n")
    got = messages.flatten_results(messages.read_results(spark, str(tmp_path / "r.csv"), ["der", "cpu"])).orderBy("model").collect()
    assert [tuple(r) for r in got] == [("m1", "x", 0.5, 0.0), ("m2", "y", 0.0, 0.0)]
    out = str(tmp_path / "j")
    messages.write_jsonl(spark.createDataFrame([("k1", None), ("k2", "boom")], "key string, error string"), out)
    messages.write_jsonl(spark.createDataFrame([("k1", None)], "key string, error string"), out)
    assert [r.key for r in messages.done_keys(spark, out, ["key"]).collect()] == ["k1"]
    latency = spark.createDataFrame([("s", 0.0, 1.0, 0.5, "A"), ("s", 2.0, 3.0, None, "B")], "session_id string, phrase_t_start double, phrase_t_end double, latency_s double, label string")
    report.latency_dump(latency, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).first().phrases == 2


def test_fan_out_writes_once(spark, tmp_path):
    schema = "id bigint, final boolean"
    spark.createDataFrame([(1, True), (2, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    write = sessions.fan_out({str(tmp_path / "a"): "final", str(tmp_path / "b"): "true"})
    for n in range(2):
        q = sessions.paced(spark, str(tmp_path / "in"), schema).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1 and spark.read.parquet(str(tmp_path / "b")).count() == 2
