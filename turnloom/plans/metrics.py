"""Queries of metrics and reports over result rows (star tables stand in for experiment grids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diarization, reports
from ..session import table
from .conversation import SEGMENTS, TURNS, segments, turns
from ..operators.sequence import covered_time
from .registry import Registry

query = Registry()


def _ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session_id", F.col("ss").alias("start"), F.col("se").alias("end"), "label")


def _hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "seg_label").select("session_id").distinct()
    rows = segments(spark, sf_dir).join(known, "session_id", "left_semi")
    return rows.select("session_id", (F.col("s") * 1000).alias("start"), (F.col("e") * 1000).alias("end"), "label")


_DER = f"""WITH {TURNS}, {SEGMENTS}, r AS (SELECT session_id AS u, ss AS s, se AS e, label, 1 AS side FROM t),
h AS (SELECT session_id AS u, s * 1000 AS s, e * 1000 AS e, label, 0 AS side FROM g WHERE session_id IN (SELECT session_id FROM seg_label)),
b AS (SELECT * FROM r UNION ALL SELECT * FROM h),
c AS (SELECT DISTINCT u, pt FROM (SELECT u, s AS pt FROM b UNION ALL SELECT u, e FROM b)),
i AS (SELECT u, pt, lead(pt) OVER (PARTITION BY u ORDER BY pt) AS nx FROM c),
l AS (SELECT i.u, i.pt, i.nx, b.label, max(side) AS r, max(1 - side) AS h FROM i JOIN b ON i.u = b.u AND b.s <= i.pt AND i.nx <= b.e GROUP BY ALL),
n AS (SELECT u, pt, nx - pt AS d, sum(r) AS r, sum(h) AS h, sum(r * h) AS c FROM l GROUP BY ALL),
p AS (SELECT u AS session_id, CAST(sum(r * d) AS BIGINT) AS total, CAST(sum(greatest(r - h, 0) * d) AS BIGINT) AS miss, CAST(sum(greatest(h - r, 0) * d) AS BIGINT) AS false_alarm, CAST(sum((least(r, h) - c) * d) AS BIGINT) AS confusion FROM n GROUP BY u)
SELECT *, round(CASE WHEN total > 0 THEN (miss + false_alarm + confusion) / total END, 9) AS der FROM p"""


@query(_DER)
def m1_der_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = diarization.error_parts(_ref(spark, sf_dir), _hyp(spark, sf_dir), "session_id", 10_000_000)
    return parts.withColumn("der", F.round("der", 9))


@query()
def m1_der_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.der(_ref(spark, sf_dir), _hyp(spark, sf_dir), "session_id", 10_000_000, collar=500_000, skip_overlap=True)


@query("""SELECT user_id, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY user_id""")
def a8_percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.round(F.percentile("value", 0.5), 9).alias("p50"), F.round(F.percentile("value", 0.95), 9).alias("p95"))


@query("""WITH s AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)
SELECT user_id, v[CAST(round_even((len(v) - 1) * 0.5, 0) AS INT) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS INT) + 1] AS p95 FROM s""")
def a9_percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(reports.nearest_rank(F.col("value"), 50).alias("p50"), reports.nearest_rank(F.col("value"), 95).alias("p95"))


@query("""SELECT user_id, max(value) AS peak, round(avg(value), 6) AS mean, round(max(value) * 1e6 / 1e6, 6) AS peak_mb FROM events GROUP BY user_id""")
def a10_resource_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value") * 1e6 / 1e6, 6).alias("peak_mb"))


@query(f"""WITH {SEGMENTS} SELECT session_id, label, CAST(sum(e - s) AS BIGINT) AS total_ms, count(*) AS utterances, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id) AS ids, round(avg(confidence), 12) AS confidence FROM g GROUP BY session_id, label""")
def a4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("segment_id")), lambda x: x.cast("string")), ",")
    return segments(spark, sf_dir).groupBy("session_id", "label").agg(
        F.sum(F.col("e") - F.col("s")).alias("total_ms"), F.count("*").alias("utterances"), ids.alias("ids"), F.round(F.avg("confidence"), 12).alias("confidence")
    )


@query("""WITH x AS (SELECT session_id, utterance_id, arg_min(label, segment_id) AS was, arg_max(label, segment_id) AS became, min(segment_id) AS id FROM speaker_segment WHERE label IS NOT NULL GROUP BY ALL)
SELECT session_id, was, became, string_agg(utterance_id, ',' ORDER BY id) AS utterances, count(*) AS n FROM x WHERE was <> became GROUP BY ALL""")
def a5_label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "speaker_segment").where("label is not null")
    both = rows.groupBy("session_id", "utterance_id").agg(F.min_by("label", "segment_id").alias("was"), F.max_by("label", "segment_id").alias("became"), F.min("segment_id").alias("id"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "utterance_id"))), lambda s: s["utterance_id"]), ",")
    return both.where("was != became").groupBy("session_id", "was", "became").agg(names.alias("utterances"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT session_id, utterance_id, arg_max(label, segment_id) AS became FROM speaker_segment WHERE label IS NOT NULL GROUP BY ALL)
SELECT s.segment_id, coalesce(c.became, s.label) AS label FROM speaker_segment s LEFT JOIN c ON s.session_id = c.session_id AND s.utterance_id = c.utterance_id""")
def j12_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "speaker_segment").select("session_id", "utterance_id", "segment_id", "label")
    last = rows.where("label is not null").groupBy("session_id", "utterance_id").agg(F.max_by("label", "segment_id").alias("became"))
    return rows.join(last, ["session_id", "utterance_id"], "left").select("segment_id", F.coalesce("became", "label").alias("label"))


@query(f"""WITH {SEGMENTS} SELECT session_id, count(DISTINCT label) AS speakers, count(*) AS segments, count(DISTINCT label) FILTER (label LIKE 'stored:%') AS stored, min(s) AS first_ms, max(e) AS last_ms FROM g GROUP BY session_id""")
def a19_session_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.countDistinct(F.when(F.col("label").startswith("stored:"), F.col("label")))
    return segments(spark, sf_dir).groupBy("session_id").agg(F.countDistinct("label").alias("speakers"), F.count("*").alias("segments"), stored.alias("stored"), F.min("s").alias("first_ms"), F.max("e").alias("last_ms"))


@query("""SELECT l_returnflag, min((l_discount, l_orderkey, l_linenumber))[1] AS l_discount, min((l_discount, l_orderkey, l_linenumber))[2] AS l_orderkey, min((l_discount, l_orderkey, l_linenumber))[3] AS l_linenumber FROM lineitem GROUP BY l_returnflag""")
def a12_best_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_rows(table(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag"], ["l_orderkey", "l_linenumber"], [])


@query("""WITH a AS (SELECT l_returnflag AS m1, l_linestatus AS w1, avg(l_discount) AS d FROM lineitem GROUP BY ALL ORDER BY d, m1, w1 LIMIT 1), b AS (SELECT l_returnflag AS m2, l_linestatus AS w2, avg(l_tax) AS t FROM lineitem GROUP BY ALL ORDER BY t, m2, w2 LIMIT 1)
SELECT m1, w1, round(d, 9) AS d, m2, w2, round(t, 9) AS t FROM a, b WHERE m1 <> m2 OR w1 <> w2""")
def a13_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    champions = means.agg(F.min(F.struct("d", F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("w"))).alias("a"), F.min(F.struct("t", F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("w"))).alias("b"))
    return champions.select(F.col("a.m").alias("m1"), F.col("a.w").alias("w1"), F.round("a.d", 9).alias("d"), F.col("b.m").alias("m2"), F.col("b.w").alias("w2"), F.round("b.t", 9).alias("t")).where("m1 != m2 or w1 != w2")


@query("""SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) AS average, count(*) AS n FROM orders GROUP BY ALL""")
def a14_avg_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 6).alias("average"), F.count("*").alias("n"))


@query("""SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) AS average, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def a14_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 6).alias("average"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT * FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_size FROM part)), a AS (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM part GROUP BY ALL)
SELECT p_brand, p_size, round(coalesce(m, 0.0), 4) AS average FROM g LEFT JOIN a USING (p_brand, p_size)""")
def a15_dense_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dense_averages(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice")


@query("""WITH a AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority, m AS b FROM a WHERE o_orderstatus = 'O')
SELECT o_orderpriority, o_orderstatus, round(m, 6) AS average, round(m - b, 6) AS delta FROM a LEFT JOIN b USING (o_orderpriority)""")
def a16_delta_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.delta_to_baseline(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "O")
    return found.select("o_orderpriority", "o_orderstatus", F.round("average", 6).alias("average"), F.round("delta", 6).alias("delta"))


@query("""WITH l AS (SELECT 'l_returnflag' AS parameter, l_returnflag AS v, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_extendedprice FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_extendedprice FROM lineitem),
m AS (SELECT parameter, v, avg(x) AS m FROM l GROUP BY ALL) SELECT parameter, round(min(m), 6) AS least, round(max(m), 6) AS most, round(max(m) - min(m), 6) AS range FROM m GROUP BY parameter""")
def a17_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.sensitivity(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice")
    return found.select("parameter", *[F.round(c, 6).alias(c) for c in ("least", "most", "range")])


@query("""WITH s AS (SELECT l_returnflag, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(mean, 6) AS mean, round(std, 6) AS std, round(greatest(hi - mean, mean - lo) / (std + 1e-9), 6) AS worst_z FROM s""")
def a18_corpus_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.spread(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mean", "std", "worst_z")])


@query(f"""WITH {SEGMENTS}, x AS (SELECT session_id, label, s, e, unnest(range(s // 60000, (e - 1) // 60000 + 1)) AS slice FROM g), c AS (SELECT session_id, label, slice, greatest(s, slice * 60000) AS s, least(e, (slice + 1) * 60000) AS e FROM x),
p AS (SELECT session_id, slice, s AS t, 1 AS d FROM c UNION ALL SELECT session_id, slice, e, -1 FROM c), q AS (SELECT session_id, slice, t, sum(d) AS d FROM p GROUP BY ALL),
r AS (SELECT *, sum(d) OVER (PARTITION BY session_id, slice ORDER BY t) AS n, lead(t) OVER (PARTITION BY session_id, slice ORDER BY t) - t AS l FROM q), u AS (SELECT session_id, slice, CAST(sum(l) FILTER (n >= 1) AS BIGINT) AS covered FROM r GROUP BY ALL)
SELECT c.session_id, c.slice, u.covered, count(*) AS segments, count(DISTINCT label) AS labels FROM c JOIN u USING (session_id, slice) GROUP BY ALL""")
def a20_slice_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are cropped to every minute they touch; what they cover there counts once."""
    minute = F.explode(F.sequence(F.floor(F.col("s") / 60_000), F.floor((F.col("e") - 1) / 60_000)))
    rows = segments(spark, sf_dir).withColumn("slice", minute)
    cropped = rows.select("session_id", "slice", "label", F.greatest("s", F.col("slice") * 60_000).alias("s"), F.least("e", (F.col("slice") + 1) * 60_000).alias("e"))
    covered = covered_time(cropped, ["session_id", "slice"], "s", "e", 60_000).select("session_id", "slice", "covered")
    counts = cropped.groupBy("session_id", "slice").agg(F.count("*").alias("segments"), F.countDistinct("label").alias("labels"))
    return counts.join(covered, ["session_id", "slice"]).select("session_id", "slice", "covered", "segments", "labels")


_STOPS = (30_000_000, 60_000_000, 9_000_000_000_000)


def _online_der() -> str:
    """The SQL of ``m1_der_components`` over sides that are cut off at every stop."""
    sides, rest = _DER.split(",\nb AS", 1)
    cut = (
        f", k AS (SELECT unnest([{', '.join(map(str, _STOPS))}]) AS stop), r2 AS (SELECT u || '@' || stop AS u, s, least(e, stop) AS e, label, side FROM r, k WHERE s < stop),"
        " h2 AS (SELECT u || '@' || stop AS u, s, least(e, stop) AS e, label, side FROM h, k WHERE s < stop)"
    )
    body = rest.replace("SELECT * FROM r UNION ALL SELECT * FROM h", "SELECT * FROM r2 UNION ALL SELECT * FROM h2").replace("SELECT *, round(CASE", "SELECT regexp_replace(session_id, '@[0-9]+$', '') AS session_id, CAST(regexp_extract(session_id, '@([0-9]+)$', 1) AS BIGINT) AS stop, total, miss, false_alarm, confusion, round(CASE")
    return f"{sides}{cut},\nb AS{body}"


@query(_online_der())
def w13_online_der(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error rate of what was known at 30 s, at 60 s and at the end."""
    stops = F.explode(F.array(*[F.lit(x).cast("long") for x in _STOPS]))

    def until(df: DataFrame) -> DataFrame:
        cut = df.withColumn("stop", stops).where("start < stop")
        return cut.select(F.concat_ws("@", "session_id", F.col("stop").cast("string")).alias("recording"), "start", F.least("end", "stop").alias("end"), "label")

    parts = diarization.error_parts(until(_ref(spark, sf_dir)), until(_hyp(spark, sf_dir)), "recording", 10_000_000)
    session, stop = F.regexp_replace("recording", "@[0-9]+$", ""), F.regexp_extract("recording", "@([0-9]+)$", 1).cast("long")
    return parts.select(session.alias("session_id"), stop.alias("stop"), "total", "miss", "false_alarm", "confusion", F.round("der", 9).alias("der"))


@query(r"""WITH x AS (SELECT doc_id, regexp_extract(text, '([0-9]+) crowns', 1) AS m FROM documents) SELECT count(*) AS docs, count(nullif(m, '')) AS hits, min(CAST(nullif(m, '') AS BIGINT)) AS least, max(CAST(nullif(m, '') AS BIGINT)) AS most, round(avg(CAST(nullif(m, '') AS BIGINT)), 6) AS mean FROM x""")
def a21_log_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.nullif(F.regexp_extract("text", "([0-9]+) crowns", 1), F.lit("")).cast("long")
    return table(spark, sf_dir, "documents").select(m.alias("m")).agg(F.count("*").alias("docs"), F.count("m").alias("hits"), F.min("m").alias("least"), F.max("m").alias("most"), F.round(F.avg("m"), 6).alias("mean"))


@query("""WITH a AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT l_suppkey, CASE WHEN m <= 0.045 THEN 'pass' WHEN m <= 0.055 THEN 'partial' ELSE 'fail' END AS outcome FROM a""")
def a22_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"))
    return means.select("l_suppkey", reports.classify(F.col("m"), 0.045, 0.055).alias("outcome"))


@query("""WITH live AS (SELECT p_brand, avg(p_retailprice) AS live FROM part WHERE p_size > 25 GROUP BY ALL), past AS (SELECT p_brand, min(p_retailprice) AS best FROM part WHERE p_size <= 25 GROUP BY ALL)
SELECT p_brand, round(live, 6) AS live, best, round(live - best, 6) AS delta FROM live LEFT JOIN past USING (p_brand)""")
def a25_live_vs_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    means = part.groupBy("p_brand").agg(F.avg(F.when(F.col("p_size") > 25, F.col("p_retailprice"))).alias("live"), F.min(F.when(F.col("p_size") <= 25, F.col("p_retailprice"))).alias("best"))
    return means.where("live is not null").select("p_brand", F.round("live", 6).alias("live"), "best", F.round(F.col("live") - F.col("best"), 6).alias("delta"))


@query("""WITH a AS (SELECT p_brand, avg(p_retailprice) FILTER (p_size % 2 = 0) AS x, avg(p_retailprice) FILTER (p_size % 2 = 1) AS y FROM part GROUP BY ALL) SELECT p_brand, round(abs(x - y), 6) AS difference, abs(x - y) > 0.001 AS matters FROM a""")
def a27_setting_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    a = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(F.when(F.col("p_size") % 2 == 0, price)).alias("x"), F.avg(F.when(F.col("p_size") % 2 == 1, price)).alias("y"))
    return a.select("p_brand", F.round(F.abs(F.col("x") - F.col("y")), 6).alias("difference"), (F.abs(F.col("x") - F.col("y")) > 0.001).alias("matters"))


@query("""SELECT 'now' AS run, o_orderstatus AS setting, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY ALL UNION ALL SELECT * FROM (VALUES ('before', 'F', 150000.0), ('before', 'O', 150000.0), ('before', 'P', 180000.0)) v(run, setting, value)""")
def a29_history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("setting")).agg(F.round(F.avg("o_totalprice"), 2).alias("value")).select(F.lit("now").alias("run"), "setting", "value")
    return now.unionByName(spark.createDataFrame([("before", "F", 150000.0), ("before", "O", 150000.0), ("before", "P", 180000.0)], "run string, setting string, value double"))


@query("""SELECT user_id, event_id // 50 AS block, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL""")
def a30_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 50).alias("block")).agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5""")
def o2_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(5)


@query("""SELECT l_orderkey, l_linenumber, l_discount FROM lineitem ORDER BY l_discount, CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END, l_orderkey, l_linenumber LIMIT 1""")
def o3_best_tie_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return rows.orderBy("l_discount", F.when(F.col("l_linenumber") == 3, 0).otherwise(1), "l_orderkey", "l_linenumber").limit(1)


@query("""SELECT s_suppkey, 1 + (SELECT count(*) FROM supplier b WHERE (b.s_acctbal, b.s_suppkey) < (a.s_acctbal, a.s_suppkey)) AS place FROM supplier a WHERE s_suppkey = 7""")
def o4_rank_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The place of one row is a count of those before it: no sort, no window over all rows.
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    one = F.broadcast(rows.where("s_suppkey = 7").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b")))  # one row
    ahead = rows.join(one, (F.col("s_acctbal") < F.col("b")) | ((F.col("s_acctbal") == F.col("b")) & (F.col("s_suppkey") < F.col("k"))), "right")
    return ahead.groupBy(F.col("k").alias("s_suppkey")).agg((F.count("s_suppkey") + 1).alias("place"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_linestatus = 'F'), v AS (SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_returnflag = 'R')
SELECT t.*, v.l_tax FROM t LEFT JOIN v USING (l_orderkey, l_linenumber)""")
def j14_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    train = rows.where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_discount")
    return train.join(rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_tax"), ["l_orderkey", "l_linenumber"], "left")


@query("""SELECT n_name, r_name, p AS o_orderpriority FROM nation, region, (SELECT DISTINCT o_orderpriority AS p FROM orders)""")
def j15_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = (table(spark, sf_dir, t) for t in ("nation", "region"))
    return n.select("n_name").crossJoin(r.select("r_name")).crossJoin(table(spark, sf_dir, "orders").select("o_orderpriority").distinct())  # a grid of parameters


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def j16_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return reports.outstanding(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), done, ["o_orderkey"])


@query("""SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem""")
def u7_done_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query(r"""WITH t AS (SELECT DISTINCT regexp_replace(file_name, '(_\d{8}_\d{6})?\.\w+$', '') AS stem FROM ablation_raw),
d AS (SELECT split_part(json_extract_string(raw, '$.run_id'), '-', 1) AS stem, count(*) AS runs FROM ablation_raw WHERE file_name LIKE '%.jsonl' AND json_valid(raw) AND json_extract_string(raw, '$.run_id') IS NOT NULL GROUP BY 1)
SELECT t.stem, d.runs, d.stem IS NULL AS missing FROM t LEFT JOIN d USING (stem)""")
def j17_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the stem of their name, and the runs whose id begins with it; a file without such runs is missing them."""
    rows = table(spark, sf_dir, "ablation_raw")
    stems = rows.select(F.regexp_replace("file_name", r"(_\d{8}_\d{6})?\.\w+$", "").alias("stem")).distinct()
    parsed = F.from_json("raw", "run_id string, bad string", {"columnNameOfCorruptRecord": "bad"})
    lines = rows.where("file_name like '%.jsonl'").select(parsed.alias("r")).where("r.bad is null and r.run_id is not null")
    runs = lines.select(F.split_part("r.run_id", F.lit("-"), F.lit(1)).alias("stem")).groupBy("stem").agg(F.count("*").alias("runs"))
    return stems.join(runs, "stem", "left").select("stem", "runs", F.col("runs").isNull().alias("missing"))


@query("""WITH d AS (SELECT doc_id, text, trim(lower(source)) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_matches(rtrim(text, ' '), '[.?!…]$') AS ends, trim(lower(regexp_replace(s, '[^a-zA-Z0-9]', '_', 'g')), '_') AS slug, '''' || replace(s, '''', '''''') || '''' AS literal FROM d""")
def fn16_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("s", F.trim(F.lower("source")))
    return rows.select("doc_id", text.ends_sentence(F.col("text")).alias("ends"), text.slug(F.col("s")).alias("slug"), text.sql_literal(F.col("s")).alias("literal"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN '–' ELSE format('{:.1f}%', o_totalprice / 1000000 * 100) END AS share, CASE WHEN o_totalprice IS NULL THEN '–' ELSE format('{:+.3f}', o_totalprice - 150000) END AS delta FROM orders""")
def fn27_report_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.percent(price / 1_000_000).alias("share"), text.signed(price - 150_000).alias("delta"))


@query("""SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'memory' WHEN 1 THEN 'sqlite' WHEN 2 THEN 'postgresql' ELSE NULL END AS scheme FROM embeddings""")
def fn26_url_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = F.array(*[F.lit(u) for u in ("Memory://", "sqlite:///x.db", "POSTGRESQL://h/d", "mysql://h/d", "no address")])
    return table(spark, sf_dir, "embeddings").select("vec_id", text.url_scheme(F.element_at(urls, (F.col("vec_id") % 5 + 1).cast("int"))).alias("scheme"))


@query("""SELECT event_id, to_json({'type': event_type, 'user': user_id, 'at': epoch_us(ts)}) AS message FROM events""")
def k6_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")))
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"))


QUERIES, ORACLE = query.queries, query.oracle
