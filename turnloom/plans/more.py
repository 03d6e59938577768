"""Queries of sources and sinks, PCM, set operations, tiers and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pcm, vector
from ..operators import joins, reports
from ..operators.clustering import SCHEDULERS
from ..session import cut, table
from ..sources import audio, messages, rttm
from .conversation import FINALS, RECORDS, SEGMENTS, events, finals, first_rows, segments
from .registry import Registry
from .vectors import _C, _KNOWN, _U, _USABLE, _known, _units, usable_segments

query = Registry()


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts of events as bytes: stand-ins for chunks of samples."""
    return table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-8").alias("pcm"), "user_id")


@query("""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'not mono' WHEN user_id % 11 = 0 THEN 'not 16 kHz' WHEN octet_length(encode(props)) % 2 = 1 THEN 'odd number of bytes' END AS problem, octet_length(encode(props)) / 32000.0::DOUBLE AS seconds FROM events""")
def fn3_pcm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bytes(spark, sf_dir)
    rate, channels = F.when(F.col("user_id") % 11 == 0, 8_000).otherwise(16_000), F.when(F.col("user_id") % 7 == 0, 2).otherwise(1)
    return rows.select("event_id", pcm.check_pcm(F.col("pcm"), rate, channels).alias("problem"), pcm.seconds(F.col("pcm")).alias("seconds"))


@query("""SELECT event_id, ord(props[1]) + 256 * ord(props[2]) AS first, ord(props[3]) + 256 * ord(props[4]) AS second FROM events WHERE octet_length(encode(props)) % 2 = 0""")
def fn1_pcm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bytes(spark, sf_dir).where("octet_length(pcm) % 2 = 0")
    values = rows.select("event_id", pcm.samples(F.col("pcm")).alias("x"))
    return values.select("event_id", F.col("x")[0].alias("first"), F.col("x")[1].alias("second"))


@query("""SELECT event_id, substr(props, 3, 2) AS cut FROM events""")
def fn22_time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pcm.time_slice(F.col("pcm"), F.lit(10.0), F.lit(10.0 + 1 / 16000), F.lit(10.0 + 2 / 16000))
    return _bytes(spark, sf_dir).select("event_id", F.decode(cut, "UTF-8").alias("cut"))


@query("""SELECT event_id, '{"message_type":"input_audio_chunk","audio_base_64":"' || base64(encode(props)) || '"}' AS message FROM events""")
def fn25_audio_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("event_id", pcm.audio_message(F.col("pcm")).alias("message"))


@query(f"""WITH {SEGMENTS} SELECT printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', session_id, s / 1000, (e - s) / 1000, label) AS value FROM g""")
def k1_rttm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    return rttm.rttm_lines(rows.select(F.col("session_id").alias("uri"), (F.col("s") / 1000).alias("t_start"), (F.col("e") / 1000).alias("t_end"), F.col("label").alias("speaker")))


@query(f"""WITH {SEGMENTS} SELECT session_id AS uri, round(s / 1000, 3) AS t_start, round(e / 1000, 3) AS t_end, label AS speaker FROM g""")
def s8_rttm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = rttm.parse_rttm(k1_rttm_lines(spark, sf_dir))
    return turns.select("uri", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), "speaker")


@query("""WITH d AS (SELECT DISTINCT candidate_id, utterance_ids FROM speaker_candidate) SELECT candidate_id, unnest(utterance_ids) AS utterance_id, generate_subscripts(utterance_ids, 1) AS place FROM d""")
def s13_parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "speaker_candidate").select("candidate_id", "utterance_ids").distinct()
    place = F.transform("utterance_ids", lambda _, i: (i + 1).cast("long"))
    zipped = once.select("candidate_id", F.explode(F.arrays_zip(F.col("utterance_ids").alias("u"), place.alias("p"))).alias("z"))
    return zipped.select("candidate_id", F.col("z.u").alias("utterance_id"), F.col("z.p").alias("place"))


@query("""SELECT transcript_id, is_final, text, CASE WHEN is_final THEN t_start END AS t_start, CASE WHEN is_final THEN coalesce(t_end, t_start) END AS t_end FROM """ + RECORDS + """ WHERE is_final IS NOT NULL AND trim(coalesce(text, ''), ' ') <> ''""")
def s14_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_rows(spark, sf_dir, "transcript").where("is_final is not null")
    word = F.struct(F.lit("word").alias("type"), F.col("text"), F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    final = F.to_json(F.struct(F.lit("committed_transcript_with_timestamps").alias("message_type"), F.array(word).alias("words")))
    partial = F.to_json(F.struct(F.lit("partial_transcript").alias("message_type"), F.col("text")))
    return messages.parse_messages(rows.select("transcript_id", F.when(F.col("is_final"), final).otherwise(partial).alias("raw")))


@query("""SELECT DISTINCT json_extract_string(raw, '$.sample') AS sample, json_extract_string(raw, '$.scheduler') AS scheduler FROM ablation_raw
WHERE file_name LIKE '%.jsonl' AND json_valid(raw) AND json_extract_string(raw, '$.error') IS NULL AND json_extract_string(raw, '$.sample') IS NOT NULL AND json_extract_string(raw, '$.scheduler') IS NOT NULL""")
def s15_done_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("raw", "sample string, scheduler string, error string, bad string", {"columnNameOfCorruptRecord": "bad"})
    rows = table(spark, sf_dir, "ablation_raw").where("file_name like '%.jsonl'").select(parsed.alias("r"))
    return rows.where("r.bad is null and r.error is null and r.sample is not null and r.scheduler is not null").select("r.sample", "r.scheduler").distinct()


_CELLS = r"""list_transform(regexp_extract_all(raw || ',', '(?:"(?:[^"]|"")*"|[^",]*),'), lambda c: replace(regexp_replace(c[:-2], '^"(.*)"$', '\1'), '""', '"'))"""


@query(f"""WITH once AS (SELECT file_name, line_no, max(raw) AS raw FROM ablation_raw GROUP BY ALL),
h AS (SELECT file_name, {_CELLS} AS names FROM once WHERE file_name LIKE '%.csv' AND line_no = 1), c AS (SELECT file_name, line_no, {_CELLS} AS cells FROM once WHERE file_name LIKE '%.csv' AND line_no > 1),
r AS (SELECT c.file_name, line_no, TRY_CAST(cells[list_position(names, 'der')] AS DOUBLE) AS der FROM c JOIN h USING (file_name) WHERE len(cells) = len(names)
  UNION ALL SELECT file_name, line_no, TRY_CAST(json_extract_string(raw, '$..der')[1] AS DOUBLE) FROM once WHERE file_name LIKE '%.jsonl' AND json_valid(raw) AND json_type(raw) = 'OBJECT')
SELECT file_name, count(*) AS runs, round(sum(coalesce(der, 0.0)), 6) AS der, count(der) AS stated FROM r GROUP BY file_name""")
def s12_metric_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error rate of every run of CSV and JSON files, by the field's name wherever it is; 0.0 where it is missing or no number."""
    runs = messages.metric_of_lines(table(spark, sf_dir, "ablation_raw"), "der")
    return runs.groupBy("file_name").agg(F.count("*").alias("runs"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 6).alias("der"), F.count("value").alias("stated"))


@query("""SELECT to_json({'user_id': user_id, 'event_type': event_type, 'n': count(*)}) AS value FROM events GROUP BY user_id, event_type""")
def k2_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.to_json(F.struct("user_id", "event_type", "n")).alias("value"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS rows, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL""")
def k3_flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.struct(F.count("*").alias("rows"), F.round(F.avg("o_totalprice"), 4).alias("mean")).alias("metrics"))
    return messages.flatten_results(nested)


@query(f"""WITH {_C}, s AS (SELECT vec_id, who, list_dot_product(u, c) AS s FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, who) AS k FROM s WHERE s >= 0.1)
SELECT vec_id, CAST(who AS INT) AS center FROM r WHERE k = 1""")
def j4_online_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    known = vector.centroids(units, ["label"], "u").select(F.col("label").alias("center"), "centroid")
    return joins.nearest_vector(units, known, "vec_id", "u", "center", "centroid", 0.1).select("vec_id", "center")


@query(f"""WITH {_U}, n AS (SELECT * FROM u WHERE vec_id % 20 = 0), s AS (SELECT n.vec_id, k.vec_id AS near, list_dot_product(n.u, k.u) AS s FROM n, u k WHERE n.vec_id <> k.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near) AS i FROM s) SELECT vec_id, near, round(s, 6) AS similarity FROM r WHERE i = 1""")
def j6_nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every twentieth row, against all rows but itself."""
    units = _units(spark, sf_dir)
    known = units.select(F.col("vec_id").alias("near"), F.col("u").alias("k"))
    found = joins.nearest_vector(units.where("vec_id % 20 = 0"), known, "vec_id", "u", "near", "k", -2.0, not_itself=True)
    return found.select("vec_id", "near", F.round("similarity", 6).alias("similarity"))


@query("""SELECT segment_id, first_value(label IGNORE NULLS) OVER (PARTITION BY session_id, utterance_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cached FROM speaker_segment""")
def j13_label_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Window.partitionBy("session_id", "utterance_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "speaker_segment").select("segment_id", F.first("label", ignorenulls=True).over(line).alias("cached"))


@query(f"""WITH {SEGMENTS}, x AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY session_id, label ORDER BY s, segment_id) <= 1000 THEN 0 ELSE 1 END AS o FROM g),
i AS (SELECT *, sum(o) OVER (PARTITION BY session_id, label ORDER BY s, segment_id ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT session_id, label, min(s) AS s, round(avg(confidence), 12) AS confidence, count(*) AS segments FROM i GROUP BY session_id, label, k""")
def a11_run_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequence import sliced_islands

    runs = sliced_islands(segments(spark, sf_dir), ["session_id", "label"], ["s", "segment_id"], ["e"], lambda before: F.col("s") - before("e") > 1000, 3_600_000)
    return runs.groupBy("session_id", "label", "island").agg(F.min("s").alias("s"), F.round(F.avg("confidence"), 12).alias("confidence"), F.count("*").alias("segments")).drop("island")


@query(f"""WITH {SEGMENTS} SELECT session_id, count(DISTINCT label) FILTER (label LIKE 'stored:%') AS stored, count(DISTINCT label) FILTER (label LIKE 'registered:%') AS registered, count(DISTINCT label) FILTER (label LIKE 'auto:%') AS auto FROM g GROUP BY session_id""")
def a31_labels_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.countDistinct(F.when(F.col("label").startswith(f"{k}:"), F.col("label"))).alias(k)
    return segments(spark, sf_dir).groupBy("session_id").agg(kind("stored"), kind("registered"), kind("auto"))


@query("""SELECT DISTINCT label FROM embeddings WHERE label <> 9 ORDER BY label""")
def u2_cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label").distinct().where("label != 9").orderBy("label")


@query("""SELECT DISTINCT model_id FROM speaker_segment ORDER BY model_id""")
def u3_distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speaker_segment").select("model_id").distinct().orderBy("model_id")


@query(f"""WITH {_C}, l2 AS (SELECT vec_id % 7 AS k, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM u), m2 AS (SELECT k, p, avg(x) AS x FROM l2 GROUP BY ALL), v2 AS (SELECT k, list(x ORDER BY p) AS v FROM m2 GROUP BY k),
a AS (SELECT 0 AS source, CAST(who AS BIGINT) AS k, c FROM c UNION ALL SELECT 1, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) FROM v2),
s AS (SELECT u.vec_id, source, k, list_dot_product(u, a.c) AS s FROM u, a), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, source, k) AS i FROM s) SELECT vec_id, CAST(source AS INT) AS source, k AS center FROM r WHERE i = 1""")
def u4_both_center_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against two sets of centres, those of the labels and those of seven groups; at equal similarity the first set goes first."""
    units = _units(spark, sf_dir).withColumn("group", F.col("vec_id") % 7)

    def centres(by: str, source: int) -> DataFrame:
        who = F.struct(F.lit(source).alias("source"), F.col(by).cast("long").alias("k"))
        return vector.centroids(units, [by], "u").select(who.alias("who"), F.col("centroid").alias("c"))

    found = joins.nearest_vector(units, centres("label", 0).unionByName(centres("group", 1)), "vec_id", "u", "who", "c", -2.0)
    return found.select("vec_id", "who.source", F.col("who.k").alias("center"))


@query("""SELECT transcript_id AS id, t_start FROM """ + RECORDS + """ WHERE is_final UNION ALL SELECT transcript_id, t_start FROM """ + RECORDS + """ WHERE NOT is_final""")
def u5_queued_and_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_rows(spark, sf_dir, "transcript").select(F.col("transcript_id").alias("id"), "t_start", "is_final")
    return rows.where("is_final").unionByName(rows.where("not is_final")).drop("is_final")


@query("""SELECT session_id FROM speaker_segment INTERSECT SELECT session_id FROM seg_label""")
def u6_common_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speaker_segment").select("session_id").intersect(table(spark, sf_dir, "seg_label").select("session_id"))


@query("""SELECT * FROM (VALUES ('baseline', 0.6::DOUBLE, 0.3::DOUBLE, 1.0::DOUBLE, ''), ('decay-A', 0.5, 0.5, 0.8, ''), ('decay-B', 0.7, 0.1, 1.2, ''), ('hdbscan-off', 0.6, 0.3, 1.0, ''), ('hdbscan-on', 0.6, 0.3, 1.0, 'final'),
('legacy-adaptive', 0.6, 0.3, 1.0, 'adaptive'), ('legacy-final', 0.6, 0.3, 1.0, 'final'), ('legacy-both', 0.6, 0.3, 1.0, 'adaptive final')) v(scheduler, tau_active, rho_update, delta_new, post)""")
def c8_schedulers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings the operators take: ``online_labels`` the first three, ``post_pass`` the last."""
    rows = [(name, *values, " ".join(post)) for name, (*values, post) in SCHEDULERS.items()]
    return spark.createDataFrame(rows, "scheduler string, tau_active double, rho_update double, delta_new double, post string")


@query(f"""WITH t AS (SELECT * FROM {RECORDS}), m AS (SELECT session_id, min(epoch_us(ingest_ts)) AS lo FROM t GROUP BY ALL),
x AS (SELECT t.session_id, (epoch_us(ingest_ts) - lo) / 1e6 - t_end AS late FROM t JOIN m USING (session_id) WHERE is_final AND t_start IS NOT NULL AND t_end > t_start)
SELECT session_id, round(quantile_cont(late, 0.5), 4) AS p50, round(quantile_cont(late, 0.95), 4) AS p95 FROM x GROUP BY session_id""")
def m4_emit_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the clock, started with a session's first delivery, is ahead of the end of what is emitted; below zero: not yet spoken."""
    rows = first_rows(spark, sf_dir, "transcript")
    first = rows.groupBy("session_id").agg(F.min(F.unix_micros("ingest_ts")).alias("lo"))
    late = (F.unix_micros("ingest_ts") - F.col("lo")) / 1e6 - F.col("t_end")
    return rows.where("is_final and t_start is not null and t_end > t_start").join(first, "session_id").groupBy("session_id").agg(F.round(F.percentile(late, 0.5), 4).alias("p50"), F.round(F.percentile(late, 0.95), 4).alias("p95"))


@query("""WITH b AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), a AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
w AS (SELECT user_id, (SELECT min(a.us) FROM a WHERE a.user_id = b.user_id AND a.us >= b.us) - us AS w FROM b), l AS (SELECT user_id, list_sort(list(w)) AS v FROM w WHERE w IS NOT NULL GROUP BY ALL)
SELECT user_id, v[CAST(round_even((len(v) - 1) * 0.5, 0) AS INT) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS INT) + 1] AS p95 FROM l""")
def m5_live_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation import j9_latency_asof

    waits = j9_latency_asof(spark, sf_dir).join(events(spark, sf_dir).select("event_id", "user_id"), "event_id").where("wait_us is not null")
    return waits.groupBy("user_id").agg(reports.nearest_rank(F.col("wait_us"), 50).alias("p50"), reports.nearest_rank(F.col("wait_us"), 95).alias("p95"))


@query(f"""WITH {FINALS} SELECT transcript_id, ps FROM f ORDER BY ps, transcript_id""")
def o5_first_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finals(spark, sf_dir).select("transcript_id", "ps").orderBy("ps", "transcript_id")


@query("""SELECT origin, count(*) AS profiles, CAST(sum(utterance_count) AS BIGINT) AS utterances, count(registered_at) AS registered FROM (SELECT DISTINCT * FROM speaker) GROUP BY origin""")
def st5_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "speaker").distinct()
    return rows.groupBy("origin").agg(F.count("*").alias("profiles"), F.sum("utterance_count").alias("utterances"), F.count("registered_at").alias("registered"))


@query("""SELECT name, model_id, count(*) AS copies FROM speaker GROUP BY ALL HAVING count(*) > 1""")
def st6_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speaker").groupBy("name", "model_id").agg(F.count("*").alias("copies")).where("copies > 1")


@query("""SELECT speaker_id, name FROM (SELECT DISTINCT speaker_id, name FROM speaker) s WHERE speaker_id NOT IN (SELECT speaker_id FROM speaker_vss WHERE speaker_id IS NOT NULL)""")
def st8_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "speaker").select("speaker_id", "name").distinct()
    return s.join(table(spark, sf_dir, "speaker_vss").where("speaker_id is not null").select("speaker_id"), "speaker_id", "left_anti")



_TIER = f"""WITH {_USABLE}, {_KNOWN}, p AS (SELECT * FROM g WHERE label LIKE 'auto:%'), s AS (SELECT p.segment_id, k.who, k.origin, list_dot_product(p.u, k.c) AS s FROM p JOIN k USING (model_id)),
b AS (SELECT segment_id, who FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY origin, s DESC, who) AS r FROM s WHERE s >= CASE WHEN origin = 'registered' THEN 0.70 ELSE 0.75 END) WHERE r = 1),
m AS (SELECT p.session_id, p.label, min((p.t_start, p.segment_id, b.who)) AS m FROM p JOIN b USING (segment_id) GROUP BY ALL),
x AS (SELECT p.segment_id, p.session_id, CASE WHEN (p.t_start, p.segment_id) >= (m.m[1], m.m[2]) THEN m.m[3] ELSE p.label END AS new_label, CASE WHEN (p.t_start, p.segment_id) < (m.m[1], m.m[2]) THEN m.m[3] END AS changed_to FROM p LEFT JOIN m USING (session_id, label))"""


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.identify import matched_labels

    probes = usable_segments(spark, sf_dir).where(F.col("label").startswith("auto:")).select("session_id", "segment_id", "label", "t_start", "model_id", F.col("u").alias("u"))
    known = cut(_known(spark, sf_dir))
    pick = lambda origin: known.where(F.col("origin") == origin).select("model_id", "who", "c")
    found = joins.three_tiers(probes, pick("registered"), pick("stored"), "segment_id", "u", "who", "c", on=["model_id"])
    matched = probes.join(found.select("segment_id", F.col("who").alias("match")), "segment_id", "left")
    return matched_labels(matched.withColumn("at", F.struct("t_start", "segment_id")), "session_id", "at", "segment_id", "label", "match")


@query(_TIER + " SELECT segment_id, new_label AS label, changed_to FROM x")
def t7_tier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unnamed voices against the current centroids of all registered and stored speakers."""
    return _tiers(spark, sf_dir).select("segment_id", "label", "changed_to")


@query(_TIER + " SELECT session_id, new_label AS old_label, changed_to AS new_label, count(*) AS n, 'stored_match' AS reason FROM x WHERE changed_to IS NOT NULL GROUP BY ALL")
def t7_label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.identify import label_changes

    found = label_changes(_tiers(spark, sf_dir), "session_id", "at", "segment_id")
    return found.select("session_id", "old_label", "new_label", F.size("ids").cast("long").alias("n"), "reason")


@query("""SELECT event_id, round(cos(-2 * pi() * value * (user_id % 5) * 0.05 / 343), 9) + 0.0 AS re, round(sin(-2 * pi() * value * (user_id % 5) * 0.05 / 343), 9) + 0.0 AS im FROM events""")
def s7_steering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphones on a line, 5 cm apart, and a wave that comes along it."""
    phase = audio.steering_of(F.array((F.col("user_id") % 5) * 0.05, F.lit(0.0), F.lit(0.0)), F.col("value"), [1.0, 0.0, 0.0])
    rows = table(spark, sf_dir, "events").select("event_id", phase.alias("p"))
    return rows.select("event_id", (F.round("p.re", 9) + 0.0).alias("re"), (F.round("p.im", 9) + 0.0).alias("im"))


@query(f"""WITH {SEGMENTS}, w AS (SELECT min(session_id) AS first, max(CASE WHEN session_id = 'live-standing-room' THEN session_id END) AS asked FROM g)
SELECT segment_id, greatest(s, 60000) - 60000 AS s, least(e, 180000) - 60000 AS e FROM g, w WHERE session_id = coalesce(asked, first) AND least(e, 180000) > greatest(s, 60000)""")
def s10_reference_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice of one recording: the one asked for, or the first if there is none of that name."""
    from ..functions.interval import clip

    rows = segments(spark, sf_dir)
    uri = F.broadcast(rows.agg(F.min("session_id").alias("first"), F.max(F.when(F.col("session_id") == "live-standing-room", F.col("session_id"))).alias("asked")))  # one row
    s, e, left = clip(F.col("s"), F.col("e"), F.lit(60_000).cast("long"), F.lit(180_000).cast("long"))
    own = rows.join(uri, F.col("session_id") == F.coalesce("asked", "first"))
    return own.where(left).select("segment_id", (s - 60_000).alias("s"), (e - 60_000).alias("e"))


QUERIES, ORACLE = query.queries, query.oracle
