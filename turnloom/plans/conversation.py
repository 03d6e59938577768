"""Queries over transcripts, labels and segments: joins by time, sequences, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interval, labels, pcm, text
from ..operators import joins, sequence
from ..operators.deliveries import first_delivery
from ..session import table
from ..sources import audio
from .registry import Registry
from .training import clean_sql

query = Registry()
MICROS = 1_000_000


def _us(c: str) -> F.Column:
    return F.round(F.col(c) * MICROS).cast("long")


def first_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The first deliveries of ``transcript`` or ``speaker_segment``, with all columns but the vectors."""
    keys, id_ = (["session_id", "seq"], "transcript_id") if name == "transcript" else (["session_id", "utterance_id"], "segment_id")
    rows = table(spark, sf_dir, name)
    return first_delivery(rows, keys, id_, {c: F.col(c) for c in rows.columns if c not in (id_, "embedding")})


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final transcript records with an interval, in microseconds."""
    rows = first_rows(spark, sf_dir, "transcript").where("is_final and t_start is not null and t_end > t_start")
    return rows.select("session_id", "transcript_id", "seq", "text", _us("t_start").alias("ps"), _us("t_end").alias("pe"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``seg_label`` with a named speaker and an interval, in microseconds."""
    rows = table(spark, sf_dir, "seg_label").where("t_start is not null and t_end > t_start")
    named = rows.select("session_id", "seg_id", labels.clean_label(F.col("speaker_id")).alias("label"), _us("t_start").alias("ss"), _us("t_end").alias("se"))
    return named.where("label is not null")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a named speaker and an interval, in milliseconds."""
    rows = first_rows(spark, sf_dir, "speaker_segment").where("t_start is not null and t_end > t_start")
    named = rows.select("session_id", "segment_id", "confidence", labels.clean_label(F.col("label")).alias("label"),
                        F.round(F.col("t_start") * 1000).cast("long").alias("s"), F.round(F.col("t_end") * 1000).cast("long").alias("e"))
    return named.where("label is not null")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


RECORDS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY transcript_id) AS delivery FROM transcript) WHERE delivery = 1)"
UTTERANCES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, utterance_id ORDER BY segment_id) AS delivery FROM speaker_segment) WHERE delivery = 1)"
FINALS = f"f AS (SELECT session_id, transcript_id, seq, text, CAST(round(t_start * 1000000) AS BIGINT) AS ps, CAST(round(t_end * 1000000) AS BIGINT) AS pe FROM {RECORDS} WHERE is_final AND t_start IS NOT NULL AND t_end > t_start)"
TURNS = f"t AS (SELECT session_id, seg_id, clean AS label, CAST(round(t_start * 1000000) AS BIGINT) AS ss, CAST(round(t_end * 1000000) AS BIGINT) AS se FROM {clean_sql('seg_label', 'speaker_id')} WHERE clean IS NOT NULL AND t_start IS NOT NULL AND t_end > t_start)"
SEGMENTS = f"g AS (SELECT session_id, segment_id, confidence, clean AS label, CAST(round(t_start * 1000) AS BIGINT) AS s, CAST(round(t_end * 1000) AS BIGINT) AS e FROM {clean_sql(UTTERANCES, 'label')} WHERE clean IS NOT NULL AND t_start IS NOT NULL AND t_end > t_start)"


@query(f"""WITH {FINALS}, {TURNS},
o AS (SELECT transcript_id, label, sum(least(pe, se) - greatest(ps, ss)) AS ov, min(ss) AS first FROM f JOIN t ON f.session_id = t.session_id AND ps < se AND ss < pe GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY ov DESC, first, label) AS k FROM o)
SELECT f.transcript_id, coalesce(r.label, 'unknown') AS label, CAST(coalesce(ov, 0) AS BIGINT) AS overlap FROM f LEFT JOIN r ON f.transcript_id = r.transcript_id AND k = 1""")
def j7_dominant_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.dominant_overlap(finals(spark, sf_dir), turns(spark, sf_dir), ["session_id"], "transcript_id", ("ps", "pe"), ("ss", "se"), "label", 10 * MICROS)


@query(f"""WITH {FINALS}, {TURNS}
SELECT f.transcript_id, t.seg_id, CAST(least(pe, se) - greatest(ps, ss) AS BIGINT) AS shared FROM f JOIN t ON f.session_id = t.session_id AND ps < se AND ss < pe""")
def fn15_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = joins.interval_join(finals(spark, sf_dir), turns(spark, sf_dir), ["session_id"], ("ps", "pe"), ("ss", "se"), 10 * MICROS)
    return pairs.select("transcript_id", "seg_id", interval.overlap(F.col("ps"), F.col("pe"), F.col("ss"), F.col("se")).alias("shared"))


@query(f"""WITH {FINALS}, {TURNS}
SELECT f.transcript_id, t.label, t.ss FROM f ASOF LEFT JOIN (SELECT session_id, ss, max(label) AS label FROM t GROUP BY ALL) t ON f.session_id = t.session_id AND f.ps >= t.ss""")
def j8_last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = finals(spark, sf_dir).select("session_id", "transcript_id", F.col("ps").alias("at"))
    right = turns(spark, sf_dir).select("session_id", F.col("ss").alias("at"), "label", "ss")
    return joins.asof(left, right, ["session_id"], "at", ["label", "ss"], chunk=600 * MICROS).select("transcript_id", "label", "ss")


@query("""WITH b AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), a AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
m AS (SELECT event_id, b.us, (SELECT min(a.us) FROM a WHERE a.user_id = b.user_id AND a.us >= b.us) AS nx FROM b)
SELECT event_id, CAST(nx - us AS BIGINT) AS wait_us FROM m""")
def j9_latency_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = events(spark, sf_dir)
    left = all_.where("event_type = 'purchase'").select("user_id", "us", "event_id")
    right = all_.where("event_type = 'view'").select("user_id", "us", F.col("us").alias("seen"))
    found = joins.asof(left, right, ["user_id"], "us", ["seen"], forward=True, chunk=86_400 * MICROS)
    return found.select("event_id", (F.col("seen") - F.col("us")).alias("wait_us"))


@query(f"""WITH {TURNS}, {SEGMENTS}, h AS (SELECT session_id, label AS hyp, s * 1000 AS hs, e * 1000 AS he FROM g)
SELECT t.session_id, t.label AS ref, h.hyp, count(*) AS pairs, CAST(sum(least(se, he) - greatest(ss, hs)) AS BIGINT) AS together
FROM t JOIN h ON t.session_id = h.session_id AND ss < he AND hs < se GROUP BY ALL""")
def j10_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = turns(spark, sf_dir).withColumnRenamed("label", "ref")
    hyp = segments(spark, sf_dir).select("session_id", F.col("label").alias("hyp"), (F.col("s") * 1000).alias("hs"), (F.col("e") * 1000).alias("he"))
    pairs = joins.interval_join(ref, hyp, ["session_id"], ("ss", "se"), ("hs", "he"), 10 * MICROS)
    shared = interval.overlap(F.col("ss"), F.col("se"), F.col("hs"), F.col("he"))
    return pairs.groupBy("session_id", "ref", "hyp").agg(F.count("*").alias("pairs"), F.sum(shared).alias("together"))


@query(f"""WITH {TURNS}, {SEGMENTS}, h AS (SELECT session_id, label AS hyp, s * 1000 AS hs, e * 1000 AS he FROM g),
c AS (SELECT t.session_id, t.label AS ref, h.hyp, sum(least(se, he) - greatest(ss, hs)) AS w FROM t JOIN h ON t.session_id = h.session_id AND ss < he AND hs < se GROUP BY ALL),
s AS (SELECT session_id, ref, max(w) / sum(w) AS share FROM c GROUP BY ALL)
SELECT session_id, round(avg(share), 6) AS consistency, count(*) AS speakers FROM s GROUP BY session_id""")
def a7_label_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = j10_cooccurrence(spark, sf_dir)
    share = both.groupBy("session_id", "ref").agg((F.max("together") / F.sum("together")).alias("share"))
    return share.groupBy("session_id").agg(F.round(F.avg("share"), 6).alias("consistency"), F.count("*").alias("speakers"))


@query(f"""WITH {SEGMENTS}, w AS (SELECT *, s // 100 AS frame FROM g), x AS (SELECT DISTINCT session_id, label, s // 1000 AS frame FROM g),
n AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY session_id, label ORDER BY frame) <= 10 THEN 0 ELSE 1 END AS o FROM x),
i AS (SELECT *, sum(o) OVER (PARTITION BY session_id, label ORDER BY frame) AS k FROM n)
SELECT session_id, label, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames FROM i GROUP BY session_id, label, k""")
def w1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = segments(spark, sf_dir).select("session_id", "label", F.floor(F.col("s") / 1000).alias("frame")).distinct()
    return sequence.active_runs(frames, ["session_id", "label"], "frame", 10)


@query(f"""WITH {TURNS}, x AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS o FROM t WINDOW w AS (PARTITION BY session_id ORDER BY ss, seg_id)),
i AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY ss, seg_id ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT session_id, min(label) AS label, min(ss) AS ss, max(se) AS se, string_agg(CAST(seg_id AS VARCHAR), ' ' ORDER BY ss, seg_id) AS ids, count(*) AS parts FROM i GROUP BY session_id, k""")
def w2_merge_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("ids", F.col("seg_id").cast("string"))
    return sequence.merge_consecutive(rows, ["session_id"], ["ss", "seg_id"], "label", "ss", "se", "ids", 600 * MICROS)


@query(f"""WITH p AS (SELECT *, sum(CASE WHEN is_final THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq, transcript_id ROWS UNBOUNDED PRECEDING) AS phrase FROM {RECORDS} WHERE is_final IS NOT NULL),
f AS (SELECT session_id, phrase, transcript_id, coalesce(text, '') AS text, CAST(round(t_start * 1000000) AS BIGINT) AS ps, CAST(round(t_end * 1000000) AS BIGINT) AS pe FROM p WHERE is_final AND t_start IS NOT NULL AND t_end > t_start),
x AS (SELECT *, regexp_matches(rtrim(text), '[.?!…]$') AS sentence, lead(ps) OVER (PARTITION BY session_id, phrase ORDER BY ps, transcript_id) - pe > 300000 AS gap FROM f),
y AS (SELECT *, NOT sentence AND coalesce(gap, false) AS silence FROM x),
z AS (SELECT *, coalesce(sum(CAST(sentence OR silence AS INT)) OVER (PARTITION BY session_id, phrase ORDER BY ps, transcript_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
  CASE WHEN bool_or(sentence) OVER q AND bool_or(silence) OVER q THEN 'both' WHEN bool_or(sentence) OVER q THEN 'sentence' WHEN bool_or(silence) OVER q THEN 'silence' ELSE 'none' END AS reason FROM y WINDOW q AS (PARTITION BY session_id, phrase))
SELECT session_id, CAST(phrase AS BIGINT) AS phrase, CAST(part AS BIGINT) AS part, min(reason) AS reason, count(*) AS words, min(ps) AS ps, arg_max(pe, (ps, transcript_id)) AS pe FROM z GROUP BY session_id, phrase, part""")
def w3_subsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_rows(spark, sf_dir, "transcript").where("is_final is not null")
    words = sequence.phrase_numbers(rows, ["session_id"], ["seq", "transcript_id"], "is_final").where("t_start is not null and t_end > t_start")
    timed = words.select("session_id", "phrase", "transcript_id", F.coalesce("text", F.lit("")).alias("text"), _us("t_start").alias("ps"), _us("t_end").alias("pe"))
    parted = sequence.phrase_parts(timed, ["session_id", "phrase"], ["ps", "transcript_id"], "ps", "pe", "text", 300_000)
    return parted.groupBy("session_id", "phrase", "part").agg(
        F.min("reason").alias("reason"), F.count("*").alias("words"), F.min("ps").alias("ps"), F.max_by("pe", F.struct("ps", "transcript_id")).alias("pe")
    )


@query(f"""WITH {SEGMENTS}, x AS (SELECT session_id, unnest(range(s // 100, e // 100 + 1)) AS frame, segment_id, label FROM g),
m AS (SELECT session_id, frame, arg_max(label, segment_id) AS label FROM x GROUP BY ALL),
n AS (SELECT *, CASE WHEN label = lag(label) OVER w AND frame - lag(frame) OVER w = 1 THEN 0 ELSE 1 END AS o FROM m WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
i AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT session_id, min(label) AS label, min(frame) AS first_frame, max(frame) + 1 AS end_frame FROM i GROUP BY session_id, k""")
def w4_frame_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.last_write_runs(segments(spark, sf_dir), ["session_id"], "segment_id", "s", "e", "label", 100)


@query("""WITH d AS (SELECT event_id, user_id % 3 AS device, epoch_us(ts) AS seq, CASE WHEN event_type = 'error' AND value > 500 THEN NULL ELSE value END AS t FROM events),
k AS (SELECT *, max(coalesce(CAST(t AS DOUBLE), 'infinity')) OVER (PARTITION BY device ORDER BY seq, event_id ROWS UNBOUNDED PRECEDING) AS key FROM d)
SELECT event_id, row_number() OVER (ORDER BY key, device, seq, event_id) AS position FROM k""")
def w5_device_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 3).alias("device"), F.struct("us", "event_id").alias("seq"), F.when((F.col("event_type") != "error") | (F.col("value") <= 500), F.col("value")).alias("t"))
    return sequence.merged_order(rows, "device", "seq", "t").select("event_id", "position")


@query(f"""WITH {SEGMENTS}, p AS (SELECT session_id, s AS t, 1 AS d FROM g UNION ALL SELECT session_id, e, -1 FROM g), q AS (SELECT session_id, t, sum(d) AS d FROM p GROUP BY ALL),
r AS (SELECT *, sum(d) OVER (PARTITION BY session_id ORDER BY t) AS n, lead(t) OVER (PARTITION BY session_id ORDER BY t) - t AS l FROM q)
SELECT session_id, CAST(coalesce(sum(l) FILTER (n >= 1), 0) AS BIGINT) AS covered, CAST(coalesce(sum(l) FILTER (n >= 2), 0) AS BIGINT) AS overlapped, CAST(max(n) AS BIGINT) AS most FROM r GROUP BY session_id""")
def w6_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.covered_time(segments(spark, sf_dir), ["session_id"], "s", "e")


@query("""WITH x AS (SELECT *, sum(CASE WHEN is_final THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq, transcript_id ROWS UNBOUNDED PRECEDING) AS phrase FROM """ + RECORDS + """ WHERE is_final IS NOT NULL)
SELECT session_id, CAST(phrase AS BIGINT) AS phrase, min(t_start) AS t_start, max(t_end) AS t_end, string_agg(coalesce(text, ''), ' ' ORDER BY seq, transcript_id) AS text, count(*) AS finals FROM x WHERE is_final GROUP BY session_id, phrase""")
def w7_phrase_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_rows(spark, sf_dir, "transcript").where("is_final is not null").withColumn("text", F.coalesce("text", F.lit("")))
    found = sequence.assembled_phrases(rows, ["session_id"], ["seq", "transcript_id"], "is_final", "t_start", "t_end", "text")
    return found.withColumn("phrase", F.col("phrase").cast("long"))


@query(f"""WITH {SEGMENTS}, a AS (SELECT session_id, label, min((s, segment_id, e)) AS f FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY f) AS n FROM a),
d AS (SELECT DISTINCT session_id FROM g)
SELECT d.session_id, r.f[3] AS reached FROM d LEFT JOIN r ON d.session_id = r.session_id AND n = 2""")
def w8_initial_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.first_time_of_labels(segments(spark, sf_dir), ["session_id"], ["s", "segment_id"], "label", "e", 2)


@query("""SELECT segment_id, format('utt-{:03d}', row_number() OVER (PARTITION BY session_id ORDER BY ingest_ts, segment_id)) AS utterance FROM """ + UTTERANCES)
def w9_ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_rows(spark, sf_dir, "speaker_segment").select("segment_id", "session_id", "ingest_ts")
    placed = sequence.ordinals(rows.withColumn("at", F.unix_micros("ingest_ts")), ["session_id"], ["at", "segment_id"], "n", 600 * MICROS)
    return placed.select("segment_id", text.utterance_id(F.col("n")).alias("utterance"))


@query(f"""WITH {SEGMENTS}, x AS (SELECT *, CASE WHEN (e - s) / 1000 >= 0.3 OR row_number() OVER (PARTITION BY session_id ORDER BY s, segment_id) = 1 THEN label END AS own FROM g)
SELECT segment_id, last_value(own IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY s, segment_id ROWS UNBOUNDED PRECEDING) AS inherited FROM x""")
def w10_short_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    return sequence.inherited_labels(rows, ["session_id"], ["s", "segment_id"], "label", (F.col("e") - F.col("s")) / 1000).select("segment_id", "inherited")


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value >= 40 AS speech FROM events),
x AS (SELECT *, CASE WHEN speech = lag(speech) OVER (PARTITION BY user_id ORDER BY frame) THEN 0 ELSE 1 END AS o FROM f),
i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY frame) AS k FROM x),
r AS (SELECT user_id, k, min(frame) AS f, count(*) AS n, bool_or(speech) AS sp FROM i GROUP BY ALL),
z AS (SELECT *, max(CAST(sp AS INT)) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 AS aft FROM r)
SELECT user_id, CAST(f + 2 AS BIGINT) AS commit_frame FROM z WHERE NOT sp AND aft AND n >= 3""")
def w11_vad_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = events(spark, sf_dir).select("user_id", F.expr("row_number() over (partition by user_id order by us, event_id)").cast("long").alias("frame"), (F.col("value") >= 40).alias("speech"))
    return sequence.speech_commits(frames, ["user_id"], "frame", "speech", 3)


@query(f"""WITH {SEGMENTS} SELECT session_id, label, min((s, segment_id))[2] AS first_segment, row_number() OVER (PARTITION BY session_id ORDER BY min((s, segment_id))) AS formed FROM g GROUP BY session_id, label""")
def w12_first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = segments(spark, sf_dir).groupBy("session_id", "label").agg(F.min(F.struct("s", "segment_id")).alias("f"))
    return first.select("session_id", "label", F.col("f.segment_id").alias("first_segment"), F.expr("row_number() over (partition by session_id order by f)").cast("long").alias("formed"))


@query(f"""WITH {SEGMENTS}, c AS (SELECT unnest([30000, 60000, 9000000000]) AS stop), x AS (SELECT session_id, stop, label, s, least(e, stop) AS e FROM g, c WHERE s < stop)
SELECT session_id, CAST(stop AS BIGINT) AS stop, count(*) AS segments, count(DISTINCT label) AS labels, CAST(sum(e - s) AS BIGINT) AS spoken FROM x GROUP BY session_id, stop""")
def w13_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = F.explode(F.array(*[F.lit(x).cast("long") for x in (30_000, 60_000, 9_000_000_000)]))
    rows = segments(spark, sf_dir).withColumn("stop", stops).where("s < stop")
    _, end, _ = interval.clip(F.col("s"), F.col("e"), F.lit(0), F.col("stop"))
    return rows.groupBy("session_id", "stop").agg(F.count("*").alias("segments"), F.countDistinct("label").alias("labels"), F.sum(end - F.col("s")).alias("spoken"))


@query("""SELECT event_id, CAST(CASE WHEN value < 1 THEN 0.02 WHEN value < 3 THEN 0.05 ELSE 0.15 END AS DOUBLE) AS weight FROM events""")
def fn13_phrase_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", interval.phrase_weight(F.col("value")).alias("weight"))


@query(f"""WITH {SEGMENTS} SELECT segment_id, greatest(s, 60000) AS s, least(e, 120000) AS e FROM g WHERE least(e, 120000) > greatest(s, 60000)""")
def fn14_interval_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e, left = interval.clip(F.col("s"), F.col("e"), F.lit(60_000).cast("long"), F.lit(120_000).cast("long"))
    return segments(spark, sf_dir).where(left).select("segment_id", s.alias("s"), e.alias("e"))


@query("""SELECT segment_id, greatest(t_end - t_start, 0) AS duration, CASE WHEN greatest(t_end - t_start, 0) > 0 THEN t_end - t_start ELSE 1.0 END AS weight FROM """ + UTTERANCES + """ WHERE t_start IS NOT NULL AND t_end IS NOT NULL""")
def fn20_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_rows(spark, sf_dir, "speaker_segment").where("t_start is not null and t_end is not null")
    s, e = F.col("t_start"), F.col("t_end")
    return rows.select("segment_id", interval.duration(s, e).cast("double").alias("duration"), interval.duration_weight(s, e).cast("double").alias("weight"))


@query(f"""WITH {SEGMENTS} SELECT segment_id, unnest(range(s // 100, e // 100 + 1)) AS frame FROM g""")
def fn21_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("segment_id", F.explode(F.sequence(F.floor(F.col("s") / 100), F.floor(F.col("e") / 100))).alias("frame"))


@query("""SELECT event_id, round(value / 589 * 10, 9) AS t, CAST(floor(value / 589 * 160000) AS BIGINT) AS sample FROM events""")
def fn9_frame_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = interval.frame_to_time(F.col("value"), F.lit(589), F.lit(10))
    return table(spark, sf_dir, "events").select("event_id", F.round(t, 9).alias("t"), F.floor(F.col("value") / 589 * 160_000).alias("sample"))


@query("""WITH n AS (SELECT event_id, CAST(floor(value * 10000) AS BIGINT) AS n FROM events), w AS (SELECT event_id, n, CASE WHEN n >= 160000 THEN (n - 160000) // 16000 + 1 ELSE 0 END AS whole FROM n)
SELECT event_id, unnest(range(whole + CASE WHEN n - whole * 16000 > 0 THEN 1 ELSE 0 END)) * 16000 AS first_sample FROM w""")
def t1_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("value") * 10_000)
    return table(spark, sf_dir, "events").select("event_id", F.explode(pcm.window_offsets(n, 160_000, 16_000)).alias("first_sample"))


@query("""WITH n AS (SELECT event_id, CAST(floor(value * 10000) AS BIGINT) AS n FROM events), w AS (SELECT *, CASE WHEN n >= 160000 THEN (n - 160000) // 16000 + 1 ELSE 0 END AS whole FROM n)
SELECT event_id, whole * 16000 AS flushed_from, least(n - whole * 16000, 160000) AS samples, 160000 - least(n - whole * 16000, 160000) AS padding FROM w WHERE n - whole * 16000 > 0""")
def t2_flush_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 10_000).alias("n"))
    last = rows.select("event_id", "n", F.array_max(pcm.window_offsets(F.col("n"), 160_000, 16_000)).alias("flushed_from")).where("flushed_from is not null")
    kept = F.least(F.col("n") - F.col("flushed_from"), F.lit(160_000).cast("long"))
    return last.select("event_id", "flushed_from", kept.alias("samples"), (160_000 - kept).alias("padding"))


@query("""WITH n AS (SELECT event_id, CAST(floor(value * 10000) AS BIGINT) AS n FROM events)
SELECT event_id, unnest(range(CASE WHEN n >= 32000 THEN (n - 32000) // 8000 + 1 ELSE 0 END)) * 8000 AS first_sample FROM n""")
def t3_demo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = pcm.window_offsets(F.floor(F.col("value") * 10_000), 32_000, 8_000, flush=False)
    return table(spark, sf_dir, "events").select("event_id", F.explode(offsets).alias("first_sample"))


@query(f"""WITH {SEGMENTS}, x AS (SELECT session_id, s // 10000 AS slot, e - s AS d, label FROM g)
SELECT session_id, slot, count(*) AS segments, count(DISTINCT label) AS labels, CAST(sum(d) AS BIGINT) AS spoken FROM x GROUP BY ALL""")
def t4_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("slot", F.floor(F.col("s") / 10_000))
    return rows.groupBy("session_id", "slot").agg(F.count("*").alias("segments"), F.countDistinct("label").alias("labels"), F.sum(F.col("e") - F.col("s")).alias("spoken"))


@query(f"""WITH {SEGMENTS}, m AS (SELECT session_id, max(e) AS m FROM g GROUP BY ALL) SELECT segment_id, s - (m - 60000) AS offset_ms FROM g JOIN m USING (session_id) WHERE e > m - 60000""")
def t5_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    newest = rows.groupBy("session_id").agg(F.max("e").alias("m"))
    return rows.join(newest, "session_id").where("e > m - 60000").select("segment_id", (F.col("s") - (F.col("m") - 60_000)).alias("offset_ms"))


@query("""SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS BIGINT) AS batch FROM events""")
def t8_count_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.count_triggers(events(spark, sf_dir), ["user_id"], ["us", "event_id"], 10).select("event_id", "batch")


@query(f"""WITH RECURSIVE {SEGMENTS}, x AS (SELECT session_id, s / 1000 AS t, row_number() OVER (PARTITION BY session_id ORDER BY s, segment_id) AS i FROM g),
f AS (SELECT session_id, i, t, CAST(1 AS BIGINT) AS n, t AS since, false AS fires FROM x WHERE i = 1
  UNION ALL SELECT x.session_id, x.i, x.t, CASE WHEN f.n + 1 >= 10 OR x.t - f.since >= 30 THEN 0 ELSE f.n + 1 END, CASE WHEN f.n + 1 >= 10 OR x.t - f.since >= 30 THEN x.t ELSE f.since END, f.n + 1 >= 10 OR x.t - f.since >= 30
  FROM f JOIN x ON x.session_id = f.session_id AND x.i = f.i + 1)
SELECT session_id, t AS fired FROM f WHERE fires""")
def t8_adaptive_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("at", F.col("s") / 1000)
    return sequence.adaptive_triggers(rows, ["session_id"], ["s", "segment_id"], "at", 10, 30.0)


@query(f"""WITH {SEGMENTS}, d AS (SELECT segment_id % 3 AS device, segment_id, s, label FROM g) SELECT segment_id, 'dev' || device || ':' || label AS label FROM d""")
def fn11_device_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("segment_id", labels.with_device(F.col("segment_id") % 3, F.col("label")).alias("label"))


@query(f"""WITH {SEGMENTS} SELECT DISTINCT label, regexp_replace(label, '^[^:]*:', '') AS shown, split_part(label, ':', 1) AS kind, CASE WHEN label LIKE 'auto:%' THEN CAST(ascii(substr(label, 6, 1)) - 65 AS BIGINT) END AS idx FROM g""")
def fn12_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return segments(spark, sf_dir).select("label").distinct().select("label", labels.display_name(label).alias("shown"), labels.label_kind(label).alias("kind"), labels.label_to_index(label).cast("long").alias("idx"))


@query("""SELECT DISTINCT CAST(user_id % 20 AS BIGINT) AS idx, 'auto:' || chr(CAST(65 + user_id % 20 AS INT)) AS label, chr(CAST(65 + user_id % 26 AS INT)) AS letter FROM events""")
def fn10_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("user_id") % 20
    return table(spark, sf_dir, "events").select(idx.alias("idx"), labels.index_to_label(idx).alias("label"), labels.wrapped_letter(F.col("user_id")).alias("letter")).distinct()


@query(f"""WITH {SEGMENTS}, u AS (SELECT DISTINCT session_id, label FROM g WHERE label LIKE 'auto:%'), s AS (SELECT DISTINCT session_id FROM g),
l AS (SELECT session_id, 'auto:' || chr(CAST(65 + i AS INT)) AS label FROM s, range(20) AS r(i))
SELECT session_id, label, row_number() OVER (PARTITION BY session_id ORDER BY label) AS place FROM (SELECT * FROM l EXCEPT SELECT * FROM u)""")
def u1_letter_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = segments(spark, sf_dir).groupBy("session_id").agg(F.collect_set(F.when(F.col("label").startswith("auto:"), F.col("label"))).alias("used"))
    pool = F.array(*[F.lit(f"auto:{x}") for x in labels.LETTERS])
    return used.select("session_id", F.posexplode(F.array_except(pool, "used")).alias("place", "label")).select("session_id", "label", (F.col("place") + 1).cast("long").alias("place"))


@query("""WITH x AS (SELECT event_id, ord(props[1]) + 256 * ord(props[2]) AS a, ord(props[3]) + 256 * ord(props[4]) AS b, ord(props[5]) + 256 * ord(props[6]) AS c, ord(props[7]) + 256 * ord(props[8]) AS d FROM events)
SELECT event_id, CAST(trunc((a + b) / 2.0) AS INT) AS mean_first, CAST(trunc((c + d) / 2.0) AS INT) AS mean_second, CAST(least(a + b, 32767) AS INT) AS sum_first, CAST(least(c + d, 32767) AS INT) AS sum_second FROM x""")
def s5_mixdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels, whose samples are the bytes of a text, as one; an incomplete last frame is left out."""
    rows = table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-8").alias("mean"), F.encode("props", "UTF-8").alias("sum"))
    mixed = audio.mixed(audio.mixed(rows, "mean", 2, "mean"), "sum", 2, "sum")
    sample = lambda c, i: pcm.samples(F.col(c))[i].alias(f"{c}_{'first' if i == 0 else 'second'}")
    return mixed.select("event_id", sample("mean", 0), sample("mean", 1), sample("sum", 0), sample("sum", 1))


@query("""SELECT event_id, round(greatest(least(value / 100 - 2, 1), -1), 9) AS x, CAST(trunc(greatest(least(value / 100 - 2, 1), -1) * 32767) AS INTEGER) AS pcm, round(trunc(greatest(least(value / 100 - 2, 1), -1) * 32767) / 32768, 9) AS back FROM events""")
def fn2_float_to_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 100 - 2
    value = pcm.to_int16(x)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)), 9).alias("x"), value.alias("pcm"), F.round(pcm.to_float(value), 9).alias("back"))


QUERIES, ORACLE = query.queries, query.oracle
