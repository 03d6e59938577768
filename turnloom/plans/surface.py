"""Queries of sources, sinks and the profile store, whose inputs are made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pcm
from ..functions.embedding import embedded
from ..session import table
from ..sources import audio, rttm
from ..store import SpeakerStore
from ..streaming import sessions
from .conversation import SEGMENTS, events, segments
from .registry import Registry
from .vectors import _SOUND, _UNIT, _dims, _sound

query = Registry()


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of their user's session: bytes, plain text (errors), and the end (errors of more than 300)."""
    rows = events(spark, sf_dir)
    error, long = F.col("event_type") == "error", F.col("value") > 300
    text = F.when(error & long, '{"type":"eof"}').when(error, "not json")
    return rows.select(F.col("user_id").alias("session_id"), F.struct("us", "event_id").alias("seq"), F.when(~error, F.encode("props", "UTF-8")).alias("pcm"), text.alias("text"))


@query("""SELECT event_id, octet_length(encode(props)) AS bytes FROM events WHERE event_type <> 'error'""")
def s2_binary_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text among the frames is skipped, the end is none of them."""
    return sessions.frames(_messages(spark, sf_dir)).where("not last").select("seq.event_id", F.octet_length("pcm").cast("long").alias("bytes"))


@query("""WITH e AS (SELECT user_id, min((epoch_us(ts), event_id)) AS stop FROM events WHERE event_type = 'error' AND value > 300 GROUP BY user_id)
SELECT event_id, events.user_id AS session_id FROM events LEFT JOIN e USING (user_id) WHERE event_type <> 'error' AND (stop IS NULL OR (epoch_us(ts), event_id) < stop)""")
def s3_eof_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session sends before the message that ends it."""
    return sessions.until_end(sessions.frames(_messages(spark, sf_dir))).select("seq.event_id", "session_id")


@query()
def s4_drop_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events enter a queue of three places, of which an error or a click takes one out."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "us", (~F.col("event_type").isin("error", "click")).alias("put"))
    return sessions.kept_by_queue(rows, "user_id", ["us", "event_id"], "put", 3).select("event_id")


def _wav(rate: int, channels: int, data: F.Column) -> F.Column:
    """A WAV file around samples of 16 bits."""
    def le(x: F.Column, n: int) -> F.Column:
        return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(n)])

    size = F.octet_length(data)
    head = F.concat(F.encode(F.lit("RIFF"), "UTF-8"), le(size + 36, 4), F.encode(F.lit("WAVEfmt "), "UTF-8"), le(F.lit(16), 4), le(F.lit(1), 2), le(F.lit(channels), 2), le(F.lit(rate), 4), le(F.lit(rate * channels * 2), 4), le(F.lit(channels * 2), 2), le(F.lit(16), 2))
    return F.concat(head, F.encode(F.lit("data"), "UTF-8"), le(size, 4), data)


@query("""SELECT event_id, unnest(range((octet_length(encode(props)) // 2 * 2 + 3) // 4)) AS seq, octet_length(encode(props)) // 2 * 2 AS bytes FROM events""")
def s1_wav_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the samples of WAV files, read in chunks of four bytes."""
    rows = events(spark, sf_dir).select("event_id", _wav(16_000, 1, F.encode("props", "UTF-8")).alias("content"))
    found = audio.chunks_of(rows, "content", "event_id", 4)
    total = found.groupBy("event_id").agg(F.sum(F.octet_length("pcm")).cast("long").alias("bytes"))
    return found.join(total, "event_id").select("event_id", "seq", "bytes")


@query()
def s6_beamformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two microphones at one place hear the same: steered to any direction, they give it back."""
    one = F.encode(F.repeat("props", F.lit(32)), "UTF-8")
    even = F.substring(one, F.lit(1), (F.octet_length(one) / 2).cast("int") * 2)
    # Each sample twice, in both channels.
    stereo = events(spark, sf_dir).select("event_id", F.unhex(F.regexp_replace(F.hex(even), "(.{4})", "$1$1")).alias("pcm"))
    return audio.beamformed(stereo, "pcm", 2, [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0]], [1.0, 0.0, 0.0], 64).select("event_id", F.octet_length("pcm").alias("bytes"), pcm.samples(F.substring("pcm", 1, 2))[0].alias("first"))


@query("""WITH x AS (SELECT event_id, (ord(props[1]) + 256 * ord(props[2])) / 32768.0 AS a, (ord(props[3]) + 256 * ord(props[4])) / 32768.0 AS b, (ord(props[5]) + 256 * ord(props[6])) / 32768.0 AS c, (ord(props[7]) + 256 * ord(props[8])) / 32768.0 AS d FROM events)
SELECT event_id, round((a + b) / 2, 6) AS first, round((c + d) / 2, 6) AS second FROM x""")
def s11_mono_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files of two channels as one, the mean of both."""
    rows = events(spark, sf_dir).select("event_id", _wav(16_000, 2, F.encode("props", "UTF-8")).alias("content"))
    found = audio.mono_of(rows, "content", "event_id")
    return found.select("event_id", F.round(F.col("samples")[0].cast("double"), 6).alias("first"), F.round(F.col("samples")[1].cast("double"), 6).alias("second"))


@query(f"""WITH {SEGMENTS} SELECT session_id AS uri, round(s / 1000, 3) AS t_start, round(e / 1000, 3) AS t_end, label AS speaker FROM g WHERE segment_id % 3 <> 0""")
def s9_lenient_rttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of another kind and with eight fields count, comments don't."""
    rows = segments(spark, sf_dir)
    length = (F.col("e") - F.col("s")) / 1000
    line = F.format_string("X-TURN %s 1 %.3f %.3f <NA> <NA> %s", "session_id", F.col("s") / 1000, length, "label")
    lines = rows.select(F.when(F.col("segment_id") % 3 == 0, F.concat(F.lit("; "), line)).otherwise(line).alias("value"))
    return rttm.parse_rttm(lines, lenient=True).select("uri", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), "speaker")


class _Energy:
    """Stands for a model: the mean and the largest sample."""

    model_id, dim = "energy", 2

    def extract(self, samples):
        return [float(samples.mean()), float(samples.max())]


@query("""SELECT event_id, 'energy' AS model_id, round((value + event_id) / 2, 3) AS mean, round(greatest(value, event_id), 3) AS peak FROM events""")
def x_embedding_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.array("value", F.col("event_id").cast("double")).alias("samples"))
    found = embedded(rows, "samples", _Energy())
    return found.select("event_id", "model_id", F.round(F.col("embedding")[0], 3).alias("mean"), F.round(F.col("embedding")[1], 3).alias("peak"))


_STORE = f"""dims AS (SELECT model_id, max(embedding_dim) AS dim FROM speaker GROUP BY model_id), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, model_id ORDER BY speaker_id, utterance_count) AS r FROM speaker) WHERE r = 1)"""


def _store(spark: SparkSession, sf_dir: str) -> SpeakerStore:
    """A store with the profiles of the tables, one for a name and model, and their usable vectors."""
    order = Window.partitionBy("name", "model_id").orderBy("speaker_id", "utterance_count")
    speakers = table(spark, sf_dir, "speaker").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    rows = table(spark, sf_dir, "speaker_vss").where("speaker_id is not null").join(_dims(spark, sf_dir), "model_id").where(_sound("centroid"))
    own = rows.join(speakers.select("speaker_id"), "speaker_id", "left_semi")
    vectors = own.select("speaker_id", F.col("vec_id").alias("seq"), F.col("centroid").cast("array<double>").alias("embedding"))
    store = SpeakerStore.from_url(spark, "memory://", 64, "m")
    store.init_schema()
    store.load(speakers, vectors)
    return store


@query(f"""WITH {_STORE}, v AS (SELECT speaker_id, model_id, {_UNIT.format(v='centroid')} AS u FROM speaker_vss JOIN dims USING (model_id) WHERE speaker_id IN (SELECT speaker_id FROM one) AND {_SOUND.format(v='centroid')}),
l AS (SELECT speaker_id, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM v), m AS (SELECT speaker_id, p, avg(x) AS x FROM l GROUP BY ALL), c AS (SELECT speaker_id, list(x ORDER BY p) AS c FROM m GROUP BY ALL)
SELECT o.speaker_id, o.name, o.origin, round(c.c[1] / sqrt(list_dot_product(c.c, c.c)), 6) AS first FROM one o LEFT JOIN c USING (speaker_id)""")
def st1_loaded_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the first number of their centroid, the mean of their vectors."""
    store = _store(spark, sf_dir)
    centroids = store._tables()[2].select("speaker_id", F.round(F.col("centroid")[0], 6).alias("first"))
    return store.list_all().select("speaker_id", "name", "origin").join(centroids, "speaker_id", "left")


@query(f"""WITH {_STORE}, n AS (SELECT *, row_number() OVER (ORDER BY speaker_id) AS i FROM one), m AS (SELECT min(first_seen) AS f, max(last_seen) AS l, sum(utterance_count) AS c FROM n WHERE i IN (2, 3))
SELECT speaker_id, CASE WHEN i = 1 THEN 'renamed' ELSE name END AS name, CASE WHEN i = 3 THEN m.f ELSE first_seen END AS first_seen, CASE WHEN i = 3 THEN m.l ELSE last_seen END AS last_seen, CAST(CASE WHEN i = 3 THEN m.c ELSE utterance_count END AS BIGINT) AS utterance_count FROM n, m WHERE i NOT IN (2, 4)""")
def st7_alias_merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first profile gets another name, the second goes into the third, the fourth is removed."""
    store = _store(spark, sf_dir)
    ids = [r.speaker_id for r in store.list_all().select("speaker_id").orderBy("speaker_id").limit(4).collect()]
    store.set_alias(ids[0], "renamed")
    store.merge(ids[1], ids[2])
    store.delete(ids[3])
    return store.list_all().select("speaker_id", "name", "first_seen", "last_seen", "utterance_count")


QUERIES, ORACLE = query.queries, query.oracle
