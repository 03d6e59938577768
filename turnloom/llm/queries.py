"""Queries of the operators in this package over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import clean_label
from ..operators.deliveries import first_delivery
from ..plans.training import clean_sql
from ..session import cut, table
from .clusters import describe_clusters, similarity_clusters
from .nearest_time import nearest_in_time
from .mixing import mix_sources, share_report
from .neighbours import index_sample, most_similar
from .packing import fill_report, pack_items
from .pii import find_personal, redact_personal
from .runs import collapse_runs
from .tokens import token_count
from .turns import speaker_turns
from .vectors import is_usable, packed

TOLERANCE_US = 750_000
RUN_GAP_MS = 30_000
TURN_GAP_US = 10_000_000


def micros(seconds: Column) -> Column:
    """Whole microseconds of seconds; null for a time that is null or no finite number."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 9e12)
    return F.when(finite, F.round(seconds * 1_000_000).cast("long"))


def final_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcript = table(spark, sf_dir, "transcript")
    values = {c: F.col(c) for c in ("session_id", "is_final", "t_start", "t_end", "text")}
    first = first_delivery(transcript, ["session_id", "seq"], "transcript_id", values)
    zero = F.coalesce((F.col("t_start") == 0) & (F.col("t_end") == 0), F.lit(False))
    kept = first.where(F.col("is_final") & F.col("t_start").isNotNull() & ~zero)
    return kept.select("transcript_id", "session_id", "text", micros(F.col("t_start")).alias("at"), micros(F.col("t_end")).alias("until"))


def named_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "seg_label")
    named = rows.select("seg_id", "session_id", clean_label(F.col("speaker_id")).alias("speaker"), micros(F.col("t_start")).alias("at"))
    return named.where(F.col("speaker").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_in_time(final_records(spark, sf_dir), named_labels(spark, sf_dir), ["session_id"], "at", "transcript_id", "seg_id", TOLERANCE_US)
    return found.select("transcript_id", "seg_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "speaker_segment")
    first = first_delivery(segments, ["session_id", "utterance_id"], "segment_id", {c: F.col(c) for c in ("session_id", "label", "t_start")})
    named = first.select("segment_id", "session_id", clean_label(F.col("label")).alias("label"), F.round(micros(F.col("t_start")) / 1000).cast("long").alias("at"))
    runs = collapse_runs(named, ["session_id"], "at", "segment_id", "label", RUN_GAP_MS)
    return runs.where("events >= 3").select("session_id", F.col("first_id").alias("first_segment_id"), F.col("last_id").alias("last_segment_id"))


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(
        final_records(spark, sf_dir), named_labels(spark, sf_dir), ["session_id"], "at", "transcript_id", "text", "seg_id", "speaker", TOLERANCE_US, TURN_GAP_US, end="until"
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = p7_turns(spark, sf_dir)
    return turns.select("session_id", "speaker", F.col("first_id").alias("first_transcript_id"), F.col("last_id").alias("last_transcript_id"))


def model_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector length of each model: one row a model."""
    return table(spark, sf_dir, "speaker").where("model_id is not null").groupBy("model_id").agg(F.max("embedding_dim").alias("dim"))


def usable(df: DataFrame, dims: DataFrame, vector: str) -> DataFrame:
    """Rows with a usable vector of their model, with ``dim``."""
    return df.join(dims, "model_id").where(is_usable(F.col(vector), F.col("dim")))


def segment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``model``, ``session_id``, ``label`` and ``packed`` of the first deliveries with a usable vector.

    Vectors are packed before the shuffle of ``first_delivery``; one that isn't usable is an empty one there.
    """
    segments = table(spark, sf_dir, "speaker_segment").select("segment_id", "session_id", "utterance_id", "label", "model_id", "embedding")
    joined = segments.join(model_dims(spark, sf_dir), "model_id", "left")
    sound = F.when(is_usable(F.col("embedding"), F.col("dim")), F.col("embedding")).otherwise(F.array().cast("array<float>"))
    rows = packed(joined.withColumn("embedding", sound).drop("dim"), "embedding")
    values = {"model": F.col("model_id"), "session_id": F.col("session_id"), "label": F.col("label"), "packed": F.col("packed")}
    first = first_delivery(rows, ["session_id", "utterance_id"], "segment_id", values)
    return first.where(F.length("packed") > 4).withColumnRenamed("segment_id", "id")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "speaker_vss").select(F.col("vec_id").alias("id"), "model_id", "centroid")
    return packed(usable(rows, model_dims(spark, sf_dir), "centroid").drop("dim"), "centroid").withColumnRenamed("model_id", "model")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = segment_vectors(spark, sf_dir).select("model", "id", "packed").unionByName(stored_vectors(spark, sf_dir))
    # The index is fitted on all deliveries, which saves a pass of the first ones.
    raw = table(spark, sf_dir, "speaker_segment").select(F.col("segment_id").alias("id"), F.col("model_id").alias("model"), "model_id", "embedding")
    vectors = packed(usable(raw, model_dims(spark, sf_dir), "embedding").select("id", "model", "embedding"), "embedding")
    found = most_similar(both, k=5, min_similarity=0.97, fitted=index_sample(raw, vectors))
    pair = found.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b"))
    return pair.distinct()


def voice_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unnamed voices: segments with an auto label, and candidates, whose model is that of their session's segments."""
    segments = segment_vectors(spark, sf_dir).where(clean_label(F.col("label")).startswith("auto:")).select("model", "id", "packed")
    rows = table(spark, sf_dir, "speaker_candidate").where("candidate_id is not null").select(F.col("candidate_id").alias("id"), "session_id", F.col("representative_embedding").alias("v"))
    models = table(spark, sf_dir, "speaker_segment").where("model_id is not null").groupBy("session_id").agg(F.min("model_id").alias("model_id"))
    once = rows.groupBy("id", "session_id").agg(F.first("v", ignorenulls=True).alias("v"))
    sound = usable(once.join(models, "session_id"), model_dims(spark, sf_dir), "v").select("id", F.col("model_id").alias("model"), "v")
    return segments.unionByName(packed(sound, "v").select("model", "id", "packed"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_clusters(similarity_clusters(voice_vectors(spark, sf_dir), tau=0.78))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_clusters(voice_vectors(spark, sf_dir), tau=0.78)
    return found.select(F.col("cluster").alias("cluster_id"), F.col("id").alias("member_id"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, with cleaned source, language and court; written once, as callers read it again."""
    docs = table(spark, sf_dir, "documents")
    source = F.regexp_replace(F.trim(F.lower("source")), r"[\s\-]+", "_")
    lang = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("und")))), "^[a-z]+", 0)
    topic = F.regexp_replace(F.trim(F.lower("court")), r"\s+", " ")
    return cut(docs.select("doc_id", source.alias("source"), lang.alias("lang"), topic.alias("topic"), token_count(F.col("text")).alias("tokens")))


def pack_specs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """Kinds and capacities: a fixed table of parameters."""
    return [(r.container_kind, r.capacity_tokens) for r in table(spark, sf_dir, "pack_spec").orderBy("container_kind").collect()]


def mix_targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    """Sources, shares and repeats: a fixed table of parameters."""
    return [(r.source, r.target_share, r.max_repeat) for r in table(spark, sf_dir, "mix_target").orderBy("source").collect()]


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(document_tokens(spark, sf_dir), pack_specs(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_packing(spark, sf_dir), pack_specs(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(document_tokens(spark, sf_dir), mix_targets(spark, sf_dir), ["lang", "topic"])


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(p9_mix(spark, sf_dir), mix_targets(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_char", "end_char")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_personal(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted, "p8_packing": p8_packing, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares, "p4_found": p4_found, "p4_clusters": p4_clusters, "p1_found": p1_found, "p2_found": p2_found, "p6_found": p6_found, "p7_found": p7_found, "p7_turns": p7_turns}

_NAMED_SQL = f"""l AS (SELECT seg_id, session_id, clean, CAST(round(t_start * 1000000) AS BIGINT) AS t FROM {clean_sql("seg_label", "speaker_id")} WHERE clean IS NOT NULL AND t_start IS NOT NULL)"""

_FINAL_SQL = """f AS (SELECT transcript_id, session_id, text, CAST(round(t_start * 1000000) AS BIGINT) AS t FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY transcript_id) AS r FROM transcript)
  WHERE r = 1 AND is_final AND t_start IS NOT NULL AND NOT coalesce(t_start = 0 AND t_end = 0, false))"""

_FILLER_SQL = "u+[hm]+|u+-u+[hm]+|e+r+m*|e+h+m*|a+h+m*|h+m+|m{2,}|m+-?h+m+|u+h+-?h*u+h+|e+u+h+|[äæ]+h*m*|ö+h+m*"

#: Texts with a word left after annotations, a speaker's tag, marks and fillers are taken away.
_SPOKEN_SQL = rf"""w AS (SELECT *, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''),
  '\[[^\]]*\]?|\(+[^)]*\)*|\{{[^}}]*\}}?|<[^>]*>?|\*[^*]*\*?|#[^#]*#?|~[^~]*~?|♪[^♪]*♪|[♪♫]\s*(\w+\s+){{0,2}}([Mm]usic|[Ss]inging|[Hh]umming)\s*$|[♪♫]', ' ', 'g'),
  '^\s*(>>|-)?\s*(([A-Z]|[0-9]{{1,3}}|SPK_[0-9]+)\s*[:>](\s|$))?', ' '), '\s+') AS words FROM f),
s AS (SELECT * FROM w WHERE len(list_filter(words, lambda x: regexp_replace(x, '[^\pL\pN]', '', 'g') <> ''
  AND NOT regexp_full_match(lower(regexp_replace(x, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')), '{_FILLER_SQL}'))) > 0)"""

_UNITS_SQL = """dims AS (SELECT model_id, max(embedding_dim) AS dim FROM speaker WHERE model_id IS NOT NULL GROUP BY model_id),
r AS (SELECT segment_id AS id, model_id, embedding AS v FROM (SELECT *, row_number() OVER (PARTITION BY session_id, utterance_id ORDER BY segment_id) AS d FROM speaker_segment) WHERE d = 1 UNION ALL SELECT vec_id, model_id, centroid FROM speaker_vss),
w AS (SELECT id, model_id, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM r JOIN dims USING (model_id) WHERE len(v) = dim AND NOT list_bool_or(list_transform(v, lambda x: isnan(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
u AS (SELECT id, model_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM w)"""

ORACLE = {
    "p2_found": f"""
WITH {_UNITS_SQL},
s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS s FROM u a JOIN u b ON a.model_id = b.model_id AND a.id <> b.id WHERE list_dot_product(a.u, b.u) >= 0.97),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS i FROM s)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM k WHERE i <= 5""",
    "p7_found": f"""
WITH {_NAMED_SQL}, {_FINAL_SQL}, {_SPOKEN_SQL},
m AS (SELECT s.session_id, s.transcript_id, s.t, l.clean, row_number() OVER (PARTITION BY transcript_id ORDER BY abs(s.t - l.t), seg_id) AS r
  FROM s JOIN l ON s.session_id = l.session_id AND l.t BETWEEN s.t - 750000 AND s.t + 750000),
b AS (SELECT *, CASE WHEN lag(clean) OVER o = clean AND t - lag(t) OVER o <= 10000000 THEN 0 ELSE 1 END AS n FROM m WHERE r = 1 WINDOW o AS (PARTITION BY session_id ORDER BY t, transcript_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY t, transcript_id ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT session_id, min(clean) AS speaker, arg_min(transcript_id, (t, transcript_id)) AS first_transcript_id, arg_max(transcript_id, (t, transcript_id)) AS last_transcript_id FROM g GROUP BY session_id, i""",
    "p1_found": f"""
WITH {_NAMED_SQL}, {_FINAL_SQL},
m AS (SELECT transcript_id, seg_id, row_number() OVER (PARTITION BY transcript_id ORDER BY abs(f.t - l.t), seg_id) AS r
  FROM f JOIN l ON f.session_id = l.session_id AND l.t BETWEEN f.t - 750000 AND f.t + 750000)
SELECT transcript_id, seg_id FROM m WHERE r = 1""",
    "p6_found": f"""
WITH d AS (SELECT * FROM (SELECT segment_id, session_id, label, t_start, row_number() OVER (PARTITION BY session_id, utterance_id ORDER BY segment_id) AS r FROM speaker_segment) WHERE r = 1),
v AS (SELECT segment_id, session_id, clean, CAST(round(t_start * 1000) AS BIGINT) AS t FROM {clean_sql("d", "label")} WHERE clean IS NOT NULL AND t_start IS NOT NULL),
b AS (SELECT *, CASE WHEN lag(clean) OVER w = clean AND t - lag(t) OVER w <= 30000 THEN 0 ELSE 1 END AS o FROM v WINDOW w AS (PARTITION BY session_id ORDER BY t, segment_id)),
g AS (SELECT *, sum(o) OVER (PARTITION BY session_id ORDER BY t, segment_id ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT session_id, arg_min(segment_id, (t, segment_id)) AS first_segment_id, arg_max(segment_id, (t, segment_id)) AS last_segment_id
FROM g GROUP BY session_id, i HAVING count(*) >= 3""",
}
