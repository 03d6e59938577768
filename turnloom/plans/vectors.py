"""Queries over embeddings and stored profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text, vector
from ..operators import clustering, joins
from ..operators.deliveries import first_delivery
from ..session import cut, table
from .conversation import UTTERANCES
from .training import clean_sql
from .registry import Registry

query = Registry()


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _e(spark, sf_dir).select("vec_id", "label", vector.l2_normalize(F.col("embedding")).alias("u"))


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_U = f"u AS (SELECT vec_id, label, list_transform({_D}, lambda x: x / sqrt(list_dot_product({_D}, {_D}))) AS u FROM embeddings)"
_C = f"{_U}, l AS (SELECT vec_id, label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM u), m AS (SELECT label, p, avg(x) AS x FROM l GROUP BY ALL), v AS (SELECT label, list(x ORDER BY p) AS v FROM m GROUP BY label), c AS (SELECT label AS who, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM v)"


@query(f"WITH {_U} SELECT vec_id, round(u[1], 6) AS first, round(u[64], 6) AS last, round(list_dot_product(u, u), 6) AS norm FROM u")
def fn4_l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return _units(spark, sf_dir).select("vec_id", F.round(u[0], 6).alias("first"), F.round(u[63], 6).alias("last"), F.round(vector.dot(u, u), 6).alias("norm"))


@query(f"""WITH s AS (SELECT vec_id, list_transform({_D}, lambda x: x * CASE WHEN label = 0 THEN 1e-12 ELSE label END) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM s)
SELECT vec_id, round(CASE WHEN n < 1e-9 THEN e[1] ELSE e[1] / n END, 6) + 0.0 AS first, n < 1e-9 AS kept FROM n""")
def fn5_l2_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.when(F.col("label") == 0, 1e-12).otherwise(F.col("label"))
    rows = _e(spark, sf_dir).withColumn("k", scale).withColumn("e", F.transform(vector.doubles(F.col("embedding")), lambda x: x * F.col("k")))
    return rows.select("vec_id", (F.round(vector.l2_normalize_lenient(F.col("e"))[0], 6) + 0.0).alias("first"), (vector.norm(F.col("e")) < 1e-9).alias("kept"))


@query(f"""WITH {_U} SELECT a.vec_id, round(list_dot_product(a.u, b.u), 6) AS cosine, round(greatest(1 - list_dot_product(a.u, b.u), 0), 6) AS distance FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def fn6_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w"))
    return rows.join(other, "vec_id").select("vec_id", F.round(vector.cosine(F.col("u"), F.col("w")), 6).alias("cosine"), F.round(vector.cosine_distance(F.col("u"), F.col("w")), 6).alias("distance"))


@query("""WITH s AS (SELECT vec_id, embedding[1:7] AS s FROM embeddings), a AS (SELECT vec_id, list_position(s, list_max(s)) - 1 AS k FROM s)
SELECT vec_id, CAST(k AS INT) AS class, CAST(k IN (1, 4, 5) AS INT) AS s1, CAST(k IN (2, 4, 6) AS INT) AS s2, CAST(k IN (3, 5, 6) AS INT) AS s3 FROM a""")
def fn8_powerset(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.slice("embedding", 1, 7)
    rows = _e(spark, sf_dir).select("vec_id", vector.argmax(scores).alias("class"), vector.powerset_to_speakers(scores).alias("s"))
    return rows.select("vec_id", "class", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(3)])


@query("""WITH s AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: abs(CAST(x AS DOUBLE))) AS s FROM embeddings), e AS (SELECT *, list_transform(s, lambda x: exp(10 * (x - list_max(s)))) AS e FROM s)
SELECT vec_id, round(greatest(pow(s[1], 3) * pow(e[1] / list_sum(e), 3), 1e-8), 9) AS w1, round(greatest(pow(s[2], 3) * pow(e[2] / list_sum(e), 3), 1e-8), 9) AS w2, round(greatest(pow(s[3], 3) * pow(e[3] / list_sum(e), 3), 1e-8), 9) AS w3 FROM e""")
def fn28_overlap_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.transform(vector.doubles(F.slice("embedding", 1, 3)), F.abs)
    rows = _e(spark, sf_dir).select("vec_id", seg.alias("s")).select("vec_id", vector.overlap_penalty(F.col("s")).alias("w"))
    return rows.select("vec_id", *[F.round(F.col("w")[i], 9).alias(f"w{i + 1}") for i in range(3)])


@query(f"""WITH {_C} SELECT CAST(who AS INT) AS label, unnest(range(1, 65)) AS p, round(unnest(c), 6) AS x FROM c""")
def a1_label_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.centroids(_units(spark, sf_dir), ["label"], "u")
    return found.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("p"), F.round("x", 6).alias("x"))


@query(f"""WITH {_U}, l AS (SELECT label, 1 + vec_id % 3 AS w, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM u), m AS (SELECT label, p, sum(x * w) / sum(w) AS x FROM l GROUP BY ALL) SELECT label, CAST(p AS BIGINT) AS p, round(x, 6) AS x FROM m""")
def a2_weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir).withColumn("w", (1 + F.col("vec_id") % 3).cast("double"))
    found = vector.mean_vectors(rows, ["label"], "u", "w")
    return found.select("label", F.posexplode("mean").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("p"), F.round("x", 6).alias("x"))


@query(f"""WITH {_C}, s AS (SELECT vec_id, who, list_dot_product(u, c) AS s FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, who) AS k FROM s WHERE s >= 0.05)
SELECT vec_id, CAST(who AS INT) AS who, round(s, 6) AS similarity FROM r WHERE k = 1""")
def j1_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    known = vector.centroids(units, ["label"], "u").select(F.col("label").alias("who"), "centroid")
    found = joins.nearest_vector(units, known, "vec_id", "u", "who", "centroid", 0.05)
    return found.select("vec_id", "who", F.round("similarity", 6).alias("similarity"))


_SOUND = "len({v}) = dim AND NOT list_bool_or(list_transform({v}, lambda x: isnan(x))) AND list_bool_or(list_transform({v}, lambda x: x <> 0))"
_UNIT = "list_transform(list_transform({v}, lambda x: CAST(x AS DOUBLE)), lambda x: x / sqrt(list_dot_product(list_transform({v}, lambda x: CAST(x AS DOUBLE)), list_transform({v}, lambda x: CAST(x AS DOUBLE)))))"
#: Segments with a usable vector, and the current centroid of every registered or stored speaker.
_USABLE = f"""dims AS (SELECT model_id, max(embedding_dim) AS dim FROM speaker GROUP BY model_id),
g AS (SELECT session_id, segment_id, clean AS label, is_locked, t_start, t_end, model_id, {_UNIT.format(v='embedding')} AS u FROM {clean_sql(UTTERANCES, 'label')} JOIN dims USING (model_id) WHERE {_SOUND.format(v='embedding')} AND t_start IS NOT NULL)"""
_KNOWN = f"""sp AS (SELECT DISTINCT speaker_id, name, origin FROM speaker WHERE origin IN ('registered', 'stored')),
cu AS (SELECT speaker_id, arg_max(vec_id, (updated_at, vec_id)) AS vec_id FROM speaker_vss JOIN dims USING (model_id) WHERE speaker_id IS NOT NULL AND {_SOUND.format(v='centroid')} GROUP BY speaker_id),
k AS (SELECT v.model_id, sp.origin || ':' || sp.name || '#' || sp.speaker_id AS who, sp.origin, {_UNIT.format(v='v.centroid')} AS c FROM cu JOIN speaker_vss v USING (vec_id) JOIN sp ON sp.speaker_id = cu.speaker_id)"""


def usable_segments(spark: SparkSession, sf_dir: str, unit: Callable[[Column], Column] = vector.unit) -> DataFrame:
    """First deliveries with a usable vector and a start; ``u`` is the unit vector, ``label`` clean."""
    segments = table(spark, sf_dir, "speaker_segment")
    first = first_delivery(segments, ["session_id", "utterance_id"], "segment_id", {c: F.col(c) for c in ("session_id", "label", "is_locked", "t_start", "t_end", "model_id", "embedding")})
    rows = first.join(_dims(spark, sf_dir), "model_id").where(_sound("embedding") & F.col("t_start").isNotNull())
    return rows.select("session_id", "segment_id", labels.clean_label(F.col("label")).alias("label"), "is_locked", "t_start", "t_end", "model_id", unit(F.col("embedding")).alias("u"))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speaker").groupBy("model_id").agg(F.max("embedding_dim").alias("dim"))


def _sound(column: str) -> F.Column:
    v = F.col(column)
    return F.coalesce((F.size(v) == F.col("dim")) & ~F.exists(v, F.isnan) & F.exists(v, lambda x: x != 0), F.lit(False))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_id``, ``who``, ``origin`` and ``c``: the latest usable centroid of every registered or stored speaker."""
    speakers = table(spark, sf_dir, "speaker").where("origin in ('registered', 'stored')").select("speaker_id", "name", "origin").distinct()
    rows = table(spark, sf_dir, "speaker_vss").where("speaker_id is not null").join(_dims(spark, sf_dir), "model_id").where(_sound("centroid"))
    latest = rows.groupBy("speaker_id").agg(F.max_by(F.struct("model_id", "centroid"), F.struct("updated_at", "vec_id")).alias("v"))
    who = F.concat("origin", F.lit(":"), "name", F.lit("#"), "speaker_id")
    return latest.join(speakers, "speaker_id").select("v.model_id", who.alias("who"), "origin", vector.unit(F.col("v.centroid")).alias("c"))


@query(f"""WITH {_USABLE}, {_KNOWN}, s AS (SELECT g.segment_id, k.who, k.origin, list_dot_product(g.u, k.c) AS s FROM g JOIN k USING (model_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY origin, s DESC, who) AS i FROM s WHERE s >= CASE WHEN origin = 'registered' THEN 0.70 ELSE 0.75 END)
SELECT g.segment_id, coalesce(r.origin, 'none') AS tier, r.who AS speaker, round(r.s, 6) AS similarity FROM g LEFT JOIN r ON g.segment_id = r.segment_id AND i = 1""")
def j3_three_tier_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable segments against all registered, then all stored speakers of their model."""
    known = cut(_known(spark, sf_dir))  # read four times: counted and fetched, for each tier
    pick = lambda origin: known.where(F.col("origin") == origin).select("model_id", F.col("who").alias("speaker"), "c")
    found = joins.three_tiers(usable_segments(spark, sf_dir), pick("registered"), pick("stored"), "segment_id", "u", "speaker", "c", on=["model_id"])
    return found.select("segment_id", "tier", "speaker", F.round("similarity", 6).alias("similarity"))


_AUTO = f"""WITH {_USABLE}, l AS (SELECT session_id, label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM g WHERE label LIKE 'auto:%'), m AS (SELECT session_id, label, p, avg(x) AS x FROM l GROUP BY ALL),
v AS (SELECT session_id, label, list(x ORDER BY p) AS v FROM m GROUP BY ALL), c AS (SELECT session_id, label AS center, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM v)"""


@query(_AUTO + """, s AS (SELECT g.session_id, g.segment_id, g.label, center, list_dot_product(u, c) AS s FROM g JOIN c USING (session_id) WHERE NOT coalesce(is_locked, false) AND len(u) = len(c)),
r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY s DESC, center) AS i FROM s)
SELECT session_id, label AS old_label, center AS new_label, count(*) AS n, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id) AS utterances, 'recluster' AS reason FROM r WHERE i = 1 AND s >= 0.5 AND label IS NOT NULL AND label <> center GROUP BY ALL""")
def c6_adaptive_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlocked utterances move to the nearest centre of their session if it is near enough; one row a change of labels."""
    rows = usable_segments(spark, sf_dir)
    centres = vector.centroids(rows.where(F.col("label").startswith("auto:")), ["session_id", "label"], "u").select("session_id", F.col("label").alias("center"), "centroid")
    found = clustering.adaptive_changes(rows, centres, "session_id", "segment_id", "label", "u", "center", "centroid", delta_new=0.5)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return found.select("session_id", "old_label", "new_label", "n", ids.alias("utterances"), "reason")


@query(f"""WITH {_C}, d AS (SELECT a.who AS a, b.who AS b, list_dot_product(a.c, b.c) AS s FROM c a, c b) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(greatest(1 - s, 0), 6) AS cost FROM d""")
def j18_cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vector.centroids(_units(spark, sf_dir), ["label"], "u")
    left, right = known.select(F.col("label").alias("a"), F.col("centroid").alias("x")), known.select(F.col("label").alias("b"), F.col("centroid").alias("y"))
    return left.crossJoin(right).select("a", "b", F.round(vector.cosine_distance(F.col("x"), F.col("y")), 6).alias("cost"))  # two sets of speakers


@query(f"""WITH {_U}, q AS (SELECT u AS q FROM u WHERE vec_id = 3) SELECT vec_id, round(1 - list_dot_product(u, q), 6) AS distance FROM u, q WHERE vec_id <> 3 ORDER BY 1 - list_dot_product(u, q), vec_id LIMIT 1""")
def o1_nearest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    one = F.broadcast(units.where("vec_id = 3").select(F.col("u").alias("q")))  # one row
    scored = units.where("vec_id != 3").join(one, F.lit(True)).select("vec_id", (1 - vector.dot(F.col("u"), F.col("q"))).alias("d"))
    return scored.orderBy("d", "vec_id").limit(1).select("vec_id", F.round("d", 6).alias("distance"))


@query("""SELECT label, count(*) AS n, CAST(greatest(2, count(*) // 20) AS BIGINT) AS least FROM embeddings GROUP BY label""")
def c2_min_cluster_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _e(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.greatest(F.lit(2).cast("long"), F.floor(F.count("*") / 20)).alias("least"))


def _as_stored(v: Column) -> Column:
    """The vector as it is, half the size of a unit one, for what takes its direction anyway; a very short one as a unit vector."""
    return F.when(F.exists(v, lambda x: F.abs(x) > 1e-6), v).otherwise(vector.unit(v).cast("array<float>"))


def _utterances(spark: SparkSession, sf_dir: str, unit: Callable[[Column], Column] = vector.unit) -> DataFrame:
    """Segments with a usable vector."""
    return usable_segments(spark, sf_dir, unit).select("session_id", F.col("segment_id").alias("utterance_id"), "label", "is_locked", F.col("u").alias("embedding"), "t_start", "t_end")


@query()
def c1_final_recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.final_recluster(cut(_utterances(spark, sf_dir, _as_stored))).drop("noise")  # read for the trees, too


def _changed(rows: DataFrame, *by: str) -> DataFrame:
    changed = rows.where("old_label is not null and old_label != label")
    return changed.groupBy(*by, "session_id", "old_label", "label").agg(F.sort_array(F.collect_list("utterance_id")).alias("utterances"), F.count("*").alias("n"))


@query()
def c7_label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(clustering.final_recluster(cut(_utterances(spark, sf_dir, _as_stored))))


@query()
def c7_post_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label changes of every scheduler that has passes after the stream."""
    rows = cut(_utterances(spark, sf_dir))  # read for every pass
    edges = cut(clustering.spanning_edges(rows))
    found, done = None, {}
    for scheduler, (*_, delta_new, post) in clustering.SCHEDULERS.items():
        if post:
            # Schedulers with the same passes have the same labels.
            if (post, delta_new) not in done:
                # Passes that begin like others go on from their labels.
                before = done.get((post[:-1], delta_new))
                now = rows if before is None else rows.drop("label").join(before.select("utterance_id", "label"), "utterance_id")
                after = clustering.post_pass(now, post if before is None else post[-1:], delta_new, edges=edges)
                if before is not None:
                    after = after.drop("old_label").join(before.select("utterance_id", "old_label"), "utterance_id").select(*before.columns)
                done[post, delta_new] = cut(after)
            own = done[post, delta_new].withColumn("scheduler", F.lit(scheduler))
            found = own if found is None else found.unionByName(own)
    return _changed(found, "scheduler")


@query()
def a28_cluster_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, clusters, noise before it was absorbed, online labels, and events for each window of 2 s that has any."""
    used = cut(_utterances(spark, sf_dir, _as_stored))
    rows = clustering.final_recluster(used)
    counts = rows.groupBy("session_id").agg(F.count("*").alias("input"), F.countDistinct("cluster").alias("clusters"), F.count_if("noise").alias("noise"), F.countDistinct("old_label").alias("online_labels"))
    windows = used.groupBy("session_id").agg((F.count("*") / F.countDistinct(F.floor(F.col("t_start") / 2))).alias("events_per_window"))
    return counts.join(windows, "session_id")


@query()
def t6_online_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _utterances(spark, sf_dir).withColumn("win", F.floor(F.col("t_start") / 2)).withColumn("activity", F.least(F.coalesce(F.col("t_end") - F.col("t_start"), F.lit(0.0)) / 2, F.lit(1.0)))
    return clustering.online_labels(rows, "session_id", "win", "utterance_id", "embedding", "activity", delta_new=0.5, tau_active=0.1)


@query()
def t11_identify_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered speakers first, then stored ones, then the letters of the session."""
    tiers = j3_three_tier_identify(spark, sf_dir).select(F.col("segment_id").alias("utterance_id"), F.regexp_replace("speaker", "#.*$", "").alias("known"))
    rows = _utterances(spark, sf_dir).withColumn("seconds", F.coalesce(F.col("t_end") - F.col("t_start"), F.lit(0.0))).join(tiers, "utterance_id")
    return clustering.identify_phrases(rows, "session_id", "utterance_id", "embedding", "seconds", known="known")


@query("""SELECT DISTINCT name, TRY_CAST(nullif(regexp_extract(name, '^anon_(\\d+)$', 1), '') AS BIGINT) AS number, CASE WHEN name SIMILAR TO 'anon_[0-9]+' THEN printf('anon_%03d', CAST(regexp_extract(name, '^anon_([0-9]+)$', 1) AS INT) + 1) END AS following FROM speaker""".replace("\\\\", "\\"))
def fn19_anon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = text.anon_number(F.col("name"))
    return table(spark, sf_dir, "speaker").select("name").distinct().select("name", number.alias("number"), F.when(number.isNotNull(), text.anon_name(number + 1)).alias("following"))


@query("""SELECT model_id, max(TRY_CAST(regexp_extract(name, '^anon_([0-9]+)$', 1) AS BIGINT)) AS highest, count(DISTINCT name) AS names FROM speaker GROUP BY model_id""")
def a23_max_anon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speaker").groupBy("model_id").agg(F.max(text.anon_number(F.col("name"))).alias("highest"), F.countDistinct("name").alias("names"))


@query("""SELECT name, model_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(utterance_count) AS BIGINT) AS utterances, min(registered_at) AS registered_at FROM (SELECT DISTINCT * FROM speaker) GROUP BY name, model_id""")
def a24_merge_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "speaker").distinct()
    return rows.groupBy("name", "model_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("utterance_count").alias("utterances"), F.min("registered_at").alias("registered_at"))


@query("""WITH s AS (SELECT DISTINCT speaker_id, name, origin, model_id FROM speaker), v AS (SELECT speaker_id, arg_max(vec_id, (updated_at, vec_id)) AS vec_id, count(*) AS vectors FROM speaker_vss WHERE speaker_id IS NOT NULL GROUP BY ALL)
SELECT s.speaker_id, s.name, s.origin, v.vec_id, coalesce(v.vectors, 0) AS vectors FROM s LEFT JOIN v USING (speaker_id)""")
def st10_current_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "speaker").select("speaker_id", "name", "origin", "model_id").distinct()
    v = table(spark, sf_dir, "speaker_vss").where("speaker_id is not null").groupBy("speaker_id").agg(F.max_by("vec_id", F.struct("updated_at", "vec_id")).alias("vec_id"), F.count("*").alias("vectors"))
    return s.join(v, "speaker_id", "left").select("speaker_id", "name", "origin", "vec_id", F.coalesce("vectors", F.lit(0)).cast("long").alias("vectors"))


@query("""SELECT vec_id, coalesce(len(centroid) = CASE model_id WHEN 'ecapa-tdnn' THEN 56 ELSE 64 END, false) AS fits FROM speaker_vss""")
def st9_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "speaker_vss")
    dims = table(spark, sf_dir, "speaker").groupBy("model_id").agg(F.max("embedding_dim").alias("dim"))
    return rows.join(dims, "model_id", "left").select("vec_id", F.coalesce(F.size("centroid") == F.col("dim"), F.lit(False)).alias("fits"))


@query("""WITH m AS (SELECT DISTINCT session_id, auto_id, candidate_id FROM speaker_candidate), p AS (SELECT * FROM (VALUES ('auto:A', 'alice'), ('auto:B', NULL)) v(auto_id, name)) SELECT candidate_id, m.auto_id, p.name, p.auto_id IS NULL AS missing FROM m LEFT JOIN p USING (auto_id)""")
def j11_persist_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("auto:A", "alice"), ("auto:B", None)], "auto_id string, name string").withColumn("hit", F.lit(True))
    rows = table(spark, sf_dir, "speaker_candidate").select("session_id", "auto_id", "candidate_id").distinct()
    return rows.join(wanted, "auto_id", "left").select("candidate_id", "auto_id", "name", F.col("hit").isNull().alias("missing"))


QUERIES, ORACLE = query.queries, query.oracle
