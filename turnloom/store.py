"""A store of speaker profiles on immutable snapshots: each change writes a new version and marks it complete.

One writer at a time; readers take the highest complete version and keep the one they opened. A writer that is
lost leaves a version without mark, which nobody reads and whose number is not used again. Profiles are unique
by name and model.
"""

from __future__ import annotations

import os
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import anon_number
from .functions.vector import cosine, l2_normalize, mean_vectors, unit

SPEAKERS = "speaker_id string, name string, origin string, embedding_dim int, model_id string, registered_at double, first_seen double, last_seen double, utterance_count bigint"
VECTORS = "speaker_id string, seq bigint, embedding array<double>"
CENTROIDS = "speaker_id string, centroid array<double>, model_id string, updated_at double"


class IntegrityError(ValueError):
    """A second profile with the same name and model."""


class SpeakerStore:
    """Profiles, their vectors and their centroids as three parquet tables a version.

    ``root`` is a folder all executors share; ``dim`` and ``model_id`` are what new vectors must have.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int, model_id: str):
        self.spark, self.root, self.dim, self.model_id = spark, root.rstrip("/"), dim, model_id

    @staticmethod
    def from_url(spark: SparkSession, url: str, dim: int, model_id: str) -> "SpeakerStore":
        """``memory://`` (a folder that goes with the session) or ``parquet://<folder>``; other schemes are an error."""
        scheme, sep, rest = url.partition("://")
        if not sep or scheme.lower() not in ("memory", "parquet"):
            raise ValueError(f"unknown storage {url!r}: memory:// or parquet://<folder>")
        if scheme.lower() == "memory":
            from .session import checkpoint_dir

            rest = f"{checkpoint_dir(spark)}/store-{uuid.uuid4()}"
        return SpeakerStore(spark, rest, dim, model_id)

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _versions(self) -> list[int]:
        """Numbers of all versions begun, ascending."""
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))

    def _version(self) -> int:
        """The highest complete version; 0 if there is none."""
        fs, jvm = self._fs()
        return next((v for v in reversed(self._versions()) if fs.exists(jvm.org.apache.hadoop.fs.Path(self._path(f"v{v}/_DONE")))), 0)

    def init_schema(self) -> None:
        """Create empty tables; does nothing if they are there."""
        if self._version() == 0:
            self._write(*(self.spark.createDataFrame([], s) for s in (SPEAKERS, VECTORS, CENTROIDS)))

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        v = self._version()
        if v == 0:
            return tuple(self.spark.createDataFrame([], s) for s in (SPEAKERS, VECTORS, CENTROIDS))
        return tuple(self.spark.read.parquet(self._path(f"v{v}/{t}")) for t in ("speakers", "vectors", "centroids"))

    def _write(self, speakers: DataFrame, vectors: DataFrame, centroids: DataFrame) -> None:
        v = max(self._versions(), default=0) + 1
        for name, df in (("speakers", speakers), ("vectors", vectors), ("centroids", centroids)):
            df.write.mode("overwrite").parquet(self._path(f"v{v}/{name}"))
        fs, jvm = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(self._path(f"v{v}/_DONE")), False).close()

    def load(self, speakers: DataFrame, vectors: DataFrame) -> None:
        """Add many profiles and their vectors at once; two of one name and model, or a name that is taken, are an error.

        ``speakers`` and ``vectors`` have the store's columns. Equal rows count once.
        """
        have, own, centroids = self._tables()
        new = speakers.select(have.columns).distinct()
        both = have.unionByName(new)
        if both.groupBy("name", "model_id").count().where("count > 1").limit(1).count():
            raise IntegrityError("a name is taken for its model")
        added = vectors.select(own.columns).distinct()
        models = new.select("speaker_id", "model_id")
        sound = added.join(models.select("speaker_id"), "speaker_id", "left_semi").withColumn("u", unit(F.col("embedding")))
        means = mean_vectors(sound, ["speaker_id"], "u").join(models, "speaker_id")
        made = means.select("speaker_id", l2_normalize(F.col("mean")).alias("centroid"), "model_id", F.lit(time.time()).alias("updated_at"))
        self._write(both, own.unionByName(added), centroids.unionByName(made))

    def _check(self, vector: list[float]) -> list[float]:
        if len(vector) != self.dim:
            raise ValueError(f"a vector of {len(vector)} numbers; the store has {self.dim}")
        return [float(x) for x in vector]

    def _centroids(self, vectors: DataFrame, ids: DataFrame, model_id: str) -> DataFrame:
        own = vectors.join(ids, "speaker_id", "left_semi").withColumn("u", l2_normalize(F.col("embedding")))
        means = mean_vectors(own, ["speaker_id"], "u")
        return means.select("speaker_id", l2_normalize(F.col("mean")).alias("centroid"), F.lit(model_id).alias("model_id"), F.lit(time.time()).alias("updated_at"))

    def _one(self, speakers: DataFrame, name: str) -> str | None:
        row = speakers.where((F.col("name") == name) & (F.col("model_id") == self.model_id)).select("speaker_id").first()
        return row and row[0]

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _add_vector(self, vectors: DataFrame, sid: str, vector: list[float]) -> DataFrame:
        n = vectors.where(F.col("speaker_id") == sid).count()
        return vectors.unionByName(self._rows([(sid, n, vector)], VECTORS))

    def register(self, name: str, vector: list[float], now: float | None = None) -> str:
        """Add a vector to the profile of that name, or make one; a stored profile stays stored and gets its time of registration."""
        vector, now = self._check(vector), time.time() if now is None else now
        speakers, vectors, centroids = self._tables()
        sid = self._one(speakers, name)
        if sid is None:
            sid = str(uuid.uuid4())
            speakers = speakers.unionByName(self._rows([(sid, name, "registered", self.dim, self.model_id, now, now, now, 0)], SPEAKERS))
        else:
            hit = F.col("speaker_id") == sid
            speakers = speakers.withColumns({"registered_at": F.when(hit, F.coalesce("registered_at", F.lit(now))).otherwise(F.col("registered_at")), "last_seen": F.when(hit, F.lit(now)).otherwise(F.col("last_seen"))})
        self._save(speakers, self._add_vector(vectors, sid, vector), centroids, sid)
        return sid

    def _save(self, speakers: DataFrame, vectors: DataFrame, centroids: DataFrame, sid: str) -> None:
        ids = self._rows([(sid,)], "speaker_id string")
        self._write(speakers, vectors, centroids.where(F.col("speaker_id") != sid).unionByName(self._centroids(vectors, ids, self.model_id)))

    def save(self, vector: list[float], name: str | None = None, now: float | None = None, utterances: int = 0) -> str:
        """A stored profile; without a name the next ``anon_NNN`` of the model."""
        vector, now = self._check(vector), time.time() if now is None else now
        speakers, vectors, centroids = self._tables()
        if name is None:
            top = speakers.where(F.col("model_id") == self.model_id).agg(F.max(anon_number(F.col("name")))).first()[0] or 0
            name = f"anon_{top + 1:03d}"
        elif self._one(speakers, name):
            raise IntegrityError(f"{name!r} exists for {self.model_id}")
        sid = str(uuid.uuid4())
        speakers = speakers.unionByName(self._rows([(sid, name, "stored", self.dim, self.model_id, None, now, now, utterances)], SPEAKERS))
        self._save(speakers, self._add_vector(vectors, sid, vector), centroids, sid)
        return sid

    def find_match(self, vector: list[float], origin: str = "any", least: float | None = None) -> tuple[str, str, float] | None:
        """Name, origin and similarity of the best profile: registered ones first (0.70), then stored ones (0.75)."""
        vector = self._check(vector)
        speakers, _, centroids = self._tables()
        probe = F.array(*[F.lit(x) for x in vector])
        tiers = {"registered": 0.70, "stored": 0.75}
        for tier, threshold in tiers.items():
            if origin not in ("any", tier):
                continue
            own = speakers.where((F.col("model_id") == self.model_id) & (F.col("origin") == tier)).join(centroids.select("speaker_id", "centroid"), "speaker_id")
            best = own.select("name", cosine(F.col("centroid"), probe).alias("s")).where(F.col("s") >= (threshold if least is None else least)).orderBy(F.desc("s"), "name").first()
            if best:
                return best["name"], tier, best["s"]
        return None

    def list_all(self, origin: str | None = None) -> DataFrame:
        """All profiles, or those of one origin."""
        speakers = self._tables()[0]
        return speakers.where(F.col("origin") == origin) if origin else speakers

    def set_alias(self, speaker_id: str, name: str) -> None:
        """Rename a profile; a name taken for its model is an error, and so is an unknown profile."""
        speakers, vectors, centroids = self._tables()
        row = speakers.where(F.col("speaker_id") == speaker_id).first()
        if row is None:
            raise KeyError(speaker_id)
        if speakers.where((F.col("name") == name) & (F.col("model_id") == row["model_id"]) & (F.col("speaker_id") != speaker_id)).first():
            raise IntegrityError(f"{name!r} exists for {row['model_id']}")
        self._write(speakers.withColumn("name", F.when(F.col("speaker_id") == speaker_id, F.lit(name)).otherwise(F.col("name"))), vectors, centroids)

    def merge(self, source: str, target: str) -> None:
        """Give the source's vectors, times and counts to the target and delete the source."""
        if source == target:
            raise ValueError("a profile can't be merged with itself")
        speakers, vectors, centroids = self._tables()
        both = speakers.where(F.col("speaker_id").isin(source, target))
        if both.count() != 2:
            raise ValueError("source and target must both exist")
        t = both.agg(F.min("first_seen").alias("f"), F.max("last_seen").alias("l"), F.sum("utterance_count").alias("n")).first()
        hit = F.col("speaker_id") == target
        speakers = speakers.where(F.col("speaker_id") != source).withColumns(
            {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (("first_seen", t["f"]), ("last_seen", t["l"]), ("utterance_count", t["n"]))}
        )
        shift = vectors.where(F.col("speaker_id") == target).count()
        moved = F.col("speaker_id") == source
        vectors = vectors.select(F.when(moved, F.lit(target)).otherwise(F.col("speaker_id")).alias("speaker_id"), F.when(moved, F.col("seq") + shift).otherwise(F.col("seq")).alias("seq"), "embedding")
        self._save(speakers, vectors, centroids.where(F.col("speaker_id") != source), target)

    def delete(self, speaker_id: str) -> bool:
        """Remove a profile with its vectors and centroid; whether it was there."""
        tables = self._tables()
        if tables[0].where(F.col("speaker_id") == speaker_id).first() is None:
            return False
        self._write(*(t.where(F.col("speaker_id") != speaker_id) for t in tables))
        return True
