"""The contract of the profile store."""

import pytest

from turnloom.store import IntegrityError, SpeakerStore


@pytest.fixture
def store(spark):
    s = SpeakerStore.from_url(spark, "memory://", 2, "m1")
    s.init_schema()
    return s


def test_register_match_and_delete(store):
    a = store.register("ann", [1.0, 0.0], now=10.0)
    assert store.register("ann", [0.0, 1.0], now=20.0) == a
    assert store.find_match([1.0, 1.0])[:2] == ("ann", "registered")
    assert store.find_match([-1.0, 0.0]) is None
    with pytest.raises(ValueError):
        store.register("bob", [1.0])
    assert store.delete(a) and not store.delete(a) and store.list_all().count() == 0


def test_names_and_merge(store):
    a, b = store.save([1.0, 0.0], now=1.0, utterances=2), store.save([0.0, 1.0], now=5.0, utterances=3)
    assert sorted(r.name for r in store.list_all("stored").collect()) == ["anon_001", "anon_002"]
    with pytest.raises(IntegrityError):
        store.save([1.0, 0.0], name="anon_001")
    with pytest.raises(IntegrityError):
        store.set_alias(a, "anon_002")
    store.set_alias(a, "eve")
    with pytest.raises(ValueError):
        store.merge(a, a)
    with pytest.raises(ValueError):
        store.merge("nobody", a)
    store.merge(b, a)
    row = store.list_all().collect()
    assert len(row) == 1 and (row[0].name, row[0].first_seen, row[0].last_seen, row[0].utterance_count) == ("eve", 1.0, 5.0, 5)
    assert store.find_match([1.0, 1.0], origin="stored")[0] == "eve"


def test_addresses(spark):
    with pytest.raises(ValueError):
        SpeakerStore.from_url(spark, "mysql://x", 2, "m")


def test_a_lost_writer_leaves_the_last_complete_version(spark, store):
    store.save([1.0, 0.0], name="eve", now=1.0)
    was = store._version()
    # A writer that is lost after its tables, before its mark.
    spark.createDataFrame([("x",)], "speaker_id string").write.parquet(store._path(f"v{was + 1}/speakers"))
    assert store._version() == was and [r.name for r in store.list_all().collect()] == ["eve"]
    store.save([0.0, 1.0], name="bob", now=2.0)
    assert store._version() == was + 2 and sorted(r.name for r in store.list_all().collect()) == ["bob", "eve"]


def test_loading_many(spark, store):
    speakers = spark.createDataFrame([("1", "ann", "stored", 2, "m1", None, 1.0, 2.0, 3), ("2", "bob", "registered", 2, "m1", 1.0, 1.0, 2.0, 3)] * 2, store.list_all().schema)
    vectors = spark.createDataFrame([("1", 0, [3.0, 0.0]), ("1", 1, [0.0, 1.0]), ("2", 0, [-1.0, 0.0])], "speaker_id string, seq bigint, embedding array<double>")
    store.load(speakers, vectors)
    assert store.list_all().count() == 2 and store.find_match([1.0, 1.0])[:2] == ("ann", "stored") and store.find_match([-1.0, 0.0])[:2] == ("bob", "registered")
    with pytest.raises(IntegrityError):
        store.load(speakers, vectors)
