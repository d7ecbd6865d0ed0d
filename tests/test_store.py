"""Batches of the store: whole or not there, pruned, compacted, migrated."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import commits
from quillspark.operators.commits import Conflict
from quillspark.operators.store import Store

T0 = datetime(2026, 5, 1, tzinfo=UTC)
ITEM = "canonical_hash string, url string, title string, summary string, published_at timestamp, ingested_at timestamp, metadata string, canonicalization_version int"
LABEL = "canonical_hash string, topic string, secondary_topics array<string>, score int, rationale string, classifier_version string, classifier_model string, classified_at timestamp"


def items(spark, hashes, at=T0):
    return spark.createDataFrame([(h, "u", h, None, None, at, "{}", 1) for h in hashes], ITEM)


def hashes(df):
    return sorted(r[0] for r in df.select("canonical_hash").collect())


@pytest.mark.parametrize("failing", ["activations", "classifications"])
def test_a_crash_between_two_writes_shows_nothing(spark, tmp_path, monkeypatch, failing):
    store = Store(spark, f"file://{tmp_path}/db")
    store.insert_or_ignore("items", items(spark, "ab"))
    label = spark.createDataFrame([("a", "x", [], 5, "r", "v", "m", T0)], LABEL)
    append = Store.append

    def broken(self, name, df):
        if name == failing:
            raise OSError("disk is gone")
        return append(self, name, df)

    with monkeypatch.context() as m:
        m.setattr(Store, "append", broken)
        with pytest.raises(OSError, match="gone"):
            store.classify(label)
    for reader in (store, Store(spark, store.path)):
        assert reader.read("classifications").isEmpty() and reader.active().isEmpty() and reader.classified().isEmpty()
    assert store.classify(label) == 0 and [r["topic"] for r in store.classified().collect()] == ["x"]
    assert store.vacuum() == (failing == "activations") and [r["topic"] for r in store.classified().collect()] == ["x"]


def test_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/db")
    with monkeypatch.context() as m:
        m.setattr(store.log, "commit", lambda batch: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.insert_or_ignore("items", items(spark, "ab"))
    assert store.read("items").isEmpty() and store.insert_or_ignore("items", items(spark, "ab")) == 2


def test_an_unfinished_commit_counts_as_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    (tmp_path / "db" / "_commits" / f"{store.log.last() + 1:012d}.json").write_text('{"batch": "x", "tab')
    assert store.insert_or_ignore("items", items(spark, "ab")) == 2 and hashes(Store(spark, store.path).items()) == ["a", "b"]


def test_two_writers(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/db") for _ in range(2))
    with one.transaction():
        one.insert_or_ignore("items", items(spark, "ab"))
        assert hashes(one.items()) == ["a", "b"] and two.items().isEmpty()
        two.append("followups_done", spark.createDataFrame([(1,)], "id long"))  # of no concern
    assert hashes(two.items()) == ["a", "b"]
    with pytest.raises(Conflict), one.transaction():
        one.insert_or_ignore("items", items(spark, "c"))
        two.insert_or_ignore("items", items(spark, "cd"))
    assert hashes(one.items()) == ["a", "b", "c", "d"] and one.audit_keys()["items"] == 0
    assert one.insert_or_ignore("items", items(spark, "ce")) == 1


def test_windows_read_the_batches_they_need(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    for day in range(4):
        store.insert_or_ignore("items", items(spark, [f"d{day}"], T0 + timedelta(days=day)))
    window = store.items(since=T0 + timedelta(days=1), until=T0 + timedelta(days=3))
    assert hashes(window) == ["d1", "d2"]
    read = store.read("items", T0 + timedelta(days=1), T0 + timedelta(days=3))
    assert "PartitionFilters: [_batch" in read._jdf.queryExecution().toString() and hashes(read) == ["d1", "d2"]
    assert hashes(store.items(since=T0 + timedelta(days=9))) == []


def test_compaction_keeps_the_views(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.insert_or_ignore("items", items(spark, "abcd"))
    for k, (loser, winner) in enumerate([("a", "b"), ("b", "c"), ("a", "d")]):
        store.supersede(spark.createDataFrame([(loser, winner)], "loser string, winner string"))
        store.classify(spark.createDataFrame([("d", f"t{k}", [], k, "r", "v", "m", T0)], LABEL))
    views = lambda: [sorted(map(str, v.collect())) for v in (store.supersessions(), store.active(), store.items(), store.classified(), store.read("items"))]
    before, rows = views(), store.read("activations").count()
    for name in ("supersessions", "activations", "items", "classifications", "weekly_entities"):
        store.compact(name)
    assert views() == before and store.read("activations").count() == 1 < rows
    assert store.vacuum() > 3 and views() == before
    store.supersede(spark.createDataFrame([("c", "d")], "loser string, winner string"))
    assert hashes(store.items()) == ["d"]


def test_migrations(spark, tmp_path, monkeypatch):
    loose = f"file://{tmp_path}/db/items"
    items(spark, "ab").withColumn("canonicalization_version", F.when(F.col("canonical_hash") == "b", 2)).write.parquet(loose)
    store = Store(spark, f"file://{tmp_path}/db")
    assert sorted((r["canonical_hash"], r["canonicalization_version"]) for r in store.items().collect()) == [("a", 1), ("b", 2)]
    assert store.log.version() == 2 and commits.migrate(store) == []
    done = []

    def broken(s):
        s.append("followups_done", spark.createDataFrame([(1,)], "id long"))
        if not done:
            done.append(1)
            raise OSError("half way")

    with pytest.raises(OSError):
        commits.migrate(store, commits.MIGRATIONS | {3: broken})
    assert store.log.version() == 2 and store.read("followups_done").isEmpty()
    assert commits.migrate(store, commits.MIGRATIONS | {3: broken}) == [3] and store.read("followups_done").count() == 1
