import pytest

from pyspark.sql import functions as F

from countylens import storage
from countylens.sources import store

SCHEMA = "state string, id long, text string"


def ids(spark, path):
    return sorted(r.id for r in store.read(spark, path).collect())


@pytest.fixture
def path(spark, tmp_path):
    at = str(tmp_path / "a'b [store]")
    store.create(spark, at, spark.createDataFrame([], SCHEMA).schema, buckets=4)
    return at


def rows(spark, numbers):
    return spark.createDataFrame([("FL", n, f"t{n}") for n in numbers], SCHEMA)


def test_each_id_is_stored_once(spark, path):
    assert ids(spark, path) == []
    assert store.append(rows(spark, [1, 1, 2, None]), path, "monday")
    assert store.append(rows(spark, [2, 3, 3]), path, "tuesday")
    assert not store.append(rows(spark, [9]), path, "tuesday")
    assert [i for i in map(lambda r: r.id, store.read(spark, path).collect()) if i is not None and i > 0] != []
    assert sorted(r.id for r in store.read(spark, path).filter("id is not null").collect()) == [1, 2, 3]
    assert store.runs(spark, path) == ["monday", "tuesday"]
    with pytest.raises(ValueError, match="already"):
        store.create(spark, path, rows(spark, []).schema)


def test_killed_run_is_repeated(spark, path, monkeypatch):
    """A run that is lost after its files and before its record has stored nothing; run again, all once."""
    store.append(rows(spark, range(5)), path, "a")
    with monkeypatch.context() as lost:
        lost.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.append(rows(spark, range(10)), path, "b")
    assert ids(spark, path) == list(range(5))
    assert store.append(rows(spark, range(10)), path, "b")
    assert ids(spark, path) == list(range(10))
    assert len(store.clean(spark, path)) == 1 and ids(spark, path) == list(range(10))


def test_two_runs_at_once(spark, path, monkeypatch):
    """A run whose number is taken meanwhile compares with what the other has stored."""
    commit, once = store._commit, []

    def raced(*a):
        if not once:
            once.append(1)
            store.append(rows(spark, [2, 3]), path, "other")
        return commit(*a)

    monkeypatch.setattr(store, "_commit", raced)
    assert store.append(rows(spark, [1, 2]), path, "mine")
    assert ids(spark, path) == [1, 2, 3] and store.runs(spark, path) == ["other", "mine"]


def test_stored_side_is_not_shuffled(spark, path, plan):
    """A file per bucket and run; the join with new rows exchanges these alone."""
    store.append(rows(spark, range(100)), path, "a")
    files = store.read(spark, path).inputFiles()
    assert len(files) == 4
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = rows(spark, range(200)).join(store.read(spark, path).select("id"), "id", "left_anti")
        text = plan(fresh)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert fresh.count() == 100
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text


def test_merged_runs(spark, path):
    for k in range(3):
        store.append(rows(spark, range(k, k + 20)), path, f"run {k}")
    store.merge(spark, path)
    assert ids(spark, path) == list(range(22)) and len(store.read(spark, path).inputFiles()) == 4
    assert len(store.clean(spark, path)) == 3 and ids(spark, path) == list(range(22))
    assert store.runs(spark, path) == ["run 0", "run 1", "run 2"]
    store.merge(spark, path)
    assert not store.append(rows(spark, [99]), path, "run 1") and ids(spark, path) == list(range(22))


def test_records_are_placed_whole(spark, tmp_path):
    at = f"{tmp_path}/x/r.json"
    assert storage.put_record(spark, at, {"a": "\u00e9"}) and not storage.put_record(spark, at, {"a": 2})
    assert storage.record(spark, at) == {"a": "\u00e9"}
    assert storage.names(spark, f"{tmp_path}/x") == ["r.json"] and storage.names(spark, f"{tmp_path}/y") == []


def test_work_tables(spark):
    folder = storage.work_folder(spark, "test")
    back = storage.staged(spark.range(3).withColumn("x", F.lit("y")), folder)
    assert back.count() == 3 and storage.exists(spark, folder)
    storage.remove(spark, folder)
    assert not storage.exists(spark, folder)
