import threading

import pytest
from pyspark.sql import functions as F

from cuemill.sources import progress, srt


def rows(spark, *items):
    return spark.createDataFrame([(m, s, lang, None) for m, s, lang in items], srt.PROGRESS)


def state(store, version=None):
    return {r.media_id: (r.status, r.language) for r in store.read(version).collect()}


def test_snapshots(spark, tmp_path):
    store = progress.ProgressStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and state(store) == {} and store.vacuum() == 0
    assert store.upsert(rows(spark, ("a", "done", "en"), ("b", "failed", None))) == 1
    assert store.upsert(rows(spark, ("b", "done", None), ("c", "new", "ja"), ("b", "done", None))) == 2
    assert state(store) == {"a": ("done", "en"), "b": ("done", None), "c": ("new", "ja")}
    assert store.upsert(rows(spark, ("a", None, "fr"))) == 3 and state(store)["a"] == ("done", "fr")  # null fields keep their value
    assert state(store, 1) == {"a": ("done", "en"), "b": ("failed", None)}
    assert store.vacuum(keep=2) == 1 and state(store, 2)["c"] == ("new", "ja")


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    stores = [progress.ProgressStore(spark, f"file://{tmp_path}/store") for _ in range(4)]
    errors = []

    def put(k):
        try:
            stores[k].upsert(rows(spark, (f"m{k}", "done", None), ("shared", f"s{k}", None)))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=put, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and stores[0].version() == 4
    assert set(state(stores[0])) == {"m0", "m1", "m2", "m3", "shared"}


def test_the_second_writer_merges_again(spark, tmp_path, monkeypatch):
    one, two = (progress.ProgressStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    commit, came = one._commit, []

    def late(version, folder):
        if not came:
            came.append(two.upsert(rows(spark, ("b", "done", None))))
        commit(version, folder)

    monkeypatch.setattr(one, "_commit", late)
    assert one.upsert(rows(spark, ("a", "done", None))) == 2 and state(one) == {"a": ("done", None), "b": ("done", None)}


def test_a_crash_before_the_commit_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = progress.ProgressStore(spark, f"file://{tmp_path}/store")
    store.upsert(rows(spark, ("a", "done", None)))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.upsert(rows(spark, ("b", "done", None)))
    assert store.version() == 1 and state(store) == {"a": ("done", None)}
    assert store.upsert(rows(spark, ("c", "done", None))) == 2 and store.vacuum(keep=9) == 1
    assert set(state(store)) == {"a", "c"}
    # a writer that is told that its version is taken goes on from what is there
    with pytest.raises(progress.Conflict):
        store._commit(2, "v-other")
    assert store.read().where(F.col("status").isNull()).count() == 0
