import pytest

from gridloom.llm.scratch import scratch_path
from gridloom.llm.sharding import Conflict, Shard, ShardStore, plan, shard


def table(spark, n=600):
    rows = [(i, None if i % 50 == 0 else "" if i % 51 == 0 else f"text {i} " * (1 + i % 40), "s", i % 7) for i in range(n)]
    rows += rows[:5] + [(None, "long " * 50_000, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, file string, shard int").repartition(6)


def test_round_trip_and_sizes(spark):
    docs = table(spark)
    store = shard(docs, target=60_000, small=10_000)
    last = store.manifest()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert not plan(last.shards, 60_000, 4) and 1 < len(last.shards) < 30 and max(s.bytes for s in last.shards) < 3 * 60_000 and sum(s.rows for s in last.shards) == docs.count()
    at = store.located("doc_id").collect()
    assert len(at) == docs.count() and {r.shard for r in at} == set(range(len(last.shards)))
    assert len(store.versions()) == 1
    assert store.located(*docs.columns).columns == [*docs.columns, "shard_", "shard_rows", "shard_bytes"] and store.located(*docs.columns).count() == docs.count()


def test_arrivals_versions_and_conflicts(spark):
    store = ShardStore(spark, scratch_path(spark, "test"))
    docs = table(spark, 200)
    first = store.append(docs, 5000)
    store.append(docs.limit(30), 5000)
    assert store.versions() == [1, 2] and store.read(1).count() == docs.count()
    store.compact(1 << 20)
    assert store.read().count() == docs.count() + 30 and store.read(1).count() == docs.count()
    with pytest.raises(Conflict):
        store._commit(None, first.schema, set(), [])
    assert store.read(1).count() == docs.count()
    store.vacuum()
    assert len(store.versions()) == 1 and store.read().count() == docs.count() + 30


def files(store):
    return {f.getPath().toString() for d in store.fs.listStatus(store._path("shards")) for f in store.fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")}


def test_vacuum_spares_a_writer(spark):
    """Shards that another writer has written and not committed stay until they are old."""
    store = ShardStore(spark, scratch_path(spark, "test"))
    docs = table(spark, 100)
    store.append(docs, 5000)
    pending = store._written(docs.limit(7), None)
    store.vacuum()
    assert {s.path for s in pending} <= files(store)
    store._commit(store.manifest(), store.manifest().schema, set(), pending)
    assert store.read().count() == docs.count() + 7
    stale = store._written(docs.limit(3), None)
    store.vacuum(old=0)
    assert not {s.path for s in stale} & files(store) and files(store) == {s.path for s in store.manifest().shards}


def test_parts_of_manifests(spark, monkeypatch):
    monkeypatch.setattr("gridloom.llm.sharding.PART_SHARDS", 5)
    store = ShardStore(spark, scratch_path(spark, "test"))
    docs = table(spark, 300)
    first = store.append(docs, 5000)
    second = store.append(docs.limit(20), 5000)
    assert len(first.parts) > 2 and all(len(s) <= 5 for _, s in second.parts)
    assert {p for p, s in first.parts if len(s) == 5} <= {p for p, _ in second.parts}  # full parts are shared
    store.compact(1 << 20)
    assert store.read().count() == docs.count() + 20 and store.read(1).count() == docs.count()
    store.vacuum(old=0)
    assert store.read().count() == docs.count() + 20 and len(store.fs.listStatus(store._path("parts"))) == len(store.manifest().parts)


def test_shards_follow_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id long, text string").coalesce(1)
    store = ShardStore(spark, scratch_path(spark, "test"))
    assert len(store.append(docs, 100_000).shards) in (4, 5)


def test_plan():
    small = tuple(Shard(f"a{k}", 1, 10) for k in range(10))
    assert [len(g) for g in plan(small, 40, 4)] == [4, 4, 2]
    assert plan(small[:3], 40, 4) == [] and plan((Shard("b", 1, 39), *small[:2]), 40, 2) == [[small[0], small[1]]]
    assert plan(tuple(Shard(f"c{k}", 1, 30) for k in range(9)), 40, 4) == []


def test_empty(spark):
    store = shard(spark.createDataFrame([], "doc_id long, text string"))
    assert store.read().collect() == [] and store.manifest().shards == () and store.located("doc_id").collect() == []
