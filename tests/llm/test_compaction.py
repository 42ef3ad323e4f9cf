import pytest

from foliant.llm.compaction import Conflict, ShardStore


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_append_compact_read(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), target_bytes=60_000, fan_in=4, smallest=1_000)
    docs = spark.range(4_000).selectExpr("id as doc_id", "if(id % 7 = 0, null, repeat(sha2(string(id), 256), 1)) as text", "5 as shard")
    for k in range(4):
        store.append(docs.where(f"doc_id % 4 = {k}").repartition(6))
    many = len(store.manifest()["shards"])
    want = rows_of(docs.select("doc_id", "text"))
    assert rows_of(store.read().select("doc_id", "text")) == want
    old = store.manifest()["version"]
    store.compact()
    after = store.manifest()
    assert len(after["shards"]) < many / 3 and max(s["bytes"] for s in after["shards"]) < 90_000
    assert rows_of(store.read().select("doc_id", "text")) == want
    assert rows_of(store.read(old).select("doc_id", "text")) == want  # old versions stay until they are vacuumed
    assert not store.plan(after["shards"])
    counts = {r["shard"]: r["count"] for r in store.read().groupBy("shard").count().collect()}
    assert counts == {i: s["rows"] for i, s in enumerate(after["shards"])}
    store.vacuum(keep=1)
    assert store.versions() == [after["version"]] and rows_of(store.read().select("doc_id", "text")) == want


def test_versions_are_never_overwritten(spark, tmp_path):
    a, b = (ShardStore(spark, str(tmp_path)) for _ in range(2))
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    added = b._write(one)
    a.append(one)
    assert b._commit(added, set(), None) == 2  # found version 1 taken
    assert a.read().count() == 2
    with pytest.raises(Conflict):
        a._commit([], {"data/gone"}, None)
    with pytest.raises(Conflict):
        a.append(spark.range(1))


def test_lost_files_are_invisible(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path))
    one = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    store.append(one)
    store._write(one)  # a driver lost before its commit
    assert store.read().count() == 3
    store.vacuum(keep=1)
    assert len(list((tmp_path / "data").iterdir())) == 1


def test_empty(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], "doc_id long, text string"))
    assert store.compact() == 1 and store.read().count() == 0


def test_plan_keeps_tiers_apart(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), target_bytes=100, fan_in=3, smallest=4)
    shards = [{"path": f"{i}", "bytes": n, "rows": 1} for i, n in enumerate([2, 3, 3, 30, 30, 90, 48, 35, 75, 201])]
    assert [[s["bytes"] for s in g] for g in store.plan(shards)] == [[2, 3, 3], [30, 30, 35]]
    shards = [{"path": f"{i}", "bytes": n, "rows": 9} for i, n in enumerate([60, 70, 74, 74, 201, 200])]
    assert [[s["bytes"] for s in g] for g in store.plan(shards)] == [[201], [60, 70], [74, 74]]


def test_large_arrivals_are_split(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), target_bytes=20_000, fan_in=2, smallest=1_000)
    docs = spark.range(4_000).selectExpr("id as doc_id", "sha2(string(id), 512) as text")
    store.append(docs.coalesce(1))
    store.append(docs.where("doc_id < 0"))
    before = store.manifest()["shards"]
    store.compact()
    after = store.manifest()["shards"]
    assert len(before) <= 2 and len(after) > 10 and max(s["bytes"] for s in after) <= 2 * 20_000
    assert rows_of(store.read().select("doc_id", "text")) == rows_of(docs)


def test_parts_of_the_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("foliant.llm.compaction.PART", 3)
    monkeypatch.setattr("foliant.llm.compaction.SENT", 2)
    monkeypatch.setattr("foliant.llm.compaction.WAVE", 1)
    store = ShardStore(spark, str(tmp_path), target_bytes=50_000, fan_in=4, smallest=100_000)
    docs = spark.range(800).selectExpr("id as doc_id", "sha2(string(id), 256) as text")
    for k in range(2):
        store.append(docs.where(f"doc_id % 2 = {k}").repartition(7))
    first, second = store.manifest(1), store.manifest(2)
    assert len(first["parts"]) == 3 and set(first["parts"]) < set(second["parts"]) and len(second["shards"]) == 14
    assert rows_of(store.read().select("doc_id", "text")) == rows_of(docs)
    assert sorted(r["shard"] for r in store.read().select("shard").distinct().collect()) == list(range(14))
    store.compact()
    assert rows_of(store.read().select("doc_id", "text")) == rows_of(docs) and rows_of(store.read(2).select("doc_id", "text")) == rows_of(docs)
    store.vacuum(keep=1)
    assert len([f for f in (tmp_path / "manifests").iterdir() if f.name.startswith("part-")]) == len(store.manifest()["parts"])
    assert rows_of(store.read().select("doc_id", "text")) == rows_of(docs)


def test_query_returns_every_document(spark):
    from foliant.llm.queries import op8_compaction

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "true", "sha2(text, 256)")
    assert sorted(map(tuple, op8_compaction(spark, folder).collect())) == sorted(map(tuple, docs.collect()))
