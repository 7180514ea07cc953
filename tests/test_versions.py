"""Versions on plain files: one of two writers fails, a failed writer leaves nothing that is read, a change rewrites its buckets only."""

import threading

import pytest
from pyspark.sql import functions as F

from factloom.sources.versions import GraphFiles, StaleVersion

NODE = "id string, name string, attributes map<string,string>"


def ids(df):
    return sorted((r["id"], r["name"]) for r in df.collect())


def test_versions_change_their_buckets_only(spark, tmp_path):
    files = GraphFiles(spark, f"file://{tmp_path}/g", buckets=16)
    assert files.version().number == 0 and files.versions() == []
    nodes = spark.createDataFrame([(f"n{k}", f"name {k}", {"a": str(k)}) for k in range(400)], NODE)
    out = files.save(0, nodes=nodes, edges=nodes.select("id", F.lit("e").alias("name")))
    assert out["nodes_count"] == 400 and out["nodes_buckets"] == 16
    first = files.version(1)
    delta = spark.createDataFrame([("n7", "seven", {}), ("new", "one more", {})], NODE)
    out = files.save(1, nodes=delta, now="t2")
    assert out == {"version": 2, "nodes_count": 401, "nodes_buckets": out["nodes_buckets"], "nodes_written": out["nodes_written"]} and out["nodes_buckets"] <= 2 and out["nodes_written"] < 110
    second = files.version()
    same = [b for b in first.folders["nodes"] if first.folders["nodes"][b] == second.folders["nodes"].get(b)]
    assert len(same) >= 14 and second.folders["edges"] == first.folders["edges"] and second.updated_at == "t2"
    want = {f"n{k}": f"name {k}" for k in range(400)}
    assert ids(files.read("nodes", 1)) == sorted(want.items())
    assert ids(files.read("nodes")) == sorted((want | {"n7": "seven", "new": "one more"}).items())
    out = files.save(2, remove={"nodes": nodes.where("id <> 'n7'").select("id")})
    assert ids(files.read("nodes")) == [("n7", "seven"), ("new", "one more")] and out["nodes_count"] == 2
    out = files.save(3, remove={"nodes": files.read("nodes").select("id")})
    assert files.read("nodes").collect() == [] and out["nodes_count"] == 0 and ids(files.read("nodes", 2)) and files.forget(keep=1) >= 2
    assert files.versions() == [4] and files.read("edges").count() == 400
    with pytest.raises(KeyError):
        files.read("nodes", 1)


def test_of_two_writers_one_fails(spark, tmp_path):
    files = GraphFiles(spark, f"file://{tmp_path}/g", buckets=4)
    files.save(0, nodes=spark.createDataFrame([("a", "0", {})], NODE))
    with pytest.raises(StaleVersion):
        files.save(0, nodes=spark.createDataFrame([("a", "late", {})], NODE))
    # both have read version 1, and both are past the check when they publish
    plain, barrier, results = GraphFiles._publish, threading.Barrier(2), []

    def together(self, version):
        barrier.wait(60)
        plain(self, version)

    def write(name):
        try:
            results.append(GraphFiles(spark, f"file://{tmp_path}/g").save(1, nodes=spark.createDataFrame([("a", name, {}), (name, name, {})], NODE))["version"])
        except StaleVersion:
            results.append(None)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(GraphFiles, "_publish", together)
        writers = [threading.Thread(target=write, args=(n,)) for n in "xy"]
        for w in writers:
            w.start()
        for w in writers:
            w.join()
    assert sorted(results, key=str) == [2, None]
    rows = ids(files.read("nodes"))
    assert rows in ([("a", "x"), ("x", "x")], [("a", "y"), ("y", "y")])


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    files = GraphFiles(spark, f"file://{tmp_path}/g", buckets=4)
    files.save(0, nodes=spark.createDataFrame([("a", "0", {})], NODE))

    def dies(self, version):
        raise OSError("no more room")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(GraphFiles, "_publish", dies)
        with pytest.raises(OSError):
            files.save(1, nodes=spark.createDataFrame([("b", "1", {})], NODE))
    assert files.versions() == [1] and ids(files.read("nodes")) == [("a", "0")]
    assert sum(1 for p in (tmp_path / "g" / "data").iterdir()) == 1
    assert files.save(1, nodes=spark.createDataFrame([("b", "1", {})], NODE))["nodes_count"] == 2
