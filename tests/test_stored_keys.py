"""Stored tables whose partition values are null, look like numbers, or need escaping."""

from __future__ import annotations

from tidewatch.operators import lifecycle, lineage, retention
from tidewatch.sources import storage

ROWS = [
    (0, None, "2020-01-01"), (1, "007", "2020-01-01"), (2, "007", "2024-01-01"), (3, "7", "2020-01-01"), (4, "12", "2024-01-01"),
    (5, "a/b=c %", "2020-01-01"), (6, "a/b=c %", "2024-01-01"), (7, "x/y=1", "2020-01-01"), (8, None, None),
]


def test_purge_removes_only_expired_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "id int, k string, ts string").selectExpr("id", "k", "timestamp(ts) AS ts").write.partitionBy("k").parquet(path)
    assert retention.purge_partitions(spark, path, "ts", "2024-02-01", 365, ["k"]) == 5
    left = storage.read_text_keys(spark, path, ["k"]).select("id", "k").collect()
    assert sorted(map(tuple, left)) == [(2, "007"), (4, "12"), (6, "a/b=c %"), (8, None)]
    assert retention.purge_partitions(spark, path, "ts", "2024-02-01", 365, ["k"]) == 0


def test_register_takes_one_of_each_pair(spark):
    registry = spark.createDataFrame([("m", "v1")], "model_id string, version string")
    rows = [("m", "v1", 5), ("m", "v2", 3), ("m", "v2", 2), ("m", "v2", 2), ("n", "v1", 1)]
    taken, refused = lifecycle.register(registry, spark.createDataFrame(rows, "model_id string, version string, created_at int"))
    assert sorted(map(tuple, taken.collect())) == [("m", "v2", 2), ("n", "v1", 1)]
    assert sorted(map(tuple, refused.collect())) == [("m", "v1", 5), ("m", "v2", 2), ("m", "v2", 3)]


def test_path_and_cycle_of_any_length(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 12}") for i in range(12)], "source_node_id string, target_node_id string")
    assert lineage.shortest_path(ring, "n0", "n11").count() == 12
    assert not lineage.is_acyclic(ring)
    assert lineage.is_acyclic(ring.filter("source_node_id <> 'n11'"))


def test_long_path_is_marked_in_few_rounds(spark):
    """A thousand steps beside a bush of other nodes: each round doubles what is known of the path."""
    rows = [("p0", None, 0)] + [(f"p{i}", f"p{i - 1}", i) for i in range(1, 1001)] + [(f"x{i}", f"p{i % 900}", i % 900 + 1) for i in range(2000)]
    seen = spark.createDataFrame(rows, "node_id string, parent string, step int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("path", "path")
    got = lineage.path_back(seen, "p1000", 1000).collect()
    jobs = len(tracker.getJobIdsForGroup("path"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.step, r.node_id) for r in got) == [(i, f"p{i}") for i in range(1001)]
    assert jobs <= 120, jobs  # each round materialises two tables, in a few jobs each


def test_long_cycles_and_chains_are_contracted(spark):
    """A long cycle, two cycles joined by a long chain, and a loop: what only passes on goes in a few rounds."""
    names = "source_node_id string, target_node_id string"
    ring = [(f"r{i}", f"r{(i + 1) % 400}") for i in range(400)]
    two = [("a0", "a1"), ("a1", "a0"), ("b0", "b1"), ("b1", "b2"), ("b2", "b0"), ("a1", "c0"), *[(f"c{i}", f"c{i + 1}") for i in range(100)], ("c100", "b0"), ("l", "l")]
    edges = spark.createDataFrame(ring + two, names)
    short, rounds = lineage._contracted(lineage._peeled(edges.where("source_node_id <> target_node_id")))
    assert len(rounds) < 30 and short.count() < 40
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in ring + two for x in e} | {"free"})], "node_id string")
    got = {}
    for r in lineage.strong_components(edges, nodes).collect():
        assert r.node_id not in got
        got[r.node_id] = r.component
    assert len({got[f"r{i}"] for i in range(400)}) == 1 and got["a0"] == got["a1"] != got["b0"] == got["b1"] == got["b2"]
    assert all(got[f"c{i}"] == f"c{i}" for i in range(101)) and got["free"] == "free" and len(got) == nodes.count()
