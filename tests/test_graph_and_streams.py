"""Graph traversals against brute force, streams over several micro-batches, storage and sources."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerting as L
from tidewatch.operators import lineage as G
from tidewatch.sources import readers as R
from tidewatch.sources import storage as S
from tidewatch.streaming import streams as X


def graph(spark, pairs):
    return spark.createDataFrame(pairs, f"{G.S} string, {G.T} string")


def closure(pairs, nodes):
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for n in nodes:
            more = set().union(*(reach[m] for m in reach[n])) if reach[n] else set()
            if not more <= reach[n]:
                reach[n] |= more
                grown = True
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    pairs = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(20)})
    reach = closure(pairs, nodes)
    want = {frozenset([n, *(m for m in nodes if m in reach[n] and n in reach[m])]) for n in nodes}
    node_df = spark.createDataFrame([(n,) for n in nodes], "node_id string")
    rows = G.strong_components(graph(spark, pairs), node_df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.component, set()).add(r.node_id)
    assert len(rows) == len(nodes) and {frozenset(v) for v in got.values()} == want
    assert G.is_acyclic(graph(spark, pairs)) == all(n not in reach[n] for n in nodes)


def test_acyclic(spark):
    assert G.is_acyclic(graph(spark, [("a", "b"), ("b", "c"), ("a", "c")]))
    assert not G.is_acyclic(graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")]))


def test_shortest_path(spark):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("d", "a"), ("q", "a")])
    path = lambda s, t: [r.node_id for r in G.shortest_path(edges, s, t).orderBy("step").collect()]
    assert path("a", "d") == ["a", "x", "d"]
    assert path("a", "q") == [] and path("a", "a") == ["a"] and path("zzz", "zzz") == []


def test_reach_keeps_the_smallest_depth(spark):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "a")])
    starts = spark.createDataFrame([("a",)], "node_id string")
    assert {r.node_id: r.depth for r in G.reach(edges, starts, 3).collect()} == {"b": 1, "c": 1, "d": 2, "e": 3}
    up = {r.node_id: r.depth for r in G.reach(edges, starts, 2, "upstream").collect()}
    assert up == {"e": 1, "d": 2}


def test_statistics_of_a_small_graph(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "node_id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "a", "t")], f"{G.S} string, {G.T} string, edge_type string")
    got = {(r["name"], r["item"]): r["value"] for r in G.statistics(nodes, edges).collect()}
    assert got[("is_dag", None)] == 0 and got[("connected_components", None)] == 2
    assert got[("graph_density", None)] == pytest.approx(2 / 6) and got[("node_type", "x")] == 2


def test_edges_are_sorted_out_without_whole_ids_in_a_task(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "node_id string")
    pairs = [("a", "b"), ("a", "b"), ("b", "x"), ("x", "c"), ("x", "y"), (None, "a"), ("c", None)]
    known, refused = G.add_edges(nodes, graph(spark, pairs))
    rows = lambda df: sorted(map(tuple, df.select(G.S, G.T).collect()), key=repr)
    assert rows(known) == [("a", "b"), ("a", "b")] and rows(refused) == sorted(pairs[2:], key=repr)
    for df in (known, refused):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan


BASE = dt.datetime(2024, 1, 1)


def write_files(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"in/d={i}"))
    return str(path / "in/*")


def run(writer):
    q = writer.start()
    q.awaitTermination()
    return q


def stream(spark, where, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


EVENTS = "k string, ts timestamp, event_id long"


def event_batches(n=4, size=60, seed=3):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(4000) for _ in range(n * size))
    rows = [(rnd.choice("aab"), BASE + dt.timedelta(seconds=t), i) for i, t in enumerate(times)]
    return [rows[i * size:(i + 1) * size] for i in range(n)]


def test_stream_cooldown_equals_batch(spark, tmp_path):
    batches = event_batches()
    where = write_files(spark, tmp_path, batches, EVENTS)
    every = spark.createDataFrame([r for b in batches for r in b], EVENTS).withColumn("cooldown_seconds", F.lit(90))
    want = {(r.k, r.event_id) for r in L.cooldown(every, ["k"]).collect()}
    cfg = X.StreamConfig("state", str(tmp_path / "cp1"))
    run(X.store_events(X.cooldown(stream(spark, where, EVENTS), "k", "ts", 90), cfg, str(tmp_path / "o1")))
    assert {(r.k, r.event_id) for r in spark.read.parquet(str(tmp_path / "o1")).collect()} == want
    cfg = X.StreamConfig("table", str(tmp_path / "cp2"))
    fn = X.cooldown_per_batch(str(tmp_path / "o2"), str(tmp_path / "s2"), ["k"], "ts", 90)
    run(X.each_batch(stream(spark, where, EVENTS), cfg, fn))
    assert len(list((tmp_path / "o2").glob("batch_id=*"))) == 4
    assert {(r.k, r.event_id) for r in spark.read.parquet(str(tmp_path / "o2")).collect()} == want


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    early = [("a", BASE + dt.timedelta(minutes=m), m) for m in (1, 2, 61)]
    later = [("a", BASE + dt.timedelta(minutes=240), 240)]
    again = [("a", BASE + dt.timedelta(minutes=250), 250)]  # lateness is judged by the watermark of the batch before
    late = [("a", BASE + dt.timedelta(minutes=3), 3), ("a", BASE + dt.timedelta(minutes=600), 600)]
    where = write_files(spark, tmp_path, [early, later, again, late], EVENTS)
    aggs = [F.count(F.lit(1)).alias("n")]
    out = X.window_aggregate(stream(spark, where, EVENTS), "ts", "1 hour", ["k"], aggs, watermark="10 minutes")
    run(X.store_events(out, X.StreamConfig("late", str(tmp_path / "cp")), str(tmp_path / "o")))
    got = {r.window_start: r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got[BASE] == 2  # the row at minute 3 came after its window was closed
    assert got[BASE + dt.timedelta(hours=1)] == 1


def test_deduplicate_across_batches(spark, tmp_path):
    where = write_files(spark, tmp_path, [[("a", BASE, 1), ("b", BASE, 2)], [("a", BASE, 1), ("c", BASE, 3)]], EVENTS)
    run(X.store_events(X.deduplicate(stream(spark, where, EVENTS), "ts"), X.StreamConfig("dd", str(tmp_path / "cp")), str(tmp_path / "o")))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2, 3]


def test_stream_escalation(spark, tmp_path):
    schema = "alert_id string, ts timestamp, kind string"
    at = lambda m: BASE + dt.timedelta(minutes=m)
    where = write_files(spark, tmp_path, [
        [("quiet", at(0), "raised"), ("handled", at(0), "raised"), ("slow", at(1), "raised")],
        [("handled", at(10), "acknowledge"), ("tick", at(20), "resolve")],
        [("slow", at(50), "resolve"), ("tick2", at(90), "resolve")],
        [("tick3", at(200), "resolve")],
    ], schema)
    out = X.escalations(stream(spark, where, schema), "alert_id", "ts", "kind", 30 * 60)
    run(X.store_events(out, X.StreamConfig("esc", str(tmp_path / "cp")), str(tmp_path / "o")))
    got = {r.alert_id: r.escalated_at for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"quiet": at(30), "slow": at(31)}


def escalation_by_hand(batches, delay, lag):
    """Per alert and micro-batch: one state, and the deadlines that the watermark has passed."""
    held, got, closed, newest = {}, [], 0, None
    for rows in [*batches, []]:
        for a in {r[0] for r in rows}:
            raised = [r[1] for r in rows if r[0] == a and r[2] == "raised"] + ([held[a]] if a in held else [])
            acted = [r[1] for r in rows if r[0] == a and r[2] != "raised"]
            if not raised:
                continue
            held.pop(a, None)
            due = min(raised) + delay
            if acted and min(acted) <= due:
                continue
            if acted or due <= closed:
                got.append((a, due))
            else:
                held[a] = min(raised)
        late = [a for a, t in held.items() if t + delay < closed and not any(r[0] == a for r in rows)]
        got += [(a, held.pop(a) + delay) for a in late]
        newest = max([r[1] for r in rows] + ([newest] if newest is not None else []))
        closed = max(closed, newest - lag)
    return sorted(got, key=repr)


@pytest.mark.parametrize("buckets", [1, 7])
def test_alerts_of_one_bucket_escalate_one_by_one(spark, tmp_path, buckets):
    rnd = random.Random(buckets)
    names = [None, *(f"alert{i}" for i in range(60))]
    batches = [[(rnd.choice(names), b * 3000 + rnd.randrange(200, 3000), rnd.choice(["raised", "raised", "acknowledge"])) for _ in range(60)] for b in range(4)]
    schema = "alert_id string, ts timestamp, kind string"
    at = lambda s: BASE + dt.timedelta(seconds=s)
    where = write_files(spark, tmp_path, [[(a, at(s), k) for a, s, k in rows] for rows in batches], schema)
    out = X.escalations(stream(spark, where, schema), "alert_id", "ts", "kind", 1800, buckets=buckets)
    run(X.store_events(out, X.StreamConfig(f"one{buckets}", str(tmp_path / "cp")), str(tmp_path / "o")))
    got = [(r.alert_id, r.escalated_at) for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    want = [(a, at(s)) for a, s in escalation_by_hand(batches, 1800, 60)]
    assert len(got) > 40 and sorted(got, key=repr) == sorted(want, key=repr)


def test_micro_batches_of_several_files(spark, monkeypatch):
    from tidewatch.plans import flows
    from tidewatch.sources.readers import Tables

    monkeypatch.setattr(flows, "FILE_ROWS", 30)
    rows = spark.range(1000).select("id", (F.col("id") % 10).alias("x"))
    numbers = "CASE WHEN x = 0 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END"
    cfg, path = flows.config(Tables(spark, "/nowhere"), "files")
    fn = lambda df, i: df.withColumn("at", F.spark_partition_id()).write.parquet(f"{path}/batch_id={i}")
    flows.finish(X.each_batch(flows.batch_stream(Tables(spark, "/nowhere"), rows, numbers, 3), cfg, fn))
    back = spark.read.parquet(path)
    assert back.count() == 1000 and back.where(f"batch_id <> {numbers}").count() == 0
    assert len(list(pathlib.Path(path).glob("batch_id=*"))) == 3


def test_unknown_tier_is_refused(spark):
    with pytest.raises(ValueError):
        S.check_tier("lukewarm")
    with pytest.raises(ValueError):
        R.read_files(spark, R.Source("x", "/nowhere", "docx"))


def test_retrieve_prunes_and_pushes_down(spark, tmp_path):
    rows = [(i, BASE + dt.timedelta(hours=i)) for i in range(100)]
    S.store(spark.createDataFrame(rows, "i int, ts timestamp"), str(tmp_path), "metrics", "hot", "ts")
    df = S.retrieve(spark, str(tmp_path), "hot", "metrics", "ts", BASE + dt.timedelta(hours=30), key="2024-01-02")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "data_type" in plan.split("PartitionFilters")[1]
    assert sorted(r.i for r in df.collect()) == list(range(30, 48))
    assert S.statistics(spark, str(tmp_path / "void")).count() == 0


def test_stream_source_options():
    src = R.Source("k", batch_size=25, options={"failOnDataLoss": "false"})
    opts = R.kafka_options(src, "topic", "host:9092")
    assert opts["maxOffsetsPerTrigger"] == "25" and opts["startingOffsets"] == "latest" and opts["failOnDataLoss"] == "false"
