"""Lineage graph as node and edge tables; traversals are rounds of joins.

Edges: ``(source_node_id, target_node_id, …)``.  Iterative operators write
their state to the shared checkpoint folder every round, so neither the plan
nor the recovery work grows with the number of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import quoted, union_all
from tidewatch.session import cut_lineage

S, T = "source_node_id", "target_node_id"


def add_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are both nodes, and the refused ones.

    Repeated nodes do no harm to semi and anti joins, so no task has to hold the ids to make them distinct.  The number of
    partitions is fixed: ids compress so well that AQE would put millions of them together in one sort, and they are merged:
    by the size of their files they would be broadcast.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = nodes.select("node_id").repartition(parts, "node_id")
    sources, targets = (ids.select(F.col("node_id").alias(c)).hint("merge") for c in (S, T))
    known = edges.join(sources, S, "left_semi").join(targets, T, "left_semi").select(*[quoted(c) for c in edges.columns])
    no_source = edges.join(sources, S, "left_anti")
    no_target = edges.join(sources, S, "left_semi").join(targets, T, "left_anti")
    return known, no_source.unionByName(no_target)


def track(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of tracked flows, validations and aggregations.

    ``events``: ``(event_id, kind, subtype, source_ids ARRAY, target_id, ts)``
    with kind ``flow`` (transformation node between source and target),
    ``validation`` (node hanging off the data) or ``aggregation`` (several
    sources into one target).
    """
    kind = F.col("kind")
    middle = F.concat(
        F.when(kind == "flow", "transformation_").when(kind == "validation", "validation_").otherwise("aggregation_"),
        F.col("event_id").cast("string"),
    )
    e = events.withColumn("__mid", middle)
    name = F.when(kind == "flow", F.concat("subtype", F.lit("_transformation"))).when(
        kind == "validation", F.lit("data_validation")
    ).otherwise(F.concat("subtype", F.lit("_aggregation")))
    nodes = e.select(
        F.col("__mid").alias("node_id"),
        F.when(kind == "flow", "transformation").otherwise(kind).alias("node_type"),
        name.alias("name"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    into = F.when(kind == "flow", "flows_to").when(kind == "validation", "validates").otherwise("aggregates")
    incoming = F.transform(
        "source_ids", lambda s: F.struct(s.alias(S), F.col("__mid").alias(T), into.alias("edge_type"))
    )
    outgoing = F.when(
        kind != "validation",
        F.array(F.struct(F.col("__mid").alias(S), F.col("target_id").alias(T), F.lit("flows_to").alias("edge_type"))),
    ).otherwise(F.array().cast(f"array<struct<{S}:string,{T}:string,edge_type:string>>"))
    edges = e.select(F.col("ts").alias("created_at"), F.inline(F.concat(incoming, outgoing)))
    return nodes, edges


def neighbours(edges: DataFrame, node_id: str, direction: str = "downstream") -> DataFrame:
    """Direct successors or predecessors of a node."""
    near, far = (S, T) if direction == "downstream" else (T, S)
    return edges.filter(F.col(near) == node_id).select(F.col(far).alias("node_id")).distinct()


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 3, direction: str = "downstream") -> DataFrame:
    """Nodes reached from each start within ``max_depth`` steps: ``(start_id, node_id, depth)``, smallest depth.

    ``starts`` has a column ``node_id``.  A frontier holds every node once per
    start, so a hub is expanded once per round.
    """
    near, far = (S, T) if direction == "downstream" else (T, S)
    steps = edges.select(F.col(near).alias("__from"), F.col(far).alias("__to")).distinct()
    frontier = starts.select(F.col("node_id").alias("start_id"), F.col("node_id").alias("__at"))
    parts = []
    for depth in range(1, max_depth + 1):
        frontier = (
            frontier.join(steps, F.col("__at") == F.col("__from")).select("start_id", F.col("__to").alias("__at")).distinct()
        )
        parts.append(frontier.select("start_id", F.col("__at").alias("node_id"), F.lit(depth).alias("depth")))
    return union_all(parts).groupBy("start_id", "node_id").agg(F.min("depth").alias("depth"))


def node_lineage(edges: DataFrame, artifacts: DataFrame | None, node_id: str, max_depth: int = 3) -> DataFrame:
    """Upstream and downstream nodes to ``max_depth`` and artifacts of a node: ``(relation, item)``."""
    start = edges.sparkSession.createDataFrame([(node_id,)], "node_id string")
    parts = [
        reach(edges, start, max_depth, d).select(F.lit(d).alias("relation"), F.col("node_id").alias("item"))
        for d in ("upstream", "downstream")
    ]
    if artifacts is not None:
        own = artifacts.filter(F.col("source_node_id") == node_id)
        parts.append(own.select(F.lit("artifact").alias("relation"), F.col("artifact_id").alias("item")))
    return union_all(parts)


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One shortest path as ``(step, node_id)``; no rows when there is none; the smallest predecessor on a tie.

    Breadth first: each round joins the frontier with the edges and keeps the
    nodes not seen before; the way back follows the stored predecessors.
    """
    spark = edges.sparkSession
    # a node without any edge is still on its own path only if it is in the graph
    if source == target:
        present = edges.filter((F.col(S) == source) | (F.col(T) == source)).limit(1)
        return present.select(F.lit(0).alias("step"), F.lit(source).alias("node_id"))
    steps = edges.select(S, T).distinct()
    frontier = spark.createDataFrame([(source, None, 0)], "node_id string, parent string, step int")
    seen = cut_lineage(frontier)
    for depth in count(1):
        grown = (
            seen.filter(F.col("step") == depth - 1).join(steps, F.col("node_id") == F.col(S))
            .groupBy(F.col(T).alias("__next")).agg(F.min("node_id").alias("parent"))
        )
        fresh = grown.join(seen.select(F.col("node_id").alias("__next")), "__next", "left_anti").select(
            F.col("__next").alias("node_id"), "parent", F.lit(depth).alias("step")
        )
        seen = cut_lineage(seen.unionByName(fresh))
        last = seen.filter(F.col("step") == depth)
        if not last.limit(1).count():
            return seen.limit(0).select("step", "node_id")
        if last.filter(F.col("node_id") == target).limit(1).count():
            break
    return path_back(seen, target, depth)


def path_back(seen: DataFrame, target: str, depth: int) -> DataFrame:
    """``(step, node_id)`` on the way back from ``target`` at step ``depth`` along the stored ``parent``s.

    Parent pointers are doubled: after ``k`` rounds the last ``2 ** k`` nodes of the path are marked, so the rounds grow
    with the logarithm of the path and nothing of it passes through the driver.
    """
    jump = seen.select("node_id", F.col("parent").alias("__up")).where("__up is not null")
    path = seen.where(F.col("node_id") == target).select("node_id")
    for _ in range(depth.bit_length()):
        path = cut_lineage(path.union(path.join(jump, "node_id").select(F.col("__up").alias("node_id"))))
        further = jump.select(F.col("node_id").alias("__up"), F.col("__up").alias("__next"))
        jump = cut_lineage(jump.join(further, "__up").select("node_id", F.col("__next").alias("__up")))
    return seen.join(path, "node_id", "left_semi").select("step", "node_id")


def is_acyclic(edges: DataFrame) -> bool:
    """Peel nodes without incoming edges until nothing changes; acyclic if no edge is left."""
    left = cut_lineage(edges.select(S, T).distinct())
    size = left.count()
    while size:
        inner = left.select(F.col(T).alias("__n")).distinct()
        # both ends are peeled: an edge into a node without outgoing edges lies on no cycle either
        outer = left.select(F.col(S).alias("__m")).distinct()
        nxt = left.join(inner, F.col(S) == F.col("__n"), "left_semi").join(outer, F.col(T) == F.col("__m"), "left_semi")
        left = cut_lineage(nxt)
        now = left.count()
        if now == size:
            return False
        size = now
    return True


def _spread(labels: DataFrame, edges: DataFrame, near: str, far: str) -> DataFrame:
    """Smallest label along edges ``near → far`` within the same group, to a fixed point.

    ``labels``: ``(node_id, grp, label)``; ``edges``: ``(source, target)`` ids.
    """
    while True:
        offered = (
            labels.join(edges, F.col("node_id") == F.col(near)).select(F.col(far).alias("__n"), F.col("grp").alias("__g"), F.col("label").alias("__l"))
            .groupBy("__n", "__g").agg(F.min("__l").alias("__l"))
        )
        joined = labels.join(offered, (F.col("node_id") == F.col("__n")) & F.col("grp").eqNullSafe(F.col("__g")), "left")
        nxt = cut_lineage(joined.select(
            "node_id", "grp", F.least("label", F.coalesce("__l", "label")).alias("label"),
            (F.coalesce("__l", "label") < F.col("label")).alias("changed"),
        ))
        moved = nxt.filter("changed").limit(1).count()
        labels = nxt.drop("changed")
        if not moved:
            return labels


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have edges in and out, to a fixed point: all that can lie on a cycle."""
    size = edges.count()
    while size:
        src = edges.select(F.col(S).alias("__m")).distinct()
        dst = edges.select(F.col(T).alias("__n")).distinct()
        edges = cut_lineage(edges.join(dst, F.col(S) == F.col("__n"), "left_semi").join(src, F.col(T) == F.col("__m"), "left_semi"))
        now = edges.count()
        if now == size:
            break
        size = now
    return edges


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges without the nodes that only pass on, and the nodes taken out: ``(node_id, before, after)`` per round.

    Such a node has one edge in and one out and is on a cycle exactly if the edge that replaces it is.  Each round takes out
    those whose hash is smaller than their neighbours' (no two of them are neighbours), about a third, so a chain or
    cycle of any length is gone after rounds that grow with its logarithm.
    """
    rounds: list[DataFrame] = []
    size = edges.count()
    while size:
        out = edges.groupBy(F.col(S).alias("node_id")).agg(F.count(F.lit(1)).alias("o"), F.min(T).alias("after"))
        into = edges.groupBy(F.col(T).alias("node_id")).agg(F.count(F.lit(1)).alias("i"), F.min(S).alias("before"))
        single = cut_lineage(out.join(into, "node_id").where("o = 1 AND i = 1").select("node_id", "before", "after"))
        order = lambda c: F.struct(F.xxhash64(c), F.col(c))
        beside = single.select(F.explode(F.array("before", "after")).alias("other"), "node_id").join(single.select(F.col("node_id").alias("other")), "other")
        held = beside.where(order("other") < order("node_id")).select("node_id").distinct()
        gone = cut_lineage(single.join(held, "node_id", "left_anti"))
        if gone.count() * 20 < size:  # few pass on: not worth a round
            return edges, rounds
        rounds.append(gone)
        ends = gone.select("node_id")
        kept = edges.join(ends.withColumnRenamed("node_id", S), S, "left_anti").join(ends.withColumnRenamed("node_id", T), T, "left_anti").select(S, T)
        new = gone.where("before <> after").select(F.col("before").alias(S), F.col("after").alias(T))
        edges = cut_lineage(kept.union(new).distinct())
        size = edges.count()
    return edges, rounds


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Strongly connected components ``(node_id, component)``; the component is named by one of its nodes.

    Nodes on no cycle are peeled first and nodes that only pass on are contracted.  Of the rest, rounds of forward
    colouring: every open node takes the smallest id that reaches it within its group; within a colour, the nodes that
    reach the colour's own node are one component and are closed.
    """
    ids = nodes.select("node_id")  # repeats do no harm to semi and anti joins
    ends = lambda df: df.select(F.col(S).alias("node_id")).union(df.select(T)).distinct()
    cyclic = _peeled(cut_lineage(edges.filter(F.col(S) != F.col(T)).select(S, T).distinct()))
    core = cut_lineage(ends(cyclic))
    short, rounds = _contracted(cyclic)
    open_edges = _peeled(short)
    left = ends(open_edges)
    taken = union_all([left, *[gone.select("node_id") for gone in rounds]])
    alone = cut_lineage(core.join(taken, "node_id", "left_anti"))
    found = [alone.select("node_id", F.col("node_id").alias("component"))]
    labels = cut_lineage(left.select("node_id", F.lit(None).cast("string").alias("grp"), F.col("node_id").alias("label")))
    while labels.limit(1).count():  # every round closes at least one component of each colour
        colour = _spread(labels, open_edges, S, T)
        # walk backwards from the colour's own node inside the colour
        marked = cut_lineage(colour.select(
            "node_id", F.col("label").alias("grp"), F.when(F.col("node_id") == F.col("label"), 0).otherwise(1).alias("label")
        ))
        inside = open_edges.join(colour.select(F.col("node_id").alias(S), F.col("label").alias("__a")), S).join(
            colour.select(F.col("node_id").alias(T), F.col("label").alias("__b")), T
        ).filter(F.col("__a") == F.col("__b")).select(S, T)
        inside = cut_lineage(inside)
        back = _spread(marked, inside, T, S)
        found.append(back.filter("label = 0").select("node_id", F.col("grp").alias("component")))
        rest = back.filter("label = 1").select("node_id", "grp")
        open_edges = cut_lineage(inside.join(rest.select(F.col("node_id").alias(S)), S, "left_semi").join(
            rest.select(F.col("node_id").alias(T)), T, "left_semi"))
        labels = cut_lineage(rest.select("node_id", "grp", F.col("node_id").alias("label")))
    known = cut_lineage(union_all(found))
    for gone in reversed(rounds):  # back in: with its neighbours if these are together, else alone
        side = lambda c: known.select(F.col("node_id").alias(c), F.col("component").alias(f"c_{c}"))  # noqa: E731,B023
        placed = gone.join(side("before"), "before").join(side("after"), "after")
        known = cut_lineage(known.union(placed.select("node_id", F.when(F.col("c_before") == F.col("c_after"), F.col("c_before")).otherwise(F.col("node_id")))))
    return known.union(ids.join(core, "node_id", "left_anti").select("node_id", F.col("node_id")))


def statistics(nodes: DataFrame, edges: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Counts by type, density, acyclicity and number of strong components: ``(name, value)``.

    Self-loops count for the component of their node only.
    """
    none = F.lit(None).cast("string")
    n = nodes.agg(F.count_distinct("node_id").alias("n"))
    m = edges.agg(F.count(F.lit(1)).alias("m"), F.count_distinct(S, T).alias("d"))
    comps = strong_components(edges, nodes).agg(F.count_distinct("component").alias("v"), F.count(F.lit(1)).alias("c"))
    loops = edges.agg(F.count_if(F.col(S) == F.col(T)).alias("loops"))
    # without cycles every component is one node, and no edge leads from a node to itself
    dag = comps.unionByName(loops, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("v", "c", "loops")])
    density = n.unionByName(m, allowMissingColumns=True).agg(F.max("n").alias("n"), F.max("d").alias("d"))

    def row(df: DataFrame, name: str, value: Column, item: Column = none) -> DataFrame:
        return df.select(F.lit(name).alias("name"), item.alias("item"), value.cast("double").alias("value"))

    count = F.count(F.lit(1)).alias("c")
    parts = [
        row(n, "total_nodes", F.col("n")),
        row(m, "total_edges", F.col("m")),
        row(density, "graph_density", F.coalesce(F.try_divide(F.col("d").cast("double"), F.col("n") * (F.col("n") - 1)), F.lit(0.0))),
        row(dag, "is_dag", ((F.col("v") == F.col("c")) & (F.col("loops") == 0)).cast("int")),
        row(comps, "connected_components", F.col("v")),
        row(nodes.groupBy("node_type").agg(count), "node_type", F.col("c"), F.col("node_type")),
        row(edges.groupBy("edge_type").agg(count), "edge_type", F.col("c"), F.col("edge_type")),
    ]
    if artifacts is not None:
        parts.append(row(artifacts.agg(count), "total_artifacts", F.col("c")))
    return union_all(parts)


def purge(
    nodes: DataFrame, edges: DataFrame, artifacts: DataFrame, now: Column, days: int = 30
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and artifacts not older than ``days``; edges of removed nodes go too."""
    cutoff = now - F.make_dt_interval(days=F.lit(days))
    kept = nodes.filter(F.col("updated_at") >= cutoff)
    gone = nodes.filter(F.col("updated_at") < cutoff).select("node_id")
    live = edges.filter(F.col("created_at") >= cutoff)
    for end in (S, T):
        live = live.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    return kept, live.select(*[quoted(c) for c in edges.columns]), artifacts.filter(F.col("created_at") >= cutoff)


def export_json(nodes: DataFrame, edges: DataFrame, artifacts: DataFrame | None, path: str) -> None:
    """Write the graph as JSON folders ``nodes``, ``edges`` and ``artifacts``."""
    tables: Sequence[tuple[str, DataFrame | None]] = (("nodes", nodes), ("edges", edges), ("artifacts", artifacts))
    for name, df in tables:
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
