"""Queries over sources, storage, history, catalogue, lineage and retention."""

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import archive as A
from tidewatch.operators import catalog as K
from tidewatch.operators import lineage as G
from tidewatch.operators import retention as T
from tidewatch.plans.registry import query, stamp, tidy
from tidewatch.session import checkpoint_dir
from tidewatch.sources import envelope as E
from tidewatch.sources import history as H
from tidewatch.sources import storage as S
from tidewatch.sources.readers import Source, read_files


def scratch(spark) -> str:
    """New folder inside the shared checkpoint folder, for sinks that are read back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidewatch-{uuid.uuid4().hex}"


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ---- sources ----


def _register_formats():
    for fmt in ("csv", "json", "parquet", "orc"):

        @query(f"source_{fmt}", "SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, p_retailprice FROM part")
        def run(t, fmt=fmt):
            part = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
            path = scratch(t.spark)
            part.write.format(fmt).save(path)
            back = read_files(t.spark, Source("parts", path, fmt, part.schema))
            return tidy(back)


_register_formats()


@query(
    "source_envelope",
    """SELECT event_id, value, 'events' AS source_id, '2024-02-01 00:00:00' AS "timestamp", 'events_' || epoch(TIMESTAMP '2024-02-01')::BIGINT AS batch_id FROM events""",
)
def source_envelope(t):
    wrapped = E.wrap(t.events, "events", F.lit("2024-02-01").cast("timestamp"))
    flat = wrapped.select("data.event_id", "data.value", "metadata.*")
    return flat.withColumn("timestamp", stamp("timestamp"))


@query("source_unwrap", "SELECT event_id, user_id, value FROM events")
def source_unwrap(t):
    return E.unwrap(E.wrap(t.events.select("event_id", "user_id", "value"), "events"))


@query(
    "source_recent_records",
    "SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC LIMIT 100",
)
def source_recent_records(t):
    return E.recent_records(t.events, "click", 100, "event_type").select("event_id", "value")


@query("source_pending_counts", "SELECT source, count(*) AS queue_size FROM documents GROUP BY 1")
def source_pending_counts(t):
    return E.pending_counts(t.documents, "source")


# ---- storage ----


@query(
    "storage_partition_keys",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS by_date, strftime(o_orderdate, '%Y-%m-%d-%H') AS by_hour,
      coalesce(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END, 'unknown') AS by_field,
      (('0x' || substr(md5(o_custkey::VARCHAR), 1, 8))::BIGINT % 16)::VARCHAR AS by_hash FROM orders""",
)
def storage_partition_keys(t):
    o = t.orders.withColumn("maybe", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")))
    ts = F.col("o_orderdate")
    return o.select(
        "o_orderkey",
        S.partition_key(None, ts).alias("by_date"),
        S.partition_key({"type": "hour"}, ts).alias("by_hour"),
        S.partition_key({"type": "field", "field": "maybe"}, ts).alias("by_field"),
        S.partition_key({"type": "hash", "field": "o_custkey", "num_partitions": 16}, ts).alias("by_hash"),
    )


@query(
    "storage_warm_kind",
    "SELECT event_id, CASE WHEN event_type IN ('metrics', 'logs', 'traces') OR event_id % 2 = 0 THEN 'structured' ELSE 'document' END AS warm_kind FROM events",
)
def storage_warm_kind(t):
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("metrics")).otherwise(F.col("event_type"))
    return t.events.select("event_id", S.warm_kind(kind).alias("warm_kind"))


def tiered(t):
    """Events stored by tier: recent ones hot, older ones warm, oldest cold, one class refused."""
    day = F.day(F.col("ts").cast("timestamp"))
    tier = F.when(day > 20, "hot").when(day > 10, "warm").when(day > 1, "cold").otherwise("lukewarm")
    rows = t.events.select("event_id", "ts", "user_id", "value").withColumn("tier", tier)
    base = scratch(t.spark)
    refused = S.store_by_tier(rows, base, "metrics", "tier", "ts")
    return base, refused


@query(
    "storage_retrieve_hot",
    """SELECT event_id, value FROM events WHERE day(ts) > 20 AND ts BETWEEN TIMESTAMP '2024-01-22 06:00:00' AND TIMESTAMP '2024-01-24 18:00:00' ORDER BY ts DESC LIMIT 400""",
)
def storage_retrieve_hot(t):
    base, _ = tiered(t)
    out = S.retrieve(t.spark, base, "hot", "metrics", "ts", "2024-01-22 06:00:00", "2024-01-24 18:00:00", limit=400)
    return out.select("event_id", "value")


@query(
    "storage_retrieve_cold_partition",
    "SELECT event_id, value FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05'",
)
def storage_retrieve_cold_partition(t):
    base, _ = tiered(t)
    return S.retrieve(t.spark, base, "cold", "metrics", "ts", key="2024-01-05").select("event_id", "value")


@query("storage_refused_rows", "SELECT event_id FROM events WHERE day(ts) = 1")
def storage_refused_rows(t):
    return tiered(t)[1].select("event_id")


@query(
    "storage_statistics",
    """SELECT CASE WHEN day(ts) > 20 THEN 'hot' WHEN day(ts) > 10 THEN 'warm' ELSE 'cold' END AS tier, 'metrics' AS data_type, strftime(ts, '%Y-%m-%d') AS partition_key,
      count(*) AS rows, true AS has_bytes FROM events WHERE day(ts) > 1 GROUP BY 1, 2, 3""",
)
def storage_statistics(t):
    base, _ = tiered(t)
    s = S.statistics(t.spark, base)
    return s.select("tier", "data_type", "partition_key", "rows", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("has_bytes"))


@query(
    "storage_document_side",
    "SELECT event_id, user_id, value FROM events",
)
def storage_document_side(t):
    base = scratch(t.spark)
    src = t.events.select("event_id", "ts", "user_id", "value")
    S.store(src, base, "alerts", "warm", "ts", {"type": "hash", "field": "user_id", "num_partitions": 4})
    docs = S.retrieve(t.spark, base, "warm", "alerts", "ts")
    parsed = F.from_json("document", "event_id bigint, user_id bigint, value double")
    return docs.select(parsed.alias("d")).select("d.*")


@query("storage_batch", "SELECT c_custkey, c_name FROM customer")
def storage_batch(t):
    path = scratch(t.spark)
    S.store_batch(t.customer.select("c_custkey", "c_name"), path)
    return S.retrieve_batch(t.spark, path)


@query(
    "history_kept",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20""",
)
def history_kept(t):
    return H.kept(t.events, ["user_id"], limit=20, tiebreak=["event_id"]).select("user_id", "event_id")


@query(
    "history_append_and_read",
    "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def history_append_and_read(t):
    path = scratch(t.spark)
    results = t.events.select(F.col("event_type").alias("feature"), "ts", "event_id", "value")
    H.append(results, path, ["feature"])
    return H.history(t.spark.read.parquet(path), "feature", "error", tiebreak=["event_id"]).select("event_id", "value")


@query(
    "history_window",
    "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'",
)
def history_window(t):
    return H.in_window(t.events, "7D", F.lit("2024-01-20")).select("event_id")


@query(
    "report_export_csv",
    "SELECT 'events' AS source, event_type AS metric, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, value FROM events",
)
def report_export_csv(t):
    path = scratch(t.spark)
    series = t.events.select(F.lit("events").alias("source"), F.col("event_type").alias("metric"), "ts", "value")
    H.export_report(series, path, "csv")
    schema = "source string, metric string, timestamp timestamp_ntz, value double"
    return t.spark.read.schema(schema).csv(path, header=True).withColumn("timestamp", stamp("timestamp"))


@query("report_export_json", "SELECT 'events' AS source, event_type AS metric, value FROM events")
def report_export_json(t):
    path = scratch(t.spark)
    series = t.events.select(F.lit("events").alias("source"), F.col("event_type").alias("metric"), "ts", "value")
    H.export_report(series, path, "json")
    return t.spark.read.schema("source string, metric string, value double").json(path)


# ---- catalogue: every customer stands for a dataset, orders for its versions ----

NOW = "2001-09-01"


def now():
    return F.lit(NOW).cast("timestamp")


@query(
    "catalog_row_hash",
    """SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name})::VARCHAR) AS hash FROM customer""",
)
def catalog_row_hash(t):
    c = t.customer
    return c.select("c_custkey", K.row_hash(c, ["c_name", "c_mktsegment", "c_custkey"]).alias("hash"))


CHECKSUM_SQL = """h AS (SELECT sha256(to_json({{'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}})::VARCHAR) AS h FROM orders {where}),
  c AS (SELECT count(*) AS row_count, sha256(count(*) || '|' || """ + " || '|' || ".join(
    f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT)" for i in range(4)
) + """) AS checksum FROM h)"""


def order_ids(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("catalog_checksum", f"WITH {CHECKSUM_SQL.format(where='')} SELECT row_count, checksum FROM c")
def catalog_checksum(t):
    return K.checksum(order_ids(t))


@query(
    "catalog_integrity",
    "SELECT true AS is_intact, count(*) AS now_row_count, count(*) AS stored_row_count FROM orders",
)
def catalog_integrity(t):
    shuffled = order_ids(t).repartition(7, "o_custkey")
    return K.integrity(shuffled, K.checksum(order_ids(t)))


@query(
    "catalog_integrity_broken",
    "SELECT false AS is_intact, count(*) AS now_row_count, count(*) AS stored_row_count FROM orders",
)
def catalog_integrity_broken(t):
    changed = order_ids(t).withColumn("o_custkey", F.when(F.col("o_orderkey") == 7, -1).otherwise(F.col("o_custkey")))
    return K.integrity(changed, K.checksum(order_ids(t)))


@query(
    "catalog_register",
    f"""WITH {CHECKSUM_SQL.format(where='')} SELECT 'orders' AS dataset_id, '1.0' AS version, row_count, 4 AS column_count, checksum, '{NOW} 00:00:00' AS created_at FROM c""",
)
def catalog_register(t):
    d = K.describe(order_ids(t), "orders", now(), tags=["sales"], owner="ops", source="erp", quality=0.9)
    return d.select("dataset_id", "version", "row_count", "column_count", "checksum", stamp("created_at").alias("created_at"))


@query(
    "catalog_first_versions",
    """SELECT 'd' || c_custkey AS dataset_id, '1.0' AS version, strftime(TIMESTAMP '2001-01-01' + to_days((c_custkey % 240)::INT), '%Y-%m-%d %H:%M:%S') AS ts,
    '{"reason": "first load"}' AS changes FROM customer""",
)
def catalog_first_versions(t):
    return tidy(K.version_entry(datasets(t), {"reason": "first load"}))


DATASETS_SQL = """datasets AS (SELECT 'd' || c_custkey AS dataset_id, '1.0' AS version, TIMESTAMP '2001-01-01' + to_days((c_custkey % 240)::INT) AS updated_at,
  TIMESTAMP '2000-01-01' + to_days((c_custkey % 300)::INT) AS created_at, c_mktsegment AS owner, 'n' || c_nationkey AS data_source, (c_custkey % 100) / 100.0 AS data_quality_score,
  c_custkey * 10 AS row_count, c_mktsegment AS tag1, 'n' || (c_nationkey % 3) AS tag2 FROM customer)"""


def datasets(t):
    k = F.col("c_custkey")
    days = lambda base, n: F.lit(base).cast("timestamp") + F.make_dt_interval(days=(k % n).cast("int"))
    return t.customer.select(
        F.concat(F.lit("d"), k.cast("string")).alias("dataset_id"), F.lit("1.0").alias("version"),
        days("2001-01-01", 240).alias("updated_at"), days("2000-01-01", 300).alias("created_at"),
        F.col("c_mktsegment").alias("owner"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("data_source"),
        ((k % 100) / 100.0).alias("data_quality_score"), (k * 10).alias("row_count"),
        F.array(F.col("c_mktsegment"), F.concat(F.lit("n"), (F.col("c_nationkey") % 3).cast("string"))).alias("tags"),
    )


VERSIONS_SQL = "versions AS (SELECT 'd' || o_custkey AS dataset_id, 'v' || o_orderkey AS version, o_orderdate AS ts FROM orders)"


def versions(t):
    return t.orders.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"), F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


EDGES_SQL = """edges AS (SELECT 'd' || (o_custkey) AS source_id, 'd' || (o_orderkey % 1500) AS target_id, o_orderdate AS ts FROM orders)"""


def catalog_edges(t):
    return t.orders.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.concat(F.lit("d"), (F.col("o_orderkey") % 1500).cast("string")).alias("target_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


@query(
    "catalog_update",
    f"""WITH {DATASETS_SQL} SELECT dataset_id, '1.1' AS version, owner || '-x' AS owner, row_count, '{NOW} 00:00:00' AS updated_at,
      '{{"owner":"' || owner || '-x","version":"1.1"}}' AS changes FROM datasets WHERE data_quality_score < 0.3""",
)
def catalog_update(t):
    d = datasets(t)
    changes = d.filter("data_quality_score < 0.3").select(
        "dataset_id", F.lit("1.1").alias("version"), F.concat("owner", F.lit("-x")).alias("owner"))
    rows, entries = K.update(d, changes, now())
    both = rows.join(entries.select("dataset_id", "changes"), "dataset_id")
    return both.select("dataset_id", "version", "owner", "row_count", stamp("updated_at").alias("updated_at"), "changes")


@query(
    "catalog_search",
    f"""WITH {DATASETS_SQL} SELECT dataset_id FROM datasets WHERE tag1 = 'BUILDING' AND tag2 = 'n1' AND data_quality_score BETWEEN 0.2 AND 0.8 AND row_count >= 1000
      AND created_at >= TIMESTAMP '2000-02-01' AND created_at <= TIMESTAMP '2000-09-01'""",
)
def catalog_search(t):
    return K.search(datasets(t), {
        "tags": ["BUILDING", "n1"], "min_quality_score": 0.2, "max_quality_score": 0.8, "min_row_count": 1000,
        "created_after": F.lit("2000-02-01").cast("timestamp"), "created_before": F.lit("2000-09-01").cast("timestamp"),
    }).select("dataset_id")


@query(
    "catalog_search_owner",
    f"WITH {DATASETS_SQL} SELECT dataset_id FROM datasets WHERE owner = 'MACHINERY' AND data_source = 'n7' AND row_count <= 100000000",
)
def catalog_search_owner(t):
    return K.search(datasets(t), {"owner": "MACHINERY", "data_source": "n7", "max_row_count": 100000000}).select("dataset_id")


@query(
    "catalog_version_history",
    f"WITH {VERSIONS_SQL} SELECT version, {stamp_sql('ts')} AS ts FROM versions WHERE dataset_id = 'd7' ORDER BY versions.ts DESC, version DESC LIMIT 10",
)
def catalog_version_history(t):
    return tidy(K.version_history(versions(t), "d7").select("version", "ts"))


LIVE_SQL = f"""{EDGES_SQL}, live AS (SELECT source_id, target_id, max(ts) AS ts FROM edges WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY GROUP BY 1, 2)"""


@query(
    "catalog_direct_lineage",
    f"""WITH {EDGES_SQL} SELECT source_id, target_id, {stamp_sql('max(ts)')} AS ts FROM edges WHERE (source_id = 'd7' OR target_id = 'd7') AND ts >= TIMESTAMP '{NOW}' - INTERVAL 3000 DAY GROUP BY 1, 2""",
)
def catalog_direct_lineage(t):
    return tidy(K.direct_lineage(catalog_edges(t), "d7", "both", now(), days=3000))


@query(
    "catalog_live_edges",
    f"WITH {LIVE_SQL} SELECT source_id, target_id, {stamp_sql('ts')} AS ts FROM live",
)
def catalog_live_edges(t):
    return tidy(K.live_edges(catalog_edges(t), now(), 60))


@query(
    "catalog_statistics",
    f"""WITH {DATASETS_SQL}, {VERSIONS_SQL}, {EDGES_SQL}, live AS (SELECT source_id, target_id FROM edges WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1, 2),
    u AS (SELECT target_id AS dataset_id, count(*) AS n FROM live GROUP BY 1), d AS (SELECT source_id AS dataset_id, count(*) AS n FROM live GROUP BY 1),
    v AS (SELECT dataset_id, count(*) AS n FROM versions GROUP BY 1), vl AS (SELECT dataset_id, version FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, version DESC) AS r FROM versions) WHERE r = 1)
    SELECT dataset_id, row_count, coalesce(u.n, 0) AS upstream_datasets, coalesce(d.n, 0) AS downstream_datasets, coalesce(v.n, 0) AS total_versions, vl.version AS latest_version
    FROM datasets LEFT JOIN u USING (dataset_id) LEFT JOIN d USING (dataset_id) LEFT JOIN v USING (dataset_id) LEFT JOIN vl USING (dataset_id)""",
)
def catalog_statistics(t):
    out = K.statistics(datasets(t), catalog_edges(t), versions(t), now())
    return out.select("dataset_id", "row_count", "upstream_datasets", "downstream_datasets", "total_versions", "latest_version")


@query("catalog_export_import", f"WITH {DATASETS_SQL} SELECT dataset_id, owner, row_count, tag1 || ',' || tag2 AS tags FROM datasets")
def catalog_export_import(t):
    path = scratch(t.spark)
    K.export_tables({"datasets": datasets(t), "versions": versions(t)}, path)
    back = K.import_tables(t.spark, path, {"datasets": "dataset_id string, owner string, row_count bigint, tags array<string>"})
    return back["datasets"].withColumn("tags", F.concat_ws(",", "tags"))


PURGE_SQL = f"{DATASETS_SQL}, {EDGES_SQL}, gone AS (SELECT dataset_id FROM datasets WHERE updated_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)"


@query(
    "catalog_purge_datasets",
    f"WITH {PURGE_SQL} SELECT dataset_id FROM datasets WHERE dataset_id NOT IN (SELECT dataset_id FROM gone)",
)
def catalog_purge_datasets(t):
    return K.purge(datasets(t), versions(t), catalog_edges(t), now())[0].select("dataset_id")


@query(
    "catalog_purge_edges",
    f"WITH {PURGE_SQL} SELECT source_id, target_id, {stamp_sql('ts')} AS ts FROM edges WHERE source_id NOT IN (SELECT dataset_id FROM gone) AND target_id NOT IN (SELECT dataset_id FROM gone)",
)
def catalog_purge_edges(t):
    return tidy(K.purge(datasets(t), versions(t), catalog_edges(t), now())[2])


# ---- lineage graph: region → nation → customer / supplier, customer → orders ----

GRAPH_SQL = """edges AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t, 'feeds' AS edge_type FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'feeds' FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'feeds' FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'flows_to' FROM orders),
  nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS k FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders)"""


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def graph_edges(t):
    def edge(df, a, b, kind):
        return df.select(a.alias(G.S), b.alias(G.T), F.lit(kind).alias("edge_type"))

    return (
        edge(t.nation, _id("r", "n_regionkey"), _id("n", "n_nationkey"), "feeds")
        .unionByName(edge(t.customer, _id("n", "c_nationkey"), _id("c", "c_custkey"), "feeds"))
        .unionByName(edge(t.supplier, _id("n", "s_nationkey"), _id("s", "s_suppkey"), "feeds"))
        .unionByName(edge(t.orders, _id("c", "o_custkey"), _id("o", "o_orderkey"), "flows_to"))
    )


def graph_nodes(t):
    parts = [
        df.select(_id(p, c).alias("node_id"), F.lit(kind).alias("node_type"))
        for df, p, c, kind in (
            (t.region, "r", "r_regionkey", "region"), (t.nation, "n", "n_nationkey", "nation"), (t.customer, "c", "c_custkey", "customer"),
            (t.supplier, "s", "s_suppkey", "supplier"), (t.orders, "o", "o_orderkey", "order"),
        )
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "lineage_edges_accepted",
    f"WITH {GRAPH_SQL} SELECT s AS source_node_id, t AS target_node_id FROM edges WHERE t IN (SELECT id FROM nodes WHERE k <> 'supplier') AND s IN (SELECT id FROM nodes)",
)
def lineage_edges_accepted(t):
    known = graph_nodes(t).filter("node_type <> 'supplier'")
    return G.add_edges(known, graph_edges(t))[0].select(G.S, G.T)


@query(
    "lineage_edges_refused",
    "SELECT 'n' || s_nationkey AS source_node_id, 's' || s_suppkey AS target_node_id FROM supplier",
)
def lineage_edges_refused(t):
    known = graph_nodes(t).filter("node_type <> 'supplier'")
    return G.add_edges(known, graph_edges(t))[1].select(G.S, G.T)


TRACK_SQL = """e AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'flow' WHEN 'O' THEN 'validation' ELSE 'aggregation' END AS kind, o_orderpriority AS sub,
  'c' || o_custkey AS a, 'c' || (o_custkey + 1) AS b, 'o' || o_orderkey AS target FROM orders),
  m AS (SELECT *, CASE kind WHEN 'flow' THEN 'transformation_' WHEN 'validation' THEN 'validation_' ELSE 'aggregation_' END || id AS mid FROM e)"""


def tracked(t):
    s = F.col("o_orderstatus")
    kind = F.when(s == "F", "flow").when(s == "O", "validation").otherwise("aggregation")
    first, second = _id("c", "o_custkey"), F.concat(F.lit("c"), (F.col("o_custkey") + 1).cast("string"))
    events = t.orders.select(
        F.col("o_orderkey").alias("event_id"), kind.alias("kind"), F.col("o_orderpriority").alias("subtype"),
        F.when(kind == "aggregation", F.array(first, second)).otherwise(F.array(first)).alias("source_ids"),
        _id("o", "o_orderkey").alias("target_id"), F.col("o_orderdate").alias("ts"),
    )
    return G.track(events)


@query(
    "lineage_track_nodes",
    f"""WITH {TRACK_SQL} SELECT mid AS node_id, CASE kind WHEN 'flow' THEN 'transformation' ELSE kind END AS node_type,
    CASE kind WHEN 'flow' THEN sub || '_transformation' WHEN 'validation' THEN 'data_validation' ELSE sub || '_aggregation' END AS name FROM m""",
)
def lineage_track_nodes(t):
    return tracked(t)[0].select("node_id", "node_type", "name")


@query(
    "lineage_track_edges",
    f"""WITH {TRACK_SQL} SELECT a AS source_node_id, mid AS target_node_id, CASE kind WHEN 'flow' THEN 'flows_to' WHEN 'validation' THEN 'validates' ELSE 'aggregates' END AS edge_type FROM m
    UNION ALL SELECT b, mid, 'aggregates' FROM m WHERE kind = 'aggregation' UNION ALL SELECT mid, target, 'flows_to' FROM m WHERE kind <> 'validation'""",
)
def lineage_track_edges(t):
    return tracked(t)[1].select(G.S, G.T, "edge_type")


@query("lineage_downstream", f"WITH {GRAPH_SQL} SELECT DISTINCT t AS node_id FROM edges WHERE s = 'n3'")
def lineage_downstream(t):
    return G.neighbours(graph_edges(t), "n3", "downstream")


@query("lineage_upstream", f"WITH {GRAPH_SQL} SELECT DISTINCT s AS node_id FROM edges WHERE t = 'o7'")
def lineage_upstream(t):
    return G.neighbours(graph_edges(t), "o7", "upstream")


@query(
    "lineage_reach_all_regions",
    f"""WITH RECURSIVE {GRAPH_SQL}, walk AS (SELECT id AS start_id, id AS node_id, 0 AS depth FROM nodes WHERE k = 'region'
      UNION ALL SELECT start_id, t, depth + 1 FROM walk JOIN edges ON s = node_id WHERE depth < 3)
    SELECT start_id, node_id, min(depth)::BIGINT AS depth FROM walk WHERE depth > 0 GROUP BY 1, 2""",
)
def lineage_reach_all_regions(t):
    return tidy(G.reach(graph_edges(t), graph_nodes(t).filter("node_type = 'region'"), 3))


@query(
    "lineage_of_node",
    f"""WITH RECURSIVE {GRAPH_SQL}, d AS (SELECT 'c5' AS n, 0 AS depth UNION ALL SELECT t, depth + 1 FROM d JOIN edges ON s = n WHERE depth < 3),
    u AS (SELECT 'c5' AS n, 0 AS depth UNION ALL SELECT s, depth + 1 FROM u JOIN edges ON t = n WHERE depth < 3)
    SELECT DISTINCT 'downstream' AS relation, n AS item FROM d WHERE depth > 0 UNION ALL SELECT DISTINCT 'upstream', n FROM u WHERE depth > 0
    UNION ALL SELECT 'artifact', 'a' || o_orderkey FROM orders WHERE o_custkey = 5""",
)
def lineage_of_node(t):
    artifacts = t.orders.select(_id("a", "o_orderkey").alias("artifact_id"), _id("c", "o_custkey").alias("source_node_id"))
    return G.node_lineage(graph_edges(t), artifacts, "c5")


@query(
    "lineage_shortest_path",
    """SELECT 0::BIGINT AS step, 'r' || n_regionkey AS node_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 7
    UNION ALL SELECT 1, 'n' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 7
    UNION ALL SELECT 2, 'c' || o_custkey FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 3, 'o7'""",
)
def lineage_shortest_path(t):
    edges = graph_edges(t)
    owner = G.reach(edges, t.orders.filter("o_orderkey = 7").select(F.lit("o7").alias("node_id")), 3, "upstream")
    region = owner.filter("depth = 3").head()["node_id"]
    return tidy(G.shortest_path(edges, region, "o7"))


@query(
    "lineage_statistics",
    f"""WITH {GRAPH_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), m AS (SELECT count(*)::DOUBLE AS m FROM edges)
    SELECT 'total_nodes' AS name, NULL AS item, n AS value FROM n UNION ALL SELECT 'total_edges', NULL, m FROM m
    UNION ALL SELECT 'graph_density', NULL, round(m / (n * (n - 1)), 9) FROM n, m UNION ALL SELECT 'is_dag', NULL, 1.0 UNION ALL SELECT 'connected_components', NULL, n FROM n
    UNION ALL SELECT 'node_type', k, count(*)::DOUBLE FROM nodes GROUP BY 2 UNION ALL SELECT 'edge_type', edge_type, count(*)::DOUBLE FROM edges GROUP BY 2""",
)
def lineage_statistics(t):
    return tidy(G.statistics(graph_nodes(t), graph_edges(t)), 9)


CYCLIC_SQL = """edges AS (SELECT DISTINCT 'u' || user_id AS s, 'u' || (floor(value)::BIGINT % 200) AS t FROM events),
  nodes AS (SELECT s AS id FROM edges UNION SELECT t FROM edges)"""


def cyclic_edges(t):
    return t.events.select(
        _id("u", "user_id").alias(G.S), F.concat(F.lit("u"), (F.floor("value").cast("bigint") % 200).cast("string")).alias(G.T)
    ).distinct()


@query(
    "lineage_strong_components",
    f"""WITH RECURSIVE {CYCLIC_SQL}, reach AS (SELECT s AS a, t AS b FROM edges UNION SELECT a, t FROM reach JOIN edges ON s = b),
    mates AS (SELECT x.a AS id, min(x.b) AS mate, count(*) AS n FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)
    SELECT id AS node_id, coalesce(least(mate, id), id) AS component FROM nodes LEFT JOIN mates USING (id)""",
)
def lineage_strong_components(t):
    edges = cyclic_edges(t)
    nodes = edges.select(F.col(G.S).alias("node_id")).union(edges.select(G.T)).distinct()
    comps = G.strong_components(edges, nodes)
    named = comps.groupBy("component").agg(F.min("node_id").alias("smallest"))
    return comps.join(named, "component").select("node_id", F.col("smallest").alias("component"))


PURGE_GRAPH = f"""nodes AS (SELECT 'n' || o_orderkey AS id, o_orderdate AS updated_at FROM orders), edges AS (SELECT 'n' || o_orderkey AS s, 'n' || (o_custkey) AS t, o_orderdate AS created_at FROM orders),
  gone AS (SELECT id FROM nodes WHERE updated_at < TIMESTAMP '{NOW}' - INTERVAL 900 DAY)"""


def purged_graph(t):
    nodes = t.orders.select(_id("n", "o_orderkey").alias("node_id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    edges = t.orders.select(
        _id("n", "o_orderkey").alias(G.S), _id("n", "o_custkey").alias(G.T), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    artifacts = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("artifact_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    return G.purge(nodes, edges, artifacts, now(), 900)


@query(
    "lineage_purge_edges",
    f"WITH {PURGE_GRAPH} SELECT s AS source_node_id, t AS target_node_id FROM edges WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 900 DAY AND s NOT IN (SELECT id FROM gone) AND t NOT IN (SELECT id FROM gone)",
)
def lineage_purge_edges(t):
    return purged_graph(t)[1].select(G.S, G.T)


@query(
    "lineage_purge_counts",
    f"""WITH {PURGE_GRAPH} SELECT 'nodes' AS kind, count(*) AS n FROM nodes WHERE updated_at >= TIMESTAMP '{NOW}' - INTERVAL 900 DAY
    UNION ALL SELECT 'artifacts', count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '{NOW}' - INTERVAL 900 DAY""",
)
def lineage_purge_counts(t):
    nodes, _, artifacts = purged_graph(t)
    count = F.count(F.lit(1)).alias("n")
    return nodes.agg(count).select(F.lit("nodes").alias("kind"), "n").unionByName(
        artifacts.agg(count).select(F.lit("artifacts").alias("kind"), "n"))


@query("lineage_export", f"WITH {GRAPH_SQL} SELECT s AS source_node_id, t AS target_node_id, edge_type FROM edges")
def lineage_export(t):
    path = scratch(t.spark)
    G.export_json(graph_nodes(t), graph_edges(t), None, path)
    return t.spark.read.schema(f"{G.S} string, {G.T} string, edge_type string").json(f"{path}/edges")


# ---- retention: order priority stands for the source ----

POLICIES = [
    {"policy_id": "p1", "source_id": "1-URGENT", "hot_days": 100, "warm_days": 800, "cold_days": 2000},
    {"policy_id": "p2", "source_id": "2-HIGH", "hot_days": 10, "warm_days": 365, "cold_days": 1000, "archival_enabled": False},
    {"policy_id": "p3", "source_id": "5-LOW", "cleanup_enabled": False},
    {"policy_id": "p4", "source_id": "no such source"},
]
POLICY_SQL = """policies(policy_id, source_id, hot, warm, cold, archival, cleanup) AS (VALUES ('p1', '1-URGENT', 100, 800, 2000, true, true), ('p2', '2-HIGH', 10, 365, 1000, false, true),
  ('p3', '5-LOW', 7, 30, 365, true, false), ('p4', 'no such source', 7, 30, 365, true, true)),
  r AS (SELECT o_orderkey, o_orderpriority AS source_id, o_orderdate AS ts FROM orders)"""
RET_NOW = "2001-01-01"


def records(t):
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("source_id"), F.col("o_orderdate").alias("ts"))


def ret_now():
    return F.lit(RET_NOW).cast("timestamp")


@query(
    "retention_to_archive",
    f"WITH {POLICY_SQL} SELECT o_orderkey, archival AS archival_enabled FROM r JOIN policies USING (source_id) WHERE ts < TIMESTAMP '{RET_NOW}' - to_days(hot)",
)
def retention_to_archive(t):
    return T.split_hot(records(t), POLICIES, ret_now())[0].select("o_orderkey", "archival_enabled")


@query(
    "retention_stays_hot",
    f"WITH {POLICY_SQL} SELECT o_orderkey FROM r LEFT JOIN policies USING (source_id) WHERE hot IS NULL OR ts >= TIMESTAMP '{RET_NOW}' - to_days(hot)",
)
def retention_stays_hot(t):
    return T.split_hot(records(t), POLICIES, ret_now())[1].select("o_orderkey")


@query(
    "retention_cold_layout",
    f"""WITH {POLICY_SQL} SELECT source_id, 2001 AS year, 1 AS month, count(*) AS n FROM r JOIN policies USING (source_id) WHERE archival AND ts < TIMESTAMP '{RET_NOW}' - to_days(hot) GROUP BY 1""",
)
def retention_cold_layout(t):
    old = T.split_hot(records(t), POLICIES, ret_now())[0].filter("archival_enabled").drop("archival_enabled")
    path = scratch(t.spark)
    T.write_cold(old, path, ret_now())
    back = t.spark.read.schema("o_orderkey bigint, ts string, source_id string, year int, month int").json(path)
    return tidy(back.groupBy("source_id", "year", "month").agg(F.count(F.lit(1)).alias("n")))


@query(
    "retention_expired",
    f"""WITH {POLICY_SQL} SELECT 'warm' AS tier, o_orderkey FROM r JOIN policies USING (source_id) WHERE cleanup AND ts < TIMESTAMP '{RET_NOW}' - to_days(warm)
    UNION ALL SELECT 'cold', o_orderkey FROM r JOIN policies USING (source_id) WHERE cleanup AND ts < TIMESTAMP '{RET_NOW}' - to_days(cold)""",
)
def retention_expired(t):
    parts = [T.expired(records(t), POLICIES, ret_now(), k).select(F.lit(k).alias("tier"), "o_orderkey") for k in ("warm", "cold")]
    return parts[0].unionByName(parts[1])


AGE_SQL = f"""ages AS (SELECT policy_id, count(*) AS queue_size, count(*) FILTER (a <= hot) AS hot, count(*) FILTER (a > hot AND a <= warm) AS warm, count(*) FILTER (a > hot AND a > warm) AS cold
  FROM (SELECT *, floor(epoch(TIMESTAMP '{RET_NOW}' - ts) / 86400) AS a FROM r JOIN policies USING (source_id)) GROUP BY 1)"""


@query("retention_age_distribution", f"WITH {POLICY_SQL}, {AGE_SQL} SELECT * FROM ages")
def retention_age_distribution(t):
    return T.age_distribution(records(t), POLICIES, ret_now())


@query(
    "retention_report",
    f"""WITH {POLICY_SQL}, {AGE_SQL} SELECT p.policy_id, p.source_id, p.hot::BIGINT AS hot_days, p.warm::BIGINT AS warm_days, p.cold::BIGINT AS cold_days, archival AS archival_enabled, cleanup AS cleanup_enabled,
    coalesce(queue_size, 0) AS queue_size, coalesce(a.hot, 0) AS hot, coalesce(a.warm, 0) AS warm, coalesce(a.cold, 0) AS cold FROM policies p LEFT JOIN ages a USING (policy_id)""",
)
def retention_report(t):
    return tidy(T.report(records(t), POLICIES, ret_now()))


@query(
    "retention_purge_kept",
    f"SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{RET_NOW}' - INTERVAL 365 DAY",
)
def retention_purge_kept(t):
    return T.purge_older(records(t), "ts", RET_NOW, 365)[0].select("o_orderkey")


@query(
    "retention_purge_count",
    f"SELECT count(*) AS deleted_count FROM orders WHERE o_orderdate < TIMESTAMP '{RET_NOW}' - INTERVAL 365 DAY",
)
def retention_purge_count(t):
    return T.purge_older(records(t), "ts", RET_NOW, 365)[1]


@query(
    "retention_purge_stored",
    f"SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE o_orderdate >= TIMESTAMP '{RET_NOW}' - INTERVAL 365 DAY",
)
def retention_purge_stored(t):
    """Purge of a stored table in place: only partitions with expired rows are rewritten."""
    path = scratch(t.spark)
    rows = records(t).withColumn("year", F.year(F.col("ts").cast("timestamp")))
    rows.hint("rebalance", F.col("year")).write.partitionBy("year").parquet(path)
    T.purge_partitions(t.spark, path, "ts", RET_NOW, 365, ["year"])
    return tidy(t.spark.read.parquet(path).select("o_orderkey", "year"))


TEXT_KEY = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '007' WHEN 2 THEN '7' ELSE 'a/b=' || o_orderpriority END"


@query(
    "retention_purge_text_keys",
    f"SELECT o_orderkey, {TEXT_KEY} AS part FROM orders WHERE o_orderdate >= TIMESTAMP '{RET_NOW}' - INTERVAL 365 DAY",
)
def retention_purge_text_keys(t):
    """Purge of a table whose partition values are null, texts that look like numbers, and texts that folders escape."""
    path = scratch(t.spark)
    rows = records(t).withColumn("part", F.expr(TEXT_KEY.replace("o_orderpriority", "source_id")))
    rows.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(path)
    T.purge_partitions(t.spark, path, "ts", RET_NOW, 365, ["part"])
    return tidy(S.read_text_keys(t.spark, path, ["part"]).select("o_orderkey", "part"))


@query("storage_retrieve_text_key", "SELECT event_id, value FROM events WHERE event_id % 3 = 1")
def storage_retrieve_text_key(t):
    """Retrieval by a key that looks like a number."""
    path = scratch(t.spark)
    rows = t.events.withColumn("code", F.expr("CASE event_id % 3 WHEN 0 THEN '7' WHEN 1 THEN '007' ELSE NULL END"))
    S.store(rows, path, "metrics", "hot", "ts", {"type": "field", "field": "code"})
    return S.retrieve(t.spark, path, "hot", "metrics", "ts", key="007").select("event_id", "value")


# ---- archive: a move at two times, then a purge by policy ----

FIRST_MOVE = "1996-01-01"
MOVED_SQL = f"""{POLICY_SQL}, m AS (SELECT o_orderkey, source_id, ts < TIMESTAMP '{RET_NOW}' - to_days(hot) AS moved, ts < TIMESTAMP '{FIRST_MOVE}' - to_days(hot) AS early, archival, cleanup, warm, cold
  FROM r LEFT JOIN policies USING (source_id))"""


def archived(t, *times):
    """Orders as a hot table by source and year, moved by policy at each of the times."""
    base = scratch(t.spark)
    rows = records(t).withColumn("year", F.year(F.col("ts").cast("timestamp")))
    rows.hint("rebalance", F.col("source_id")).write.partitionBy("source_id", "year").parquet(f"{base}/hot")
    for now in times:
        A.archive(t.spark, base, POLICIES, F.lit(now).cast("timestamp"), ["source_id", "year"])
    return base


def tiers(t, base):
    """What each tier holds, with the rows as they are stored there."""
    parts = [A.read_tier(t.spark, base, k, ["source_id", "year"]).select(F.lit(k).alias("tier"), "o_orderkey", "source_id", stamp("ts").alias("ts")) for k in ("hot", "warm", "cold")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "retention_archive_move",
    f"""WITH {MOVED_SQL}, k AS (SELECT 'hot' AS tier, o_orderkey FROM m WHERE NOT coalesce(moved, false) UNION ALL SELECT 'warm', o_orderkey FROM m WHERE moved
      UNION ALL SELECT 'cold', o_orderkey FROM m WHERE moved AND archival)
    SELECT tier, o_orderkey, source_id, {stamp_sql("ts")} AS ts FROM k JOIN r USING (o_orderkey)""",
)
def retention_archive_move(t):
    """All tiers after one move."""
    return tiers(t, archived(t, RET_NOW))


@query(
    "retention_purge_by_policy",
    f"""WITH {MOVED_SQL}, k AS (SELECT 'hot' AS tier, o_orderkey FROM m WHERE NOT coalesce(moved, false)
      UNION ALL SELECT 'warm', o_orderkey FROM m WHERE moved AND NOT (cleanup AND early AND TIMESTAMP '{FIRST_MOVE}' < TIMESTAMP '{RET_NOW}' - to_days(warm))
      UNION ALL SELECT 'cold', o_orderkey FROM m WHERE moved AND archival AND NOT (cleanup AND early AND TIMESTAMP '{FIRST_MOVE}' < TIMESTAMP '{RET_NOW}' - to_days(cold)))
    SELECT tier, o_orderkey, source_id, {stamp_sql("ts")} AS ts FROM k JOIN r USING (o_orderkey)""",
)
def retention_purge_by_policy(t):
    """All tiers after two moves and a purge of warm and cold by policy."""
    base = archived(t, FIRST_MOVE, RET_NOW)
    for tier in ("warm", "cold"):
        A.purge_by_policy(t.spark, base, tier, POLICIES, ret_now())
    return tiers(t, base)
