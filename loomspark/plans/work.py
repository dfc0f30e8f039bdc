"""Queries of changes to the worklist. Events and orders stand for its logs and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import transitions
from loomspark.plans.catalogue import DAG_SQL
from loomspark.plans.knowledge import EDGES_SQL, edges
from loomspark.plans.registry import query
from loomspark.sources.tables import table


def enqueued(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 100).cast("string").alias("payload"), F.col("event_id").alias("cause"))
    there = requests.where(F.length("payload") == 1).select(transitions.task_key(F.col("kind"), F.col("payload")).alias("task_key")).distinct()
    return transitions.enqueue(there, requests)


@query("SELECT DISTINCT sha256(event_type || '|' || (user_id % 100)) AS task_key, event_type AS kind, CAST(user_id % 100 AS VARCHAR) AS payload FROM events WHERE user_id % 100 >= 10")
def enqueue_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enqueued(spark, sf_dir)[0]


@query("SELECT DISTINCT sha256(event_type || '|' || (user_id % 100)) AS task_key, event_id AS cause FROM events")
def enqueue_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enqueued(spark, sf_dir)[1]


@query("""
WITH e AS (
  SELECT user_id AS task, event_id AS seq, ['claim','claim','renew','finish','block','await','retry'][event_id % 7 + 1] AS kind, event_id % 2 AS token, event_id // 2000 AS epoch FROM events
), h AS (
  SELECT *, last_value(CASE WHEN kind = 'claim' THEN seq END IGNORE NULLS) OVER (PARTITION BY task ORDER BY seq ROWS UNBOUNDED PRECEDING) AS claim FROM e
), v AS (
  SELECT h.*, h.kind = 'claim' OR coalesce(c.token = h.token AND c.epoch = h.epoch, false) AS valid FROM h LEFT JOIN e c ON c.seq = h.claim
)
SELECT task, coalesce(CASE arg_max(kind, seq) FILTER (valid) WHEN 'claim' THEN 'leased' WHEN 'renew' THEN 'leased' WHEN 'finish' THEN 'done' WHEN 'block' THEN 'blocked' WHEN 'await' THEN 'awaiting_model' WHEN 'retry' THEN 'retry' END, 'pending') AS state
FROM v GROUP BY task
""")
def fenced_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("claim", "claim", "renew", "finish", "block", "await", "retry")])
    key = F.col("event_id")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), key.alias("seq"), F.get(kinds, (key % 7).cast("int")).alias("kind"), (key % 2).alias("token"), F.floor(key / 2000).alias("epoch"))
    return transitions.states(log)


@query(f"""
WITH {DAG_SQL.strip()}, {EDGES_SQL}, hit AS (SELECT p_partkey AS node FROM part WHERE p_size = 17),
touched AS (SELECT edge_id, src AS node, src, dst FROM edges WHERE src IN (SELECT node FROM hit) UNION SELECT edge_id, dst, src, dst FROM edges WHERE dst IN (SELECT node FROM hit)),
other AS (SELECT DISTINCT node, CASE WHEN src = node THEN dst ELSE src END AS other FROM touched WHERE src <> dst),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS k FROM other)
SELECT DISTINCT 'node_revalidate' AS kind, CAST(src AS VARCHAR) AS ref, dst AS cause FROM edges WHERE dst IN (SELECT node FROM hit)
UNION SELECT 'edge_revalidate', CAST(edge_id AS VARCHAR), node FROM touched
UNION SELECT 'support_refresh', CAST(src * 1000 + dst AS VARCHAR), node FROM touched WHERE src % 3 = 0
UNION SELECT 'discovery', least(node, other) || '-' || greatest(node, other), node FROM ranked WHERE k <= 3
""")
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are told apart by both ends, in 32 bits each: edge_id alone isn't unique from 599998 nodes on. It is what is returned."""
    found = edges(spark, sf_dir).withColumn("edge_id", F.shiftleft("src", 32).bitwiseOR(F.col("dst")))
    hit = table(spark, sf_dir, "part").where("p_size = 17").select(F.col("p_partkey").alias("node"))
    made = transitions.expanded(hit, found, found.where("src % 3 = 0").select("edge_id", (F.col("src") * 1000 + F.col("dst")).alias("record")), 3)
    edge = F.expr("try_cast(ref AS BIGINT)")
    named = (F.shiftright(edge, 32) * 100000 + edge.bitwiseAND(F.lit((1 << 32) - 1))).cast("string")
    return made.withColumn("ref", F.when(F.col("kind") == "edge_revalidate", named).otherwise(F.col("ref")))


@query("""
WITH t AS (SELECT o_orderkey AS task, o_custkey AS run, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' ELSE 'done' END AS state, o_orderpriority LIKE '1%' AS late FROM orders)
SELECT task, run, state, late FROM t WHERE state <> 'done' AND (NOT late OR run NOT IN (SELECT run FROM t WHERE state <> 'done' AND NOT late))
""")
def stage_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("run"), F.when(F.col("o_orderkey") % 4 == 0, "pending").otherwise("done").alias("state"), F.col("o_orderpriority").like("1%").alias("late"))
    return transitions.past_barrier(tasks, F.col("late"))


@query("""
SELECT c_custkey AS task FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)
""")
def released_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("task"))
    orders = table(spark, sf_dir, "orders")
    needs = orders.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("node"))
    return transitions.released(blocked, needs, orders.select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 20 != 0).alias("is_current")))


@query("""
WITH last AS (SELECT user_id, max(event_id) FILTER (event_id % 4 = 2) AS ok FROM events GROUP BY user_id),
n AS (SELECT l.user_id, count(*) FILTER (event_id % 4 = 1 AND (ok IS NULL OR event_id > ok)) AS streak FROM last l JOIN events e ON e.user_id = l.user_id GROUP BY l.user_id)
SELECT user_id, streak, CASE WHEN streak >= 3 THEN 'blocked' WHEN streak > 0 THEN 'retry' ELSE 'ready' END AS state FROM n
""")
def transport_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.transport_retries(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_id") % 4 == 1, F.col("event_id") % 4 == 2)


@query("""
SELECT l_suppkey AS source, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN l_orderkey END) AS pages, count(*) FILTER (o_orderstatus <> 'O') AS history
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size = 17 GROUP BY l_suppkey
""")
def refresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("source"))
    hit = table(spark, sf_dir, "part").where("p_size = 17").select(F.col("p_partkey").alias("node"))
    return transitions.refresh_targets(hit, links, table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("page")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def commit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.commit_numbers(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
