"""Queries of the read path over nodes, edges and derivations. Parts stand for nodes, their halves and thirds for premises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import graph, knowledge
from loomspark.plans.catalogue import CLOSURE_SQL, DAG_SQL, dag
from loomspark.plans.registry import query
from loomspark.sources.tables import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "proposition").otherwise("concept")
    return part.select(F.col("p_partkey").alias("node"), kind.alias("kind"), (F.col("p_partkey") * 10 + F.col("p_size") % 3).alias("current_revision"), (F.col("p_size") != 7).alias("usable"), "p_size", "p_name")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dag(spark, sf_dir).withColumn("edge_id", F.col("src") * 100000 + F.col("dst"))
    predicate = F.when((F.col("src") + F.col("dst")) % 3 == 0, "supports").when((F.col("src") + F.col("dst")) % 3 == 1, "qualifies").otherwise("contradicts")
    return found.withColumn("predicate", predicate)


EDGES_SQL = "edges AS (SELECT src * 100000 + dst AS edge_id, CASE (src + dst) % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'qualifies' ELSE 'contradicts' END AS predicate, src, dst FROM dag)"


@query("""
SELECT p_partkey AS node, CASE WHEN p_size % 4 = 0 THEN 'proposition' ELSE 'concept' END AS kind, p_partkey * 10 + p_size % 3 AS revision, p_name || ' v' || (p_size % 3) AS statement,
       coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey) FILTER (l_suppkey IS NOT NULL)), ','), '') AS data_ids
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linenumber % 3 = p_size % 3 GROUP BY p_partkey, p_size, p_name
""")
def current_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir)
    revisions = found.select(F.col("node"), F.col("p_name"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    revisions = revisions.select((F.col("node") * 10 + F.col("k")).alias("revision"), F.concat_ws(" v", "p_name", F.col("k").cast("string")).alias("statement"))
    groundings = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 10 + F.col("l_linenumber") % 3).alias("revision"), F.col("l_suppkey").alias("data_id"))
    return knowledge.current_nodes(found, revisions, groundings).withColumn("data_ids", F.array_join(F.col("data_ids").cast("array<string>"), ","))


@query(f"WITH {DAG_SQL.strip()}, {EDGES_SQL} SELECT edge_id, predicate, edge_id * 2 + src % 2 AS revision, src, dst FROM edges")
def current_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision is named by its edge's ends and its number: edge_id alone isn't unique from 599998 nodes on."""
    found = edges(spark, sf_dir)
    name = lambda k: F.struct("src", "dst", k.cast("long").alias("k"))
    revisions = found.select("src", "dst", F.explode(F.array(name(F.lit(0)), name(F.lit(1)))).alias("revision"))
    current = knowledge.current_edges(found.select("edge_id", "predicate", name(F.col("src") % 2).alias("current_revision")), revisions)
    return current.withColumn("revision", F.col("edge_id") * 2 + F.col("revision.k"))


@query("""
SELECT p_partkey AS node, coalesce(max(o_orderkey), p_partkey * 10) AS record, max(o_orderkey) IS NOT NULL AS from_event
FROM part LEFT JOIN orders ON o_custkey = p_partkey GROUP BY p_partkey
""")
def support_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = nodes(spark, sf_dir).select("node", (F.col("node") * 10).alias("record"))
    supports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("event_order"), F.col("o_orderkey").alias("record"))
    return knowledge.support_records(origins, supports)


def consumed(found: DataFrame) -> DataFrame:
    changed = (F.col("src") % 11 == 0) & (F.col("dst") % 7 == 0)
    return found.select("src", "dst", (F.col("dst") * 10 + F.when(changed, 1).otherwise(0)).alias("consumed"), (F.col("dst") * 10).alias("record"))


CURRENT_SQL = """, bad AS (
  SELECT p_partkey AS node FROM part WHERE p_size = 7
), changed AS (
  SELECT DISTINCT src AS node FROM dag WHERE src % 11 = 0 AND dst % 7 = 0
), hit AS (
  SELECT node FROM changed UNION SELECT src FROM closure WHERE dst IN (SELECT node FROM bad UNION SELECT node FROM changed)
)"""


@query(CLOSURE_SQL + CURRENT_SQL + "SELECT p_partkey AS node, p_partkey NOT IN (SELECT node FROM hit) AS is_current FROM part")
def premise_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.premise_currency(nodes(spark, sf_dir), consumed(dag(spark, sf_dir)))


#: The premises with edges back from some, which makes cycles.
CYCLIC_SQL = CLOSURE_SQL.replace("), closure", "), loops AS (SELECT src, dst FROM dag UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey % 97 = 0), closure").replace("SELECT src, dst FROM dag UNION SELECT c.src, d.dst FROM closure c JOIN dag d", "SELECT src, dst FROM loops UNION SELECT c.src, d.dst FROM closure c JOIN loops d")


@query(CYCLIC_SQL + CURRENT_SQL + """, on_cycle AS (SELECT src AS node FROM closure WHERE src = dst), round AS (
  SELECT node FROM on_cycle UNION SELECT src FROM closure WHERE dst IN (SELECT node FROM on_cycle)
)
SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT node FROM round) THEN 'cycle' WHEN p_partkey IN (SELECT node FROM hit) THEN 'stale' ELSE 'active' END AS route FROM part
""")
def active_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "part").where("p_partkey % 97 = 0").select(F.floor(F.col("p_partkey") / 2).alias("src"), F.col("p_partkey").alias("dst"))
    same = consumed(dag(spark, sf_dir)).unionByName(back.select("src", "dst", (F.col("dst") * 10).alias("consumed"), (F.col("dst") * 10).alias("record")))
    return knowledge.routes(nodes(spark, sf_dir), same)


@query(CLOSURE_SQL + """, own AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS data_id FROM lineitem WHERE l_orderkey % 50 = 0
), every AS (SELECT node, data_id FROM own UNION SELECT src, data_id FROM closure JOIN own ON dst = node)
SELECT p_partkey AS node,
  CASE WHEN d.n IS NOT NULL AND p.n IS NOT NULL THEN 'both' WHEN d.n IS NOT NULL THEN 'grounded' WHEN p.n IS NOT NULL THEN 'derived' ELSE 'none' END AS origin,
  CAST(length(bin(p_partkey)) - 1 AS BIGINT) AS depth, coalesce(p.n, 0) AS premises, coalesce(d.n, 0) AS direct_data, coalesce(a.n, 0) AS all_data
FROM part LEFT JOIN (SELECT node, count(*) AS n FROM own GROUP BY node) d ON d.node = p_partkey
LEFT JOIN (SELECT node, count(*) AS n FROM every GROUP BY node) a ON a.node = p_partkey
LEFT JOIN (SELECT src, count(*) AS n FROM dag GROUP BY src) p ON p.src = p_partkey
""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 0").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("data_id"))
    return knowledge.provenance(nodes(spark, sf_dir), dag(spark, sf_dir), own)


@query("""
WITH x AS (
  SELECT o_orderkey, o_orderkey % 19 = 0 AS gone, o_orderkey % 13 = 0 AND o_orderstatus <> 'X' AS s, o_orderkey % 17 = 0 AND o_orderkey % 23 <> 0 AS t0, o_orderkey % 23 = 0 AND o_orderkey % 17 <> 0 AS t1 FROM orders
)
SELECT o_orderkey, NOT (gone OR s OR t0 OR t1) AS is_current,
  array_to_string(list_filter([CASE WHEN gone OR s THEN 'status' END, CASE WHEN gone OR t0 OR t1 THEN 'customer' END], lambda y: y IS NOT NULL), ',') AS differs FROM x
""")
def effective_input_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    bound = orders.select(key, F.col("o_orderstatus").alias("status"), F.when(key % 23 != 0, F.col("o_custkey")).alias("customer"))
    now = orders.where(key % 19 != 0).select(key, F.when(key % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(key % 17 != 0, F.col("o_custkey")).alias("customer"))
    return knowledge.input_currency(bound, now, "o_orderkey", ["status", "customer"])


@query(f"""
WITH {DAG_SQL.strip()}, {EDGES_SQL}, kept AS (SELECT p_partkey AS node, CASE WHEN p_size % 4 = 0 THEN 'proposition' ELSE 'concept' END AS kind FROM part WHERE p_size % 2 = 0),
ok AS (SELECT * FROM edges WHERE (src + dst) % 5 <> 0), marks AS (SELECT src AS node FROM ok WHERE predicate = 'contradicts' UNION SELECT dst FROM ok WHERE predicate = 'contradicts'),
inside AS (SELECT * FROM ok WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))
SELECT node, kind, node IN (SELECT node FROM marks) AS contested, (SELECT count(*) FROM inside WHERE src = node) AS edges_out, (SELECT count(*) FROM inside WHERE dst = node) AS edges_in FROM kept
""")
def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(spark, sf_dir)
    status = F.when((F.col("src") + F.col("dst")) % 5 == 0, "pending").otherwise("applicable")
    return knowledge.graph_query(nodes(spark, sf_dir), found.select("edge_id", "src", "dst", status.alias("status")), found.select("edge_id", "predicate"), F.col("p_size") % 2 == 0)


@query("""
SELECT DISTINCT l_partkey AS edge_id, l_orderkey AS record, l_suppkey AS node FROM lineitem
JOIN (SELECT l_suppkey AS s, max(l_orderkey) AS last FROM lineitem GROUP BY l_suppkey) x ON s = l_suppkey AND last = l_orderkey
""")
def edge_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("edge_id"), F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("node")).distinct()
    return knowledge.edge_consumers(used, used.groupBy("node").agg(F.max("record").alias("record")))


@query(f"""
WITH {DAG_SQL.strip()}, {EDGES_SQL}, even AS (SELECT p_partkey AS node FROM part WHERE p_size % 2 = 0),
ok AS (SELECT edge_id FROM edges WHERE (src + dst) % 3 <> 0 AND src IN (SELECT node FROM even) AND dst IN (SELECT node FROM even)), asked AS (SELECT edge_id FROM edges WHERE src % 50 = 0)
SELECT edge_id, edge_id IN (SELECT edge_id FROM ok) AS available, edge_id IN (SELECT edge_id FROM asked) AS required FROM edges
WHERE edge_id IN (SELECT edge_id FROM ok) OR edge_id IN (SELECT edge_id FROM asked)
""")
def edges_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(spark, sf_dir)
    return knowledge.edges_among(found, nodes(spark, sf_dir).where("p_size % 2 = 0"), found.where("(src + dst) % 3 <> 0"), found.where("src % 50 = 0"))


@query(CLOSURE_SQL + """, chosen AS (SELECT p_partkey AS node FROM part WHERE p_size = 11)
SELECT node, true AS selected FROM chosen UNION ALL
SELECT DISTINCT dst, false FROM closure WHERE src IN (SELECT node FROM chosen) AND dst NOT IN (SELECT node FROM chosen)
""")
def context_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.with_premises(nodes(spark, sf_dir).where("p_size = 11"), dag(spark, sf_dir))


@query("""
SELECT l_orderkey AS item, l_partkey AS node, l_partkey * 10 + l_linenumber % 3 AS revision, l_linenumber % 3 = p_size % 3 AS is_current
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
""")
def related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "review_required").otherwise("linked")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("node"), (F.col("l_partkey") * 10 + F.col("l_linenumber") % 3).alias("revision"), state.alias("state"))
    items = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("item"))
    return knowledge.related_links(links, items, nodes(spark, sf_dir).select("node", F.col("current_revision").alias("revision")))


@query(f"""
WITH {DAG_SQL.strip()}, stored AS (
  SELECT src, dst FROM dag WHERE NOT (src % 31 = 0 AND dst = src // 2) UNION SELECT DISTINCT src, 1 FROM dag WHERE src % 41 = 0
), deepest AS (SELECT src, max(length(bin(dst))) AS d FROM stored GROUP BY src)
SELECT src AS record, 'premise_missing' AS fault FROM (SELECT * FROM dag EXCEPT SELECT * FROM stored) GROUP BY src
UNION ALL SELECT src, 'premise_added' FROM (SELECT * FROM stored EXCEPT SELECT * FROM dag) GROUP BY src
UNION ALL SELECT s.src, 'wrong_depth' FROM (SELECT DISTINCT src FROM dag) s LEFT JOIN deepest x ON x.src = s.src
  WHERE length(bin(s.src)) - 1 + CASE WHEN s.src % 37 = 0 THEN 1 ELSE 0 END <> coalesce(d, 0)
""")
def derivation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dag(spark, sf_dir)
    depth = lambda c: F.length(F.bin(c)) - 1
    declared = found.groupBy(F.col("src").alias("record")).agg(F.collect_set("dst").alias("premises")).withColumn("depth", (depth(F.col("record")) + F.when(F.col("record") % 37 == 0, 1).otherwise(0)).cast("long"))
    stored = found.where("not (src % 31 = 0 and dst = src div 2)").unionByName(found.where("src % 41 = 0").select("src", F.lit(1).cast("long").alias("dst")))
    return knowledge.derivation_faults(declared, stored.select(F.col("src").alias("record"), F.col("dst").alias("premise")), graph.depths(found))


@query(f"""
WITH {DAG_SQL.strip()}, {EDGES_SQL} SELECT edge_id, predicate FROM edges JOIN part ON p_partkey = dst WHERE predicate <> 'contradicts' AND p_size % 4 <> 0
""")
def endpoint_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.endpoint_faults(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("""
WITH v AS (
  SELECT lang, source, doc_id, row_number() OVER w + CASE WHEN doc_id % 53 = 0 THEN 1 ELSE 0 END AS version_number, CASE WHEN doc_id % 59 <> 0 THEN lag(doc_id) OVER w END AS parent
  FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)
), n AS (SELECT *, lag(doc_id) OVER w AS before, lag(version_number) OVER w AS prev FROM v WINDOW w AS (PARTITION BY lang, source ORDER BY version_number, doc_id))
SELECT lang, source, version_number FROM n WHERE parent IS DISTINCT FROM before OR version_number <> coalesce(prev, 0) + 1
""")
def chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents")
    number = (F.row_number().over(w) + F.when(F.col("doc_id") % 53 == 0, 1).otherwise(0)).cast("long")
    made = docs.select("lang", "source", F.col("doc_id").alias("version_id"), number.alias("version_number"), F.when(F.col("doc_id") % 59 != 0, F.lag("doc_id").over(w)).alias("parent"))
    return knowledge.chain_faults(made, ["lang", "source"])


@query("""
SELECT l_partkey AS revision, array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') AS versions, bool_or(n_regionkey = 1) AS on_head
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY l_partkey
""")
def version_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    supports = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("revision"), F.col("l_suppkey").alias("data_id"))
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("version_id"), F.col("s_suppkey").alias("data_id"))
    return knowledge.version_support(supports, members, table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("version_id")))


@query("""
SELECT s_nationkey AS series, s_suppkey AS data_id, s_suppkey AS version_id, s_suppkey = (SELECT max(x.s_suppkey) FROM supplier x WHERE x.s_nationkey = s.s_nationkey) AS is_head FROM supplier s WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)
""")
def frozen_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("series"), F.col("s_suppkey").alias("data_id"), F.col("s_suppkey").alias("version_id"))
    heads = members.groupBy("series").agg(F.max("version_id").alias("version_id")).select("version_id")
    return knowledge.frozen_versions(members, heads, table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("data_id")))


@query("""
SELECT sha256(CAST(l_partkey AS VARCHAR)) AS sha256, count(DISTINCT l_orderkey) AS packets, count(DISTINCT l_returnflag || l_linestatus) > 1 AS conflict FROM lineitem GROUP BY l_partkey
""")
def merged_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "lineitem").select(F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("sha256"), F.col("l_orderkey").alias("packet"), F.col("l_returnflag").alias("media_type"), F.col("l_linestatus").alias("byte_size"))
    return knowledge.merged_media(media)


@query("""
SELECT o_orderkey AS commit_id, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' ELSE 'older' END AS fault FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0
""")
def catalogue_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), (F.col("o_custkey") % 10).alias("version"))
    new = old.where("commit_id % 7 <> 0").withColumn("version", F.col("version") - F.when(F.col("commit_id") % 11 == 0, 1).otherwise(0))
    return knowledge.regressions(old, new)
