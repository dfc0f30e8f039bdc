"""The registered queries of the relational part and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import digests, figures, text
from loomspark.operators import graph, quotes, realms, relations, retrieval, review, segments, sets, spans, versions, worklist
from loomspark.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from loomspark.sources import store
from loomspark.sources.tables import table
from loomspark.streaming.latest import stream_latest

# -- derived inputs, the same on both sides

LINES_SQL = """
lines AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line,
         CAST(coalesce(list_sum(list_transform(parts[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS char_start
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, range(1, len(parts) + 1) r(i)
)"""
WINDOWS_SQL = """
win AS (
  SELECT doc_id, w AS window_no, w * 448 AS char_start, least(w * 448 + 512, length(text)) AS char_end, text
  FROM documents, range(0, greatest(1, CAST(ceil((length(text) - 512) / 448.0) AS BIGINT) + 1)) r(w)
  WHERE length(text) > 0
)"""
DAG_SQL = """
dag AS (
  SELECT DISTINCT src, dst FROM (
    SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part
  ) e WHERE dst > 0 AND src > 0
)"""
CLOSURE_SQL = f"""
WITH RECURSIVE {DAG_SQL.strip()}, closure(src, dst) AS (
  SELECT src, dst FROM dag UNION SELECT c.src, d.dst FROM closure c JOIN dag d ON c.dst = d.src
)"""


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    halves = part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    thirds = part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst"))
    return halves.union(thirds).where("dst > 0 and src > 0").distinct()


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language and source, as versions of a series, their size class standing for the content."""
    return table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.floor(F.col("n_chars") / 1000).alias("data_id"))


CHAIN_SQL = """
chain AS (
  SELECT *, row_number() OVER w AS version_number, lag(doc_id) OVER w AS parent, lead(doc_id) OVER w IS NULL AS is_head
  FROM (SELECT lang, source, doc_id, n_chars // 1000 AS data_id, lag(n_chars // 1000) OVER (PARTITION BY lang, source ORDER BY doc_id) AS prev FROM documents) x
  WHERE prev IS NULL OR prev <> data_id WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)
)"""


# -- citations, digests, text


@query("""
SELECT d.doc_id, b.item_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS char_start,
       CAST(strpos(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS char_end, sha256(b.text) AS quote_sha256
FROM documents d JOIN benchmark b ON strpos(d.text, b.text) > 0
WHERE strpos(substring(d.text, strpos(d.text, b.text) + 1), b.text) = 0
""")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.locate_once(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
SELECT doc_id, sha256(text) AS data_id, min(doc_id) OVER (PARTITION BY text) AS first_id,
       CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'published' ELSE 'duplicate' END AS state FROM documents
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.exact_dedup(table(spark, sf_dir, "documents"))


@query("""
SELECT doc_id, sha256('{"domain":"document","schema":1,"value":{"chars":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}}') AS content_fingerprint FROM documents
""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", digests.fingerprint("document", 1, lang=F.col("lang"), source=F.col("source"), chars=F.col("n_chars")).alias("content_fingerprint"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, char_start, char_start + length(line) AS char_end, sha256(line) AS line_sha256 FROM lines")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.line_table(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "char_start", "char_end", digests.sha256_text(F.col("line")).alias("line_sha256"))


@query("SELECT doc_id, sha256(text) AS text_sha256, length(text) AS chars, true AS whole FROM documents")
def page_assembly_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from their lines."""
    docs = table(spark, sf_dir, "documents")
    lines = text.line_table(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    built = lines.select("doc_id", F.array_join(F.col("l.line"), "\n").alias("built"))
    named = built.select("doc_id", digests.sha256_text(F.col("built")).alias("text_sha256"), F.length("built").cast("long").alias("chars"))
    return named.join(docs.select("doc_id", digests.sha256_text(F.col("text")).alias("was")), "doc_id").select("doc_id", "text_sha256", "chars", (F.col("was") == F.col("text_sha256")).alias("whole"))


@query(f"WITH {WINDOWS_SQL} SELECT doc_id, window_no, char_start, char_end, sha256(substring(text, char_start + 1, char_end - char_start)) AS chunk_sha256 FROM win")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.char_windows(table(spark, sf_dir, "documents")).select("doc_id", "window_no", "char_start", "char_end", digests.sha256_text(F.col("chunk")).alias("chunk_sha256"))


@query(f"""
WITH {WINDOWS_SQL}, damaged AS (SELECT doc_id, char_start, char_end FROM win WHERE NOT (doc_id % 5 = 0 AND window_no = 1) AND NOT (doc_id % 7 = 0 AND window_no = 0)),
seen AS (SELECT *, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM damaged),
per AS (SELECT doc_id, min(char_start) AS lo, max(char_end) AS hi, coalesce(bool_or(char_start > reach), false) AS gap FROM seen GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN lo IS NULL THEN 'missing' WHEN lo <> 0 THEN 'start' WHEN hi <> length(text) THEN 'end' ELSE 'gap' END AS reason
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id WHERE length(text) > 0 AND (lo IS NULL OR lo <> 0 OR hi <> length(text) OR gap)
""")
def window_coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of windows some of which were taken away."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    kept = text.char_windows(docs).where("not (doc_id % 5 = 0 and window_no = 1) and not (doc_id % 7 = 0 and window_no = 0)")
    return spans.coverage_violations(kept, docs.select("doc_id", F.length("text").cast("long").alias("size")), "doc_id")


@query(f"""
WITH {LINES_SQL}, damaged AS (SELECT doc_id, char_start, char_start + length(line) AS char_end FROM lines WHERE NOT (doc_id % 6 = 0 AND line_no = 1)),
m AS (SELECT *, coalesce(lag(char_end) OVER w + 1, 0) AS expected, lead(char_start) OVER w IS NULL AS last FROM damaged WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end))
SELECT m.doc_id, char_start, expected FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE char_start <> expected OR last AND char_end <> length(text)
""")
def tiling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = text.line_table(docs).where("not (doc_id % 6 = 0 and line_no = 1)").select("doc_id", "char_start", "char_end")
    return spans.tiling_violations(lines, docs.select("doc_id", F.length("text").cast("long").alias("size")), "doc_id", 1).withColumn("expected", F.col("expected").cast("long"))


def _lines_and_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = text.line_table(docs).where("char_end > char_start").select("doc_id", "line_no", F.col("char_start").alias("a_start"), F.col("char_end").alias("a_end"))
    b = text.char_windows(docs).select("doc_id", "window_no", F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"))
    return spans.overlap_join(a, b, "doc_id", 2048)


OVERLAP_SQL = f"""
WITH {LINES_SQL}, {WINDOWS_SQL}, hit AS (
  SELECT l.doc_id, line_no, window_no, l.char_start AS a0, l.char_start + length(line) AS a1, w.char_start AS b0, w.char_end AS b1
  FROM lines l JOIN win w ON l.doc_id = w.doc_id AND greatest(l.char_start, w.char_start) < least(l.char_start + length(line), w.char_end)
)"""


@query(OVERLAP_SQL + "SELECT doc_id, line_no, window_no, greatest(a0, b0) AS char_start, least(a1, b1) AS char_end, CASE WHEN a0 = b0 AND a1 = b1 THEN 'exact_text_range' ELSE 'overlapping_text_range' END AS kind FROM hit")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_and_windows(spark, sf_dir).select(
        "doc_id", "line_no", "window_no", F.greatest("a_start", "b_start").alias("char_start"), F.least("a_end", "b_end").alias("char_end"), spans.match_kind("a_start", "a_end", "b_start", "b_end").alias("kind")
    )


@query(OVERLAP_SQL + "SELECT doc_id, line_no, min(CASE WHEN a0 = b0 AND a1 = b1 THEN 'exact_text_range' ELSE 'overlapping_text_range' END) AS kind, count(*) AS matches FROM hit GROUP BY doc_id, line_no")
def span_overlap_best_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = _lines_and_windows(spark, sf_dir).withColumn("kind", spans.match_kind("a_start", "a_end", "b_start", "b_end"))
    return hit.groupBy("doc_id", "line_no").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("matches"))


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines WHERE greatest(line_no, 2) <= least(line_no, 4) GROUP BY doc_id")
def line_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4, both included."""
    hit = text.line_table(table(spark, sf_dir, "documents")).withColumns({"lo": F.lit(2), "hi": F.lit(4)}).where(spans.overlaps("line_no", "line_no", "lo", "hi", closed=True))
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"""
WITH {LINES_SQL}, l AS (SELECT * FROM lines WHERE length(line) > 0), s AS (SELECT line, count(*) AS n, min(doc_id) AS source_id FROM l WHERE doc_id % 2 = 0 GROUP BY line)
SELECT p.doc_id * 100000 + p.line_no AS piece_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN s.source_id END AS source_id
FROM l p LEFT JOIN s ON s.line = p.line WHERE p.doc_id % 2 = 1
""")
def exact_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of odd documents among those of even ones."""
    l = text.line_table(table(spark, sf_dir, "documents")).where("line <> ''")  # noqa: E741
    pieces = l.where("doc_id % 2 = 1").select((F.col("doc_id") * 100000 + F.col("line_no")).alias("piece_id"), "line")
    return spans.unique_match(pieces, l.where("doc_id % 2 = 0").select(F.col("doc_id").alias("source_id"), "line"), "line")


# -- sets


@query("""
WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id FROM labels)
(SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) x) UNION ALL (SELECT doc_id, 'right' FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a) y)
""")
def set_difference_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.two_sided_difference(table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("""
WITH assigned AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT -doc_id - 1 FROM labels WHERE doc_id % 13 = 0),
n AS (SELECT doc_id, count(*) AS times FROM assigned GROUP BY doc_id)
SELECT coalesce(d.doc_id, n.doc_id) AS doc_id, coalesce(times, 0) AS times, d.doc_id IS NOT NULL AS known FROM documents d FULL JOIN n ON n.doc_id = d.doc_id WHERE coalesce(times, 0) <> 1 OR d.doc_id IS NULL
""")
def exactly_once_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    assigned = docs.where("doc_id % 7 <> 0").union(docs.where("doc_id % 11 = 0")).union(labels.where("doc_id % 13 = 0").select(-F.col("doc_id") - 1))
    return sets.assignment_faults(docs, assigned, "doc_id")


@query("""
WITH o AS (SELECT lang || '/' || doc_id AS path, n_chars AS c FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT lang || '/' || doc_id AS path, n_chars + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS c FROM documents WHERE doc_id % 14 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.c <> n.c THEN 'changed' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON n.path = o.path
""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests of all documents; what either side lacks and what changed is planted."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "lang", F.col("doc_id").cast("string")))
    new = docs.where("doc_id % 14 <> 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0))
    return versions.manifest_diff(docs.where("doc_id % 10 <> 0"), new, "path", "n_chars")


@query("""
WITH pairs AS (SELECT DISTINCT l_suppkey, l_returnflag AS flag FROM lineitem)
SELECT l_suppkey FROM pairs GROUP BY l_suppkey HAVING count(DISTINCT flag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)
""")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag")
    return sets.relational_division(items, "l_suppkey", "l_returnflag", items.select("l_returnflag"))


@query("""
WITH t AS (SELECT doc_id FROM labels WHERE quality = 1), s AS (SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars > 1000), m AS (SELECT count(*) AS n FROM t JOIN s ON s.doc_id = t.doc_id)
SELECT m.n AS matched, (SELECT count(*) FROM s) AS declared, (SELECT count(*) FROM t) AS expected, round(m.n / (SELECT count(*) FROM s), 6) AS precision, round(m.n / (SELECT count(*) FROM t), 6) AS recall, round(2.0 * m.n / ((SELECT count(*) FROM s) + (SELECT count(*) FROM t)), 6) AS f1 FROM m
""")
def pair_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    said = table(spark, sf_dir, "documents").where("n_chars > 1000").join(labels, "doc_id", "left_semi")
    out = sets.precision_recall(labels.where("quality = 1"), said, ["doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("SELECT lang, bucket, n FROM (SELECT lang, n_chars // 500 AS bucket, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, n_chars // 500) AS r FROM documents GROUP BY lang, n_chars // 500) x WHERE r = 1")
def mode_with_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.mode(table(spark, sf_dir, "documents").select("lang", F.floor(F.col("n_chars") / 500).alias("bucket")), ["lang"], "bucket")


@query("""
SELECT o_orderkey, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS items, count(DISTINCT l_suppkey) AS suppliers
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def ordered_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    packed = items.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))))).alias("items"), F.count_distinct("l_suppkey").alias("suppliers"))
    return orders.join(packed, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "items", "suppliers")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


# -- versions


@query(f"WITH {CHAIN_SQL} SELECT lang, source, doc_id, data_id, version_number, parent, is_head FROM chain")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_chain(chain_rows(spark, sf_dir), ["lang", "source"], "doc_id", "data_id")


@query(f"""
WITH {CHAIN_SQL}, per AS (SELECT data_id, lang, source, bool_or(is_head) AS head FROM chain GROUP BY ALL)
SELECT data_id, CASE WHEN bool_and(head) THEN 'current' ELSE 'historical' END AS status, count(*) AS series_count FROM per GROUP BY data_id
""")
def source_version_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = versions.version_chain(chain_rows(spark, sf_dir), ["lang", "source"], "doc_id", "data_id")
    return versions.version_status(chain, ["lang", "source"], "data_id")


# -- relations


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_event_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value")


def _edge_tables(spark: SparkSession, sf_dir: str):
    """Edges between customers, judged by the log of events; errors are fences and views and clicks are verdicts."""
    c, e = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    edges = c.where("c_custkey > 0").select(
        F.col("c_custkey").alias("edge_id"), F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 2).alias("dst"), (F.col("c_custkey") % 17 != 0).alias("current"), (F.col("c_custkey") % 5 != 0).alias("original")
    )
    events = e.where("event_type <> 'error'").select(F.col("user_id").alias("edge_id"), F.col("event_id").alias("event_order"), F.when(F.col("event_id") % 3 != 2, F.col("event_id") % 3 == 0).alias("applicable"))
    fences = e.where("event_type = 'error'").select(F.col("user_id").alias("edge_id"), F.col("event_id").alias("fence_order"))
    usable = c.where("c_acctbal > -900").select(F.col("c_custkey").alias("node"))
    predicates = c.select(F.col("c_custkey").alias("edge_id"), F.when(F.col("c_nationkey") % 4 == 0, "contradicts").otherwise("supports").alias("predicate"))
    return edges, events, fences, usable, predicates


STATUS_SQL = """
WITH ev AS (SELECT user_id AS edge_id, max(event_id) AS o, arg_max(CASE WHEN event_id % 3 <> 2 THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END ELSE 2 END, event_id) AS a FROM events WHERE event_type <> 'error' GROUP BY 1),
fe AS (SELECT user_id AS edge_id, max(event_id) AS f FROM events WHERE event_type = 'error' GROUP BY 1), u AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > -900),
st AS (
  SELECT c_custkey AS edge_id, c_custkey AS src, c_custkey // 2 AS dst, c_nationkey,
    CASE WHEN c_custkey % 17 = 0 THEN 'historical' WHEN c_custkey NOT IN (SELECT node FROM u) OR c_custkey // 2 NOT IN (SELECT node FROM u) THEN 'endpoint_unusable'
         WHEN coalesce(f, -1) > coalesce(o, -1) THEN 'pending' WHEN o IS NULL THEN CASE WHEN c_custkey % 5 <> 0 THEN 'applicable' ELSE 'pending' END
         WHEN a = 2 THEN 'pending' WHEN a = 1 THEN 'applicable' ELSE 'inapplicable' END AS status
  FROM customer LEFT JOIN ev ON ev.edge_id = c_custkey LEFT JOIN fe ON fe.edge_id = c_custkey WHERE c_custkey > 0
)"""


@query(STATUS_SQL + " SELECT edge_id, src, dst, status FROM st")
def applicability_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edge_status(*_edge_tables(spark, sf_dir)[:4])


@query(STATUS_SQL + " SELECT DISTINCT node FROM (SELECT src AS node FROM st WHERE status = 'applicable' AND c_nationkey % 4 = 0 UNION ALL SELECT dst FROM st WHERE status = 'applicable' AND c_nationkey % 4 = 0) x")
def contested_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    *four, predicates = _edge_tables(spark, sf_dir)
    return relations.contested(relations.edge_status(*four), predicates)


@query(f"""
WITH {DAG_SQL.strip()}, n AS (SELECT DISTINCT user_id AS node FROM events WHERE event_type = 'error')
SELECT DISTINCT * FROM (SELECT dst AS node, 'derivation' AS route, src AS ref FROM dag WHERE dst IN (SELECT node FROM n) UNION ALL SELECT user_id, 'event', event_id FROM events WHERE user_id IN (SELECT node FROM n)) x
""")
def impact_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return relations.impacts(
        e.where("event_type = 'error'").select(F.col("user_id").alias("node")), derivation=dag(spark, sf_dir).select(F.col("dst").alias("node"), F.col("src").alias("ref")), event=e.select(F.col("user_id").alias("node"), F.col("event_id").alias("ref"))
    )


# -- graph


@query(CLOSURE_SQL + " SELECT src, dst FROM closure")
def ancestors_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(dag(spark, sf_dir))


@query(CLOSURE_SQL + ", g AS (SELECT p_partkey AS node, p_brand AS data_id FROM part) SELECT DISTINCT node, data_id FROM (SELECT node, data_id FROM g UNION ALL SELECT src, data_id FROM closure JOIN g ON g.node = closure.dst) x")
def source_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lineage(dag(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("data_id")))


@query(CLOSURE_SQL + " SELECT src AS node, count(*) AS stale_origins FROM closure WHERE dst IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY src")
def stale_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stale(dag(spark, sf_dir), table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("node")))


@query(f"""
WITH RECURSIVE {DAG_SQL.strip()}, walk(node, d) AS (SELECT dst, 0 FROM dag UNION SELECT dag.src, walk.d + 1 FROM walk JOIN dag ON dag.dst = walk.node)
SELECT node, CAST(max(d) AS BIGINT) AS depth FROM walk GROUP BY node
""")
def derivation_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(dag(spark, sf_dir))


@query(f"""
WITH RECURSIVE {DAG_SQL.strip()}, e AS (SELECT src, dst FROM dag UNION SELECT p_partkey // 8, p_partkey FROM part WHERE p_partkey % 97 = 1 AND p_partkey >= 8),
closure(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM closure c JOIN e ON c.dst = e.src) SELECT src AS node FROM closure WHERE src = dst
""")
def acyclicity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the graph with some edges back."""
    back = table(spark, sf_dir, "part").where("p_partkey % 97 = 1 and p_partkey >= 8").select(F.floor(F.col("p_partkey") / 8).alias("src"), F.col("p_partkey").alias("dst"))
    return graph.cycle_nodes(dag(spark, sf_dir).unionByName(back))


@query(f"""
WITH RECURSIVE {DAG_SQL.strip()}, ok(node) AS (
  SELECT * FROM (SELECT DISTINCT dst AS node FROM dag WHERE dst NOT IN (SELECT src FROM dag) AND dst % 5 <> 4) b
  UNION SELECT d.src FROM ok JOIN dag d ON d.dst = ok.node
) SELECT node FROM ok
""")
def reachable_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with at least one premise route down to a base node: a derivation for every edge."""
    edges = dag(spark, sf_dir)
    leaves = edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti").where("node % 5 <> 4")
    each = edges.select(F.concat_ws("-", "src", "dst").alias("derivation"), F.col("src").alias("result"), F.col("dst").alias("premise"))
    return graph.supported(each, leaves).select("node")


@query(f"""
WITH {DAG_SQL.strip()} SELECT node, CAST(length(bin(node)) - 1 AS INTEGER) AS round FROM (SELECT src AS node FROM dag UNION SELECT dst FROM dag)
""")
def support_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes all of whose premises are supported down to base nodes, with the round in which they are."""
    edges = dag(spark, sf_dir)
    leaves = edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti").where("node % 5 <> 4")
    return graph.supported(edges.select(F.col("src").alias("derivation"), F.col("src").alias("result"), F.col("dst").alias("premise")), leaves)


@query(CLOSURE_SQL + """
, s AS (SELECT p_partkey AS node, p_size AS record FROM part), r AS (SELECT src, dst FROM closure UNION SELECT node, node FROM s)
SELECT src AS node, sha256(string_agg(dst || '=' || record, ',' ORDER BY dst)) AS signature FROM r JOIN s ON s.node = r.dst GROUP BY src
""")
def support_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.signatures(dag(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("record")))


@query(f"""
WITH {DAG_SQL.strip()}, e AS (SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN 'contradicts' ELSE 'supports' END AS p FROM dag UNION ALL SELECT dst, src, 'contradicts' FROM dag WHERE (src + dst) % 3 = 0)
SELECT DISTINCT p AS predicate, sha256(p || '|' || CASE WHEN p = 'contradicts' THEN least(src, dst) || '|' || greatest(src, dst) ELSE src || '|' || dst END) AS fingerprint FROM e
""")
def edge_fingerprint_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = dag(spark, sf_dir).withColumn("p", F.when((F.col("src") + F.col("dst")) % 3 == 0, "contradicts").otherwise("supports"))
    both = edges.unionByName(edges.where("p = 'contradicts'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"))
    turned = F.col("p") == "contradicts"
    lo, hi = F.when(turned, F.least("src", "dst")).otherwise(F.col("src")), F.when(turned, F.greatest("src", "dst")).otherwise(F.col("dst"))
    return both.select(F.col("p").alias("predicate"), digests.sha256_text(F.concat_ws("|", "p", lo.cast("string"), hi.cast("string"))).alias("fingerprint")).distinct()


# -- vectors

UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"


@query(f"WITH {UNIT_SQL} SELECT a.vec_id, round(list_inner_product(a.v, q.v), 6) AS score FROM u a, (SELECT v FROM u WHERE vec_id = 7) q ORDER BY list_inner_product(a.v, q.v) DESC, vec_id LIMIT 24")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    [q] = vectors.where("vec_id = 7").select("embedding").collect()
    return retrieval.topk(vectors, list(q[0]), 24).withColumn("score", F.round("score", 6))


@query(f"""
WITH {UNIT_SQL}, p AS (SELECT q.vec_id AS query_id, a.vec_id, list_inner_product(a.v, q.v) AS s FROM u q JOIN u a ON a.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 3
""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all vectors to each whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = retrieval.cosine_topk(vectors, asked, 4).where("query_id <> vec_id")
    return sets.top_per_group(best.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("vec_id")], 3).withColumn("score", F.round("score", 6))


@query(f"""
WITH {UNIT_SQL}, p AS (SELECT a.vec_id AS node, b.vec_id AS other, round(list_inner_product(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s DESC, other DESC) AS rank FROM p WHERE s >= 0.75)
SELECT least(node, other) AS src, greatest(node, other) AS dst, round(max(s), 8) AS score FROM r WHERE rank <= 3 GROUP BY ALL
""")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's three nearest at a cosine of 0.75 or more, over all vectors."""
    return retrieval.neighbour_graph(table(spark, sf_dir, "embeddings"), 3, 0.75).withColumn("score", F.round("score", 8))


@query(f"""
WITH {UNIT_SQL}, s AS (SELECT a.label, a.vec_id, round(list_inner_product(a.v, q.v), 12) AS s FROM u a, (SELECT v FROM u WHERE vec_id = 7) q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s) SELECT label, vec_id, round(s, 6) AS score FROM r WHERE rank = 1 ORDER BY s DESC, vec_id LIMIT 8
""")
def rank_distinct_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for documents and vectors for their chunks."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = retrieval.normalised(vectors.where("vec_id = 7"), "vec_id", "embedding").select(F.col("v").alias("q"))
    scored = retrieval.normalised(vectors, "vec_id", "embedding").join(vectors.select("vec_id", "label"), "vec_id").join(F.broadcast(asked))
    scored = scored.select("label", "vec_id", F.round(retrieval.dot(F.col("v"), F.col("q")), 12).alias("score"))
    return retrieval.rank_distinct_cut(scored, "label", "vec_id", 8).withColumn("score", F.round("score", 6))


@query("""
WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT m.label, CAST(pos AS INT) AS pos, round(m / n, 6) AS value FROM m JOIN n ON n.label = m.label
""")
def mean_pool_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.mean_pool(table(spark, sf_dir, "embeddings"), "label").withColumn("value", F.round("value", 6))


@query("""
WITH q AS (SELECT vec_id AS t, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 4), s AS (SELECT label, t, max(list_inner_product(CAST(embedding AS DOUBLE[]), q)) AS s FROM embeddings, q GROUP BY ALL)
SELECT label, round(avg(s), 6) AS score FROM s GROUP BY label
""")
def maxsim_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id < 4").select(F.col("vec_id").alias("token_id"), "embedding")
    return retrieval.maxsim(vectors, asked).withColumn("score", F.round("score", 6))


# -- worklist


@query("""
SELECT role, turn_class, n, seen FROM (
  SELECT a.role, a.turn % 3 AS turn_class, count(*) AS n, count(b.turn) AS seen FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 GROUP BY ALL) x
""")
def neighbourhood_pm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    following = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    marked = c.withColumn("next", F.when(following == F.col("turn") + 1, following))
    return marked.groupBy("role", (F.col("turn") % 3).alias("turn_class")).agg(F.count(F.lit(1)).alias("n"), F.count("next").alias("seen"))


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error' AND event_id > coalesce(ok, -1)) AS BIGINT) AS streak FROM (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS ok FROM events) x GROUP BY user_id")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.streaks(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


@query("SELECT event_type AS state, count(*) AS tasks, count(DISTINCT user_id) AS owners FROM events GROUP BY event_type")
def task_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("tasks"), F.count_distinct("user_id").alias("owners"))


@query("""
WITH t AS (SELECT event_id AS task_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'outbox' WHEN 'purchase' THEN 'node_revalidate' WHEN 'view' THEN 'n2e' ELSE 'wiki' END AS kind FROM events)
SELECT task_id, kind, CASE kind WHEN 'outbox' THEN 0 WHEN 'node_revalidate' THEN 1 WHEN 'n2e' THEN 2 ELSE 3 END AS priority, created_at FROM t ORDER BY 3, created_at, task_id LIMIT 100
""")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "outbox").when(F.col("event_type") == "purchase", "node_revalidate").when(F.col("event_type") == "view", "n2e").otherwise("wiki")
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), kind.alias("kind"), F.col("ts").alias("created_at"))
    return worklist.claim_order(tasks, 100)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def undispatched_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.undispatched(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""
SELECT (SELECT count(*) FROM orders) AS prepared, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS dispatched, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS undispatched,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS unfinished, (SELECT count(*) = 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) OR o_orderstatus <> 'F') AS complete
""")
def completion_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("sent", F.lit(1))
    both = orders.join(done, "o_orderkey", "full")
    counts = both.agg(
        F.count("o_orderstatus").alias("prepared"), F.count("sent").alias("dispatched"), F.count_if(F.col("sent").isNull()).alias("undispatched"), F.count_if(F.col("o_orderstatus") != "F").alias("unfinished")
    )
    return counts.withColumn("complete", (F.col("undispatched") == 0) & (F.col("unfinished") == 0))


@query("""
SELECT user_id, event_id, first AS value, before FROM (SELECT user_id, event_id, event_type, lag(event_type, 1) OVER w AS before, lag(event_type, 2) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x
WHERE first = event_type AND before <> event_type
""")
def oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklist.oscillations(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations
), f AS (
  SELECT conv_id, turn, size, k, size AS held, CAST(0 AS BIGINT) AS batch_no FROM t WHERE k = 1
  UNION ALL
  SELECT conv_id, turn, size, k, CASE WHEN new THEN size ELSE before + size END, batch_no + CASE WHEN new THEN 1 ELSE 0 END
  FROM (SELECT t.*, f.held AS before, f.batch_no, f.held > 0 AND f.held + t.size > 800 AS new FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
)
SELECT conv_id, turn, size, batch_no FROM f
""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return worklist.greedy_batches(turns, ["conv_id"], "turn", "size", 800)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_latest(spark, f"{sf_dir}/events.parquet*", ["user_id", "event_type"], "event_id", "value")


# -- read models


@query("""
SELECT source, count(*) AS documents, count(l.doc_id) AS labelled, CAST(coalesce(sum(l.toxic), 0) AS BIGINT) AS toxic, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source
""")
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("has"))
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count("has").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars")
    )


@query("""
SELECT source, CASE WHEN bool_or(quality = 0 AND toxic = 1) THEN 'needs_review' WHEN bool_or(quality = 1 AND toxic = 0 AND doc_id % 40 = 0) THEN 'selected' WHEN bool_or(toxic = 1) THEN 'context_only' ELSE 'not_selected' END AS disposition, count(*) AS reviews
FROM labels JOIN documents USING (doc_id) GROUP BY source
""")
def batch_disposition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One disposition from several reviews: needs_review, selected, context_only and not_selected, in this order."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rank = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 0).when((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("doc_id") % 40 == 0), 1).when(F.col("toxic") == 1, 2).otherwise(3)
    names = F.array(*map(F.lit, ("needs_review", "selected", "context_only", "not_selected")))
    return rows.groupBy("source").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("reviews")).select("source", F.element_at(names, F.col("r") + 1).alias("disposition"), "reviews")


@query("SELECT lang, count(*) AS hits FROM documents WHERE contains(lower(text), 'license') GROUP BY lang")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.lower("text").contains("license")).groupBy("lang").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT sha256(text) AS data_id, count(DISTINCT source) AS stores, string_agg(DISTINCT source, ',' ORDER BY source) AS store_ids FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def cross_source_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(digests.sha256_text(F.col("text")).alias("data_id"), "source")
    stores = named.groupBy("data_id").agg(F.array_sort(F.collect_set("source")).alias("s")).where("size(s) > 1")
    return stores.select("data_id", F.size("s").cast("long").alias("stores"), F.array_join("s", ",").alias("store_ids"))


# -- storage


@query("SELECT doc_id AS request_id, sha256(text) AS data_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) AND text NOT IN (SELECT text FROM benchmark) THEN 'committed' ELSE 'duplicate' END AS state FROM documents")
def import_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), digests.sha256_text(F.col("text")).alias("data_id"))
    return store.import_states(requests, table(spark, sf_dir, "benchmark").select(digests.sha256_text(F.col("text")).alias("data_id")))


@query("SELECT user_id, event_id, CASE WHEN n = 1 THEN 'new' WHEN event_type = f THEN 'replay' ELSE 'idempotency_conflict' END AS state FROM (SELECT user_id, event_id, event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("fingerprint"), F.col("event_id").alias("order"))
    return store.replays(sent).select(F.col("request_id").alias("user_id"), F.col("order").alias("event_id"), "state")


@query("SELECT DISTINCT sha256(text) AS data_id, strlen(text) AS bytes, true AS whole FROM documents")
def segment_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at line ends, equal lines stored once, put together again."""
    docs = table(spark, sf_dir, "documents").withColumn("data_id", digests.sha256_text(F.col("text"))).dropDuplicates(["data_id"]).withColumn("n", F.length("text"))
    lines = text.line_table(docs.select("data_id", "text"), "data_id").join(docs.select("data_id", "n"), "data_id")
    body = F.when(F.col("char_end") < F.col("n"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")).cast("binary")
    built = store.reassembled(*store.segmented(lines.select("data_id", F.col("line_no").alias("pos"), body.alias("body"))))
    return built.select("data_id", F.length("content").cast("long").alias("bytes"), "whole")


# -- segmentation


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER w, 0) AS BIGINT) AS char_start, CAST(coalesce(sum(length(text) + 2) OVER w, 0) + length(text) AS BIGINT) AS char_end
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def page_assembly_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.assembled(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").drop("text")


@query("""
WITH w AS (SELECT doc_id, n_chars AS n FROM documents WHERE n_chars > 0) SELECT doc_id, CAST(n AS BIGINT) AS chars, true AS tiled FROM w
""")
def long_text_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of at most 800 characters, and whether they tile their text."""
    ranges = segments.split_texts(table(spark, sf_dir, "documents"), 800).withColumn("before", F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("part")))
    ok = (F.col("char_start") == F.coalesce("before", F.lit(0))) & (F.col("char_end") - F.col("char_start") <= 800)
    return ranges.groupBy("doc_id").agg(F.max("char_end").alias("chars"), F.bool_and(ok).alias("tiled"))


@query(f"""
WITH RECURSIVE {LINES_SQL.strip()}, t AS (SELECT doc_id, line_no AS ord, line_no // 20 AS page, length(line) AS chars FROM lines), f AS (
  SELECT doc_id, ord, page, chars AS held, 1 AS pages, CAST(0 AS BIGINT) AS chunk_no FROM t WHERE ord = 0
  UNION ALL
  SELECT doc_id, ord, page, CASE WHEN new THEN chars ELSE held + 2 + chars END, CASE WHEN new THEN 1 ELSE pages + turned END, chunk_no + CASE WHEN new THEN 1 ELSE 0 END
  FROM (
    SELECT t.*, f.held, f.pages, f.chunk_no, CASE WHEN t.page <> f.page THEN 1 ELSE 0 END AS turned,
           f.held + 2 + t.chars > 2000 OR f.pages + CASE WHEN t.page <> f.page THEN 1 ELSE 0 END > 2 AS new
    FROM f JOIN t ON t.doc_id = f.doc_id AND t.ord = f.ord + 1
  )
)
SELECT doc_id, ord, chunk_no FROM f
""")
def bounded_group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.line_table(table(spark, sf_dir, "documents"))
    return segments.bounded_chunks(lines.select("doc_id", F.col("line_no").alias("ord"), F.floor(F.col("line_no") / 20).alias("page"), F.length("line").alias("chars")), "doc_id", 2000, 2)


@query("""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS BIGINT) AS headings FROM pages WHERE regexp_matches(html, '(?i)<h[1-6][ >]')
""")
def heading_sections_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.html_headings(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("headings"))


@query()
def figure_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.figure_mentions(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS "group", least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey),
t AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY a, b) AS k FROM p), f AS (
  SELECT "group", a, b, k, [a, b] AS nodes, 1 AS n, CAST(0 AS BIGINT) AS batch_no FROM t WHERE k = 1
  UNION ALL
  SELECT "group", a, b, k, CASE WHEN new THEN [a, b] ELSE more END, CASE WHEN new THEN 1 ELSE n + 1 END, batch_no + CASE WHEN new THEN 1 ELSE 0 END
  FROM (SELECT *, len(more) > 64 OR n >= 200 AS new FROM (
    SELECT t.*, f.n, f.batch_no, list_distinct(list_concat(f.nodes, [t.a, t.b])) AS more FROM f JOIN t ON t."group" = f."group" AND t.k = f.k + 1
  ))
)
SELECT "group", a, b, batch_no FROM f
""")
def pair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group"), F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).where("a <> b").distinct()
    return segments.pair_batches(pairs, 64, 200)


# -- reviews


@query("""
WITH r AS (SELECT source AS unit_id, doc_id % 7 AS batch, CASE WHEN quality = 0 AND toxic = 1 AND doc_id % 3 = 0 THEN 'needs_review' WHEN toxic = 1 THEN 'context_only' ELSE 'not_selected' END AS disposition, lang AS reason FROM labels JOIN documents USING (doc_id)),
c AS (SELECT DISTINCT source AS unit_id FROM documents WHERE doc_id % 50 = 0), f AS (SELECT unit_id, reason, min(batch) AS b FROM r GROUP BY ALL), t AS (SELECT unit_id, string_agg(reason, '; ' ORDER BY b, reason) AS reasons FROM f GROUP BY unit_id)
SELECT r.unit_id, CASE WHEN bool_or(disposition = 'needs_review') THEN 'needs_review' WHEN r.unit_id IN (SELECT unit_id FROM c) THEN 'selected' WHEN bool_or(disposition = 'context_only') THEN 'context_only' ELSE 'not_selected' END AS disposition, any_value(reasons) AS reasons
FROM r JOIN t ON t.unit_id = r.unit_id GROUP BY r.unit_id
""")
def merged_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    bad = (F.col("quality") == 0) & (F.col("toxic") == 1) & (F.col("doc_id") % 3 == 0)
    said = F.when(bad, "needs_review").when(F.col("toxic") == 1, "context_only").otherwise("not_selected")
    reviews = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("source").alias("unit_id"), (F.col("doc_id") % 7).alias("batch"), said.alias("disposition"), F.col("lang").alias("reason"))
    return review.merged_dispositions(reviews, docs.where("doc_id % 50 = 0").select(F.col("source").alias("unit_id")))


@query("""
SELECT doc_id AS target_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 5 = 4 OR (toxic = 1 AND quality = 0) THEN 'needs_human' WHEN toxic = 1 THEN 'accepted_revision' ELSE 'reused' END AS decision FROM labels
""")
def materiality_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("target_id"), (F.col("doc_id") % 11 != 0).alias("identity_confirmed"), (F.col("doc_id") % 13 != 0).alias("grounding_valid"), F.when(F.col("doc_id") % 5 != 4, F.col("toxic") == 1).alias("material_change"), (F.col("quality") == 1).alias("content_changed")
    )
    return review.materiality(rows)


@query("""
WITH RECURSIVE l AS (SELECT p_partkey AS key, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS target FROM part), walk(key, node) AS (SELECT key, target FROM l UNION SELECT walk.key, l.target FROM walk JOIN l ON l.key = walk.node),
cyc AS (SELECT key AS node FROM walk WHERE key = node) SELECT walk.key, min(walk.node) AS root FROM walk JOIN cyc ON cyc.node = walk.node GROUP BY walk.key
""")
def reuse_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = part.count()
    return review.reuse_roots(part.select(F.col("p_partkey").alias("key"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % n).alias("target")))


@query("""
WITH o AS (SELECT *, n_chars // 200 AS content FROM documents WHERE doc_id % 2 = 1), c AS (SELECT *, n_chars // 200 AS content FROM documents WHERE doc_id % 2 = 0),
i AS (SELECT lang, n_chars, min(doc_id) AS by_identity, min(content) AS old FROM c GROUP BY ALL), a AS (SELECT lang, content, source, count(*) AS n, min(doc_id) AS by_content FROM c GROUP BY ALL)
SELECT doc_id AS candidate, CASE WHEN by_identity IS NOT NULL THEN CASE WHEN old = o.content THEN 'reused' ELSE 'conflict' END WHEN n > 1 THEN 'needs_human' WHEN n = 1 THEN 'reused' ELSE 'accepted_new' END AS decision,
       CASE WHEN by_identity IS NOT NULL THEN CASE WHEN old = o.content THEN by_identity END WHEN n = 1 THEN by_content END AS node
FROM o LEFT JOIN i ON i.lang = o.lang AND i.n_chars = o.n_chars LEFT JOIN a ON a.lang = o.lang AND a.content = o.content AND a.source = o.source
""")
def fingerprint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), F.col("n_chars").alias("identity"), F.floor(F.col("n_chars") / 200).alias("content"), F.col("source").alias("scope"))
    return review.reuse_by_fingerprint(rows.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "candidate"), rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "node"))


@query("""
WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS d, count(*) AS n, bool_or(p_size >= 40) AS strange FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT o_orderkey AS proposal_id, CASE WHEN o_orderstatus = 'P' THEN 'result_is_no_proposition' WHEN coalesce(d, 0) < 2 THEN 'too_few_premises' WHEN n > d THEN 'premise_repeated' ELSE 'premise_is_no_input' END AS fault
FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' OR coalesce(d, 0) < 2 OR n > d OR strange
""")
def proposal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("proposal_id"), F.when(F.col("o_orderstatus") == "P", "observation").otherwise("proposition").alias("kind"))
    premises = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_partkey").alias("node"))
    return review.proposal_faults(proposals, premises, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("node")))


@query("SELECT l_orderkey AS parchment, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts, sha256(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY l_orderkey")
def ordered_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parchment"), F.struct("l_linenumber", "l_partkey").alias("ord"), F.col("l_partkey").alias("part"))
    return review.compositions(items)


@query("""
SELECT n_regionkey AS key, n_nationkey AS option, s AS criterion FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) x
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = s AND c_acctbal > 9000)
""")
def matrix_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    options = nations.select(F.col("n_regionkey").alias("key"), F.col("n_nationkey").alias("option"))
    criteria = options.select("key").distinct().join(F.broadcast(customers.select(F.col("c_mktsegment").alias("criterion")).distinct()))
    cells = customers.where("c_acctbal > 9000").join(options, F.col("c_nationkey") == F.col("option")).select("key", "option", F.col("c_mktsegment").alias("criterion")).distinct()
    return review.matrix_gaps(options, criteria, cells)


# -- realms and disclosure


@query("""
WITH x AS (SELECT lang, doc_id, n_chars % 3 AS m, lag(n_chars % 3) OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM documents)
SELECT lang AS realm, row_number() OVER w AS revision, doc_id AS valid_from, lead(doc_id) OVER w AS valid_to, CAST(m AS VARCHAR) AS members FROM x WHERE b IS NULL OR b <> m WINDOW w AS (PARTITION BY lang ORDER BY doc_id)
""")
def realm_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "documents").select(F.col("lang").alias("realm"), F.col("doc_id").alias("at"), F.array((F.col("n_chars") % 3).cast("string")).alias("members"))
    return realms.revisions(changes).withColumn("members", F.array_join("members", ","))


@query("SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal <= 0)")
def disclosed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("data_id"))
    return realms.disclosed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")), sources, table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("data_id")))


@query(f"WITH {DAG_SQL.strip()}, v AS (SELECT p_partkey AS node FROM part WHERE p_size < 25) SELECT src, dst FROM dag WHERE src IN (SELECT node FROM v) AND dst IN (SELECT node FROM v)")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realms.visible_edges(dag(spark, sf_dir), table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("node"))).select("src", "dst")


@query("""
SELECT conv_id AS page, turn AS snapshot, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS age, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM CASE WHEN turn > 0 THEN turn - 1 END AS broken FROM conversations
""")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("snapshot"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("previous"), F.col("turn").alias("ord"))
    return realms.snapshot_history(turns)
