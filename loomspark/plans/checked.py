"""Queries of predicates, coverage, places on a page, retrieval units and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import figures, scalars, text
from loomspark.operators import checks, relations, sets
from loomspark.plans.catalogue import LINES_SQL
from loomspark.plans.registry import query
from loomspark.sources.tables import table


@query("SELECT event_id, event_id % 3 = 0 AS exact, event_id % 3 <> 2 AS has_k FROM events")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    said = F.when(key % 3 == 0, F.col("props")).when(key % 3 == 1, F.lit('{"k": 1, "z": [1]}')).otherwise(F.lit("not json"))
    return table(spark, sf_dir, "events").select("event_id", checks.has_keys(said, ["k"]).alias("exact"), checks.json_has(said, "$.k").alias("has_k"))


@query("""
WITH x AS (
  SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS h, ['a/b.txt', '/a', 'a/../b', 'a//b', './a', 'a/..b/c'][p_partkey % 6 + 1] AS path, ['a-b1', 'a--b', 'A', '', 'x'][p_partkey % 5 + 1] AS slug FROM part
)
SELECT p_partkey, p_partkey % 2 = 0 AS sha, p_partkey % 6 IN (0, 5) AS safe_path, p_partkey % 5 IN (0, 4) AS slug_ok, h[13:13] = '7' AND h[17:17] IN ('8', '9', 'a', 'b') AS version7 FROM x
""")
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    h = F.sha2(key.cast("string").cast("binary"), 256)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, sf_dir, "part").select(
        key, F.when(key % 2 == 0, h).otherwise(F.upper(h)).rlike(checks.SHA256).alias("sha"), pick(["a/b.txt", "/a", "a/../b", "a//b", "./a", "a/..b/c"]).rlike(checks.SAFE_PATH).alias("safe_path"),
        pick(["a-b1", "a--b", "A", "", "x"]).rlike(checks.SLUG).alias("slug_ok"), uuid.rlike(checks.UUID7).alias("version7"),
    )


@query("SELECT event_id, true AS ok, true AS ordered FROM events")
def time_ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    made = table(spark, sf_dir, "events").select("event_id", "user_id", scalars.uuid7(F.col("event_id") * 1000 + 1_700_000_000_000, F.col("event_id")).alias("id"))
    before = F.lag("id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return made.select("event_id", F.col("id").rlike(checks.UUID7).alias("ok"), F.coalesce(before < F.col("id"), F.lit(True)).alias("ordered"))


@query("SELECT l_orderkey, list_has_all([0, 1, 2], list(DISTINCT l_suppkey % 4)) AS allowed FROM lineitem GROUP BY l_orderkey")
def array_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 4).alias("used"))
    return used.select("l_orderkey", checks.contained(F.col("used"), F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("allowed"))


@query("""
SELECT p_partkey, CASE WHEN p_size = 3 THEN 'removed' WHEN p_size = 4 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_size IN (3, 4) OR p_size IN (5, 6)
""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = part.where("p_size <> 3").withColumn("p_name", F.when(F.col("p_size") == 5, "x").when(F.col("p_size") != 6, F.col("p_name")))
    return checks.changed_rows(part.where("p_size <> 4"), new, "p_partkey")


@query("""
SELECT o_custkey, bool_and(NOT (o_orderkey % 50 = 0)) AS same FROM orders GROUP BY o_custkey
""")
def same_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return checks.same_multiset(a, a.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 50 == 0, F.lit("x")).otherwise(F.col("o_orderpriority"))), "o_custkey", "o_orderpriority")


@query("SELECT l_orderkey, CAST(1 AS BIGINT) AS missing FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY l_orderkey")
def incomplete_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.monotonically_increasing_id().alias("item"))
    n = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select("l_orderkey", F.sequence(F.lit(1), F.col("n") + F.when(F.col("l_orderkey") % 9 == 0, 1).otherwise(0)).alias("wanted"))
    return checks.incomplete_links(lines, wanted, "l_orderkey")


@query("""
SELECT l_orderkey, array_to_string(coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A')), list_sort(list(DISTINCT l_suppkey))), ',') AS ids FROM lineitem GROUP BY l_orderkey
""")
def ids_or_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("own"), F.collect_list("l_suppkey").alias("other"))
    return both.select("l_orderkey", F.array_join(checks.ids_or(F.col("own"), F.col("other")).cast("array<string>"), ",").alias("ids"))


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS first_at FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(v, ',' ORDER BY first_at) AS "values" FROM f GROUP BY o_custkey
""")
def first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.first_order(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


NUMBERED_SQL = """
WITH w AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey),
g AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS page FROM orders),
asked AS (SELECT k, unnest(range(n)) AS page FROM w), got AS (SELECT k, page, count(*) AS times FROM g GROUP BY ALL)
SELECT coalesce(asked.k, got.k) AS document, coalesce(asked.page, got.page) AS page, CASE WHEN times IS NULL THEN 'missing' WHEN asked.k IS NULL THEN 'beyond' ELSE 'repeated' END AS fault
FROM asked FULL JOIN got ON asked.k = got.k AND asked.page = got.page WHERE times IS NULL OR asked.k IS NULL OR times > 1
"""


@query(NUMBERED_SQL)
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "document")
    page = F.row_number().over(Window.partitionBy("document").orderBy("o_orderkey")) - 1 + F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0)
    return checks.coverage(orders.groupBy("document").agg(F.count(F.lit(1)).alias("n")), orders.select("document", page.alias("page")), "document", "page")


@query("""
SELECT l_orderkey AS document, l_linenumber AS figure, CASE max(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)
  WHEN 2 THEN 'covered' WHEN 1 THEN 'incomplete' ELSE 'pending' END AS status FROM lineitem GROUP BY ALL
""")
def figure_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("figure"), "l_returnflag", "l_suppkey")
    decisions = lines.where("l_returnflag <> 'N'").select("document", "figure", (F.col("l_returnflag") == "R").alias("accepted"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("place"))
    return checks.figure_ledger(lines.select("document", "figure"), decisions)


@query("SELECT l_orderkey, l_suppkey % 3 AS at, count(*) AS blocks FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def reading_order_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.order_ties(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("at")), ["l_orderkey"], "at")


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS document, l_partkey AS page FROM lineitem)
SELECT a.document, a.page, b.page AS before, c.page AS after FROM p a LEFT JOIN p b ON b.document = a.document AND b.page = a.page - 1 LEFT JOIN p c ON c.document = a.document AND c.page = a.page + 1
""")
def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document"), F.col("l_partkey").alias("page")).distinct()
    return checks.neighbours(pages, "document", "page")


REGIONS_SQL = """regions AS (SELECT s_suppkey AS region, s_nationkey AS page, s_suppkey % 500 + 0.25 AS x0, (s_suppkey * 7) % 700 + 0.25 AS y0, s_suppkey % 500 + 150.25 AS x1, (s_suppkey * 7) % 700 + 200.25 AS y1 FROM supplier)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    x, y = (key % 500 + F.lit(0.25)).cast("double"), ((key * 7) % 700 + F.lit(0.25)).cast("double")
    return table(spark, sf_dir, "supplier").select(key.alias("region"), F.col("s_nationkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 150).alias("x1"), (y + 200).alias("y1"))


@query(f"""
WITH {REGIONS_SQL}, points AS (SELECT c_custkey AS point, c_nationkey AS page, c_custkey % 600 AS x, (c_custkey * 3) % 800 AS y FROM customer)
SELECT point, region FROM points p JOIN regions r ON r.page = p.page AND x BETWEEN x0 - 0.5 AND x1 + 0.5 AND y BETWEEN y0 - 0.5 AND y1 + 0.5
""")
def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(key.alias("point"), F.col("c_nationkey").alias("page"), (key % 600).cast("double").alias("x"), ((key * 3) % 800).cast("double").alias("y"))
    return checks.points_in_regions(points, regions(spark, sf_dir))


@query(f"""
WITH {REGIONS_SQL}, panels AS (SELECT c_custkey AS panel, c_nationkey AS page, c_custkey % 600 AS x0, (c_custkey * 3) % 800 AS y0, c_custkey % 600 + 100 AS x1, (c_custkey * 3) % 800 + 150 AS y1 FROM customer),
ok AS (
  SELECT panel, region, (r.x1 - r.x0) * (r.y1 - r.y0) AS area FROM panels p JOIN regions r ON r.page = p.page
  WHERE least(p.x1, r.x1) > greatest(p.x0, r.x0) AND least(p.y1, r.y1) > greatest(p.y0, r.y0)
    AND (least(p.x1, r.x1) - greatest(p.x0, r.x0)) * (least(p.y1, r.y1) - greatest(p.y0, r.y0)) >= 0.9 * (p.x1 - p.x0) * (p.y1 - p.y0)
    AND (r.x1 - r.x0) * (r.y1 - r.y0) / ((p.x1 - p.x0) * (p.y1 - p.y0)) BETWEEN 0.75 AND 5
)
SELECT panel, min(region) AS object FROM ok GROUP BY panel
""")
def covering_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    x, y = (key % 600).cast("double"), ((key * 3) % 800).cast("double")
    panels = table(spark, sf_dir, "customer").select(key.alias("panel"), F.col("c_nationkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 150).alias("y1"))
    return checks.covering(regions(spark, sf_dir).withColumnRenamed("region", "object"), panels)


@query("""
SELECT DISTINCT least(a.o_orderkey, b.o_orderkey) AS a, greatest(a.o_orderkey, b.o_orderkey) AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
WHERE a.o_orderpriority = '1-URGENT' AND abs(a.o_orderkey - b.o_orderkey) <= 1000
""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return checks.unordered_pairs(orders.where("o_orderpriority = '1-URGENT'"), orders, "o_custkey", "o_orderkey", 1000)


@query("SELECT p_partkey, p_brand, CASE p_brand WHEN 'Brand#3' THEN 0 WHEN 'Brand#1' THEN 1 ELSE 99 END AS rank FROM part")
def default_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.with_rank(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#3", "Brand#1"])


@query("SELECT n_nationkey AS index_id, CASE WHEN n_regionkey = 2 AND n_name > 'F' THEN 'fresh' ELSE 'stale' END AS status FROM nation")
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("index_id"), F.col("n_regionkey").alias("head"), (F.col("n_name") > "F").alias("pinned"))
    return checks.freshness(index, {"head": 2, "pinned": True})


@query("""
SELECT 'turn' AS kind, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS unit_id, sha256(min(CASE WHEN turn % 3 = 0 THEN '[turn without text] ' || role ELSE text END)) AS text_sha256 FROM conversations GROUP BY ALL
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), sha256(min(CASE WHEN trim(text, ' ') = '' THEN '[document without text] ' || source ELSE text END)) FROM documents GROUP BY ALL
""")
def corpus_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("unit_id"), F.col("role").alias("title"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.col("source").alias("title"), "text")
    return checks.corpus_units(turn=turns, document=docs).select("kind", "unit_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("""
WITH a AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS said FROM orders),
c AS (SELECT l_orderkey AS answer_id, l_partkey AS ref, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL)
SELECT answer_id, 'repeated' AS fault FROM c WHERE n > 1 GROUP BY answer_id UNION ALL SELECT DISTINCT answer_id, 'unresolved' FROM c JOIN part ON p_partkey = ref WHERE p_size = 9
UNION ALL SELECT o_orderkey, 'status' FROM a WHERE said <> (o_orderkey IN (SELECT answer_id FROM c))
""")
def citation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("citations"))
    status = F.when(F.col("o_orderkey") % 3 == 0, "answered").otherwise("no_answer")
    answers = table(spark, sf_dir, "orders").join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("answer_id"), status.alias("status"), "citations")
    return checks.citation_faults(answers, table(spark, sf_dir, "part").where("p_size <> 9").select(F.col("p_partkey").cast("string").alias("ref")))


@query(f"""
WITH {LINES_SQL}, t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 1 END AS n FROM documents)
SELECT l.doc_id, line_no, char_start + line_no * (n - 1) AS char_start, char_start + line_no * (n - 1) + length(line) AS char_end, sha256(line) AS line_sha256 FROM lines l JOIN t ON t.doc_id = l.doc_id
""")
def line_table_of_any_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end in CR LF, CR or LF, by document."""
    end = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\r").otherwise("\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), end).alias("text"))
    return text.line_table(docs).select("doc_id", "line_no", "char_start", "char_end", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha256"))


@query("""
WITH x AS (SELECT p_partkey, CAST(1 + p_partkey % 9 AS VARCHAR) AS a, CAST(1 + p_size % 7 AS VARCHAR) AS b FROM part), p AS (SELECT p_partkey, p_partkey AS k, a, b, length(a) AS n FROM x)
SELECT p_partkey, CAST(4 AS BIGINT) AS char_start, CAST(17 AS BIGINT) AS char_end, 'main' AS scope, a AS number, 'ab' AS panels, '' AS warning FROM p
UNION ALL SELECT p_partkey, 22, 43, 'supplement', b, '', '' FROM p
UNION ALL SELECT p_partkey, 48, 61, 'supplement', b, 'c', '' FROM p
UNION ALL SELECT p_partkey, 63, 72, 'main', unnest(['7', '8', '9']), '', '' FROM p
UNION ALL SELECT p_partkey, 74, 83, 'main', '4', 'bcd', '' FROM p
""")
def figure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of figures in sentences made from the parts' numbers."""
    a, b = (F.col("p_partkey") % 9 + 1).cast("string"), (F.col("p_size") % 7 + 1).cast("string")
    said = F.concat(F.lit("see Figure "), a, F.lit("(a,b) and Supplemental Figure "), b, F.lit(" and supp. fig. "), F.lit(""), b, F.lit("c. Figs. 7-9, fig. 4b-d"))
    return figures.figure_mentions(table(spark, sf_dir, "part").select("p_partkey", said.alias("text")), "p_partkey", "text")


@query("""
SELECT event_id, '{"a":{"b":[{"x":"é","y":' || event_id || '}],"c":"t u"},"z":null}' AS normal, '{"a":{"b":[{"x":" e' || chr(769) || ' ","y":' || event_id || '}],"c":"t u "},"z":null}' AS canonical FROM events
""")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit('{"z": null, "a": {"c": "t u ", "b": [{"y": '), F.col("event_id").cast("string"), F.lit(', "x": " é "}]}}'))
    return table(spark, sf_dir, "events").select("event_id", scalars.normalised_json(said).alias("normal"), scalars.canonical_json(said).alias("canonical"))


@query(r"""
SELECT p_partkey, '\*' || p_partkey || '\* &lt;b&gt; a &amp; b \[x\]\(y\) ' || replace(p_brand, '#', '\#') AS escaped, p_partkey || ' < "a" & b H2O' AS plain FROM part
""")
def escaped_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    raw = F.concat(F.lit(" *"), key, F.lit("*\n\t<b>  a & b [x](y) "), F.col("p_brand"), F.lit("\u0007 "))
    marked = F.concat(key, F.lit(' <b class="x">&lt;</b>\n &quot;a&quot; &amp;&nbsp;b  H<sub>2</sub>O'))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.markdown_escaped(raw).alias("escaped"), scalars.diff_normalised(marked).alias("plain"))


@query("""
WITH one AS (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS k, max(l_linenumber) AS v FROM lineitem GROUP BY ALL),
  o AS (SELECT l_orderkey, '{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}' AS object FROM one GROUP BY l_orderkey)
SELECT l_orderkey, object, sha256(object) AS digest FROM o
""")
def object_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sets.object_aggregate(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber")
    return found.withColumn("digest", F.sha2(F.col("object").cast("binary"), 256))


@query("""
WITH p AS (SELECT p_partkey, CAST(1 + p_partkey % 9 AS VARCHAR) AS a, p_partkey % 4 AS k FROM part)
SELECT p_partkey, 'main' AS scope, a AS number, 'b' AS panels, '' AS warning, false AS is_continuation FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 'supplement', a, '', '', true FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 'main', a, '', '', false FROM p WHERE k = 2 AND p_partkey % 8 = 2
""")
def caption_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with a separator, with a mark of continuation, by their type only, and prose that mentions a figure."""
    a, k = (F.col("p_partkey") % 9 + 1).cast("string"), F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("Figure "), a, F.lit("b. As in Figure 3"))).when(k == 1, F.concat(F.lit(" Fig. S"), a, F.lit(" (continued)")))
    said = said.when(k == 2, F.concat(F.lit("Figure "), a, F.lit(" shows more"))).otherwise(F.concat(F.lit("See Figure "), a, F.lit(".")))
    kind = F.when(F.col("p_partkey") % 8 == 2, "image_caption").otherwise("text")
    return figures.caption_anchors(table(spark, sf_dir, "part").select("p_partkey", said.alias("text"), kind.alias("type")), "p_partkey")


#: Line items as links of items to snapshots, orders as pages of which the finished ones are current, return flags as requests.
_LINKS = ("l_orderkey * 10 + l_linenumber", "l_returnflag", "l_orderkey")


def _links_and_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = ("link_id", "request_id", "snapshot_id")
    links = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for e, n in zip(_LINKS, names, strict=True)])
    current = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return links, current.select(F.col("o_custkey").alias("data_id"), F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("snapshot_id"))


@query("""
SELECT o_custkey AS data_id, o_orderkey AS page_id, string_agg(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), ',' ORDER BY l_orderkey * 10 + l_linenumber) AS links
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R' GROUP BY ALL
""")
def refresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.refresh_targets(*_links_and_pages(spark, sf_dir), "R")
    return found.select("data_id", "page_id", F.concat_ws(",", F.col("links").cast("array<string>")).alias("links"))


@query("""
SELECT l_orderkey * 10 + l_linenumber AS link_id, l_returnflag AS request_id, l_orderkey AS snapshot_id FROM lineitem
WHERE l_returnflag <> 'R' OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""")
def historical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.historical_links(*_links_and_pages(spark, sf_dir), "R")
