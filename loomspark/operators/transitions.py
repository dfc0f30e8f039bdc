"""Changes of a durable worklist, as folds over its event tables. Time and epochs are columns or parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.workspace import written

#: Fixed value: failures of transport in a row after which a task is blocked.
TRANSPORT_LIMIT = 3


def task_key(kind: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, payload).cast("binary"), 256)


def enqueue(existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tasks: task_key, kind, payload; causes: task_key, cause). Requests (kind, payload, cause) of one key are one task with all their causes."""
    keyed = requests.withColumn("task_key", task_key(F.col("kind"), F.col("payload")))
    new = keyed.select("task_key", "kind", "payload").distinct().join(existing.select("task_key"), "task_key", "left_anti")
    return new, keyed.select("task_key", "cause").distinct()


def fenced(events: DataFrame) -> DataFrame:
    """Events (task, seq, kind, token, epoch) with valid: a claim always is; any other only under the token of the last claim before it, in its epoch.

    Work that is paused, resumed or cancelled has a new epoch, which makes earlier leases void.
    """
    w = Window.partitionBy("task").orderBy("seq")
    held = F.last(F.when(F.col("kind") == "claim", F.struct("token", "epoch")), ignorenulls=True).over(w)
    valid = (F.col("kind") == "claim") | F.coalesce(held == F.struct("token", "epoch"), F.lit(False))
    return events.select("task", "seq", "kind", "token", "epoch", valid.alias("valid"))


def states(events: DataFrame) -> DataFrame:
    """task, state after the last valid event; 'pending' if there is none. renew leaves a task leased."""
    after = {"claim": "leased", "renew": "leased", "finish": "done", "block": "blocked", "await": "awaiting_model", "retry": "retry"}
    said = F.create_map(*[F.lit(x) for kv in after.items() for x in kv])
    best = fenced(events).groupBy("task").agg(F.max(F.when(F.col("valid"), F.struct("seq", "kind"))).alias("e"))
    return best.select("task", F.coalesce(said[F.col("e.kind")], F.lit("pending")).alias("state"))


def expanded(impacted: DataFrame, edges: DataFrame, consumers: DataFrame, limit: int) -> DataFrame:
    """kind, ref, cause: one level of work behind the impacted nodes (node).

    Nodes that derive from them are revalidated, edges at either end are, results that consumed such an edge are, and each
    impacted node is paired for discovery with the limit least other nodes it shares an edge with.
    """
    hit = impacted.select("node").distinct()
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node"), "src", "dst")
    touched = ends.join(hit, "node", "left_semi")
    dependents = edges.join(hit, edges["dst"] == hit["node"]).select(F.lit("node_revalidate").alias("kind"), F.col("src").cast("string").alias("ref"), F.col("dst").alias("cause"))
    revalidate = touched.select(F.lit("edge_revalidate").alias("kind"), F.col("edge_id").cast("string").alias("ref"), F.col("node").alias("cause"))
    used = touched.join(consumers, "edge_id").select(F.lit("support_refresh").alias("kind"), F.col("record").cast("string").alias("ref"), touched["node"].alias("cause"))
    other = touched.select("node", F.when(F.col("src") == F.col("node"), F.col("dst")).otherwise(F.col("src")).alias("other")).where("node <> other").distinct()
    w = Window.partitionBy("node").orderBy("other")
    pairs = other.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    pairs = pairs.select(F.lit("discovery").alias("kind"), F.concat_ws("-", F.least("node", "other").cast("string"), F.greatest("node", "other").cast("string")).alias("ref"), F.col("node").alias("cause"))
    return dependents.unionByName(revalidate).unionByName(used).unionByName(pairs).distinct()


def past_barrier(tasks: DataFrame, late: Column) -> DataFrame:
    """Open tasks that may run: all but late ones of a run that has other unfinished work."""
    open_ = tasks.where(~F.col("state").isin("done", "cancelled"))
    held = open_.where(~late).select("run").distinct().withColumn("held", F.lit(True))
    return open_.join(held, "run", "left").where(~late | F.col("held").isNull()).select(tasks.columns)


def released(blocked: DataFrame, needs: DataFrame, current: DataFrame) -> DataFrame:
    """Blocked tasks all of whose premises are current: task. needs: task, node; current: node, is_current."""
    open_ = needs.join(current, "node", "left").where(~F.coalesce("is_current", F.lit(False))).select("task").distinct()
    return blocked.select("task").join(open_, "task", "left_anti")


def transport_retries(events: DataFrame, who: str, order: str, failed: Column, reset: Column) -> DataFrame:
    """who, streak, state: failures of transport at the end of each log since the last other event that resets; 'blocked' at TRANSPORT_LIMIT."""
    last = events.groupBy(who).agg(F.max(F.when(reset, F.col(order))).alias("ok"))
    n = events.join(last, who).where(failed & (F.col("ok").isNull() | (F.col(order) > F.col("ok")))).groupBy(who).agg(F.count(F.lit(1)).alias("n"))
    streak = F.coalesce("n", F.lit(0)).cast("long")
    return last.join(n, who, "left").select(who, streak.alias("streak"), F.when(streak >= TRANSPORT_LIMIT, "blocked").when(streak > 0, "retry").otherwise("ready").alias("state"))


def refresh_targets(impacted: DataFrame, links: DataFrame, current: DataFrame) -> DataFrame:
    """source, pages, history: for each source the current pages that link impacted nodes, and how many links are of past pages. links: node, page, source; current: page."""
    hit = links.join(impacted.select("node").distinct(), "node", "left_semi").join(current.select("page", F.lit(True).alias("now")), "page", "left")
    return hit.groupBy("source").agg(F.count_distinct(F.when(F.col("now"), F.col("page"))).alias("pages"), F.count_if(F.col("now").isNull()).alias("history"))


def commit_numbers(commits: DataFrame, order: list[str]) -> DataFrame:
    """Commits with version, 1 and on in their order, none left out: numbers within ranges of the order, then what lies before each range."""
    ranged = commits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    held = written(ranged, "commits")
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")  # one row a partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return held.withColumn("within", within).join(F.broadcast(before), "part").select(*commits.columns, (F.col("within") + F.col("before")).cast("long").alias("version"))
