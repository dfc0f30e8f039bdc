"""Relations judged by event logs: the latest event wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """The values of each key's last event, by a partial maximum in each task."""
    return events.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("e")).select(*keys, *[F.col(f"e.{c}").alias(c) for c in (order, *values)])


def edge_status(edges: DataFrame, events: DataFrame, fences: DataFrame, usable: DataFrame) -> DataFrame:
    """edge_id and status; the first that holds: historical, endpoint_unusable, pending, applicable or inapplicable.

    edges: edge_id, src, dst, current, original (whether the endpoints are those it was made for);
    events: edge_id, event_order, applicable; fences: edge_id, fence_order; usable: node.
    Unknown is never reported as a refusal: no event leaves the original pair applicable and any other pending.
    """
    last = latest(events, ["edge_id"], "event_order", "applicable")
    fence = fences.groupBy("edge_id").agg(F.max("fence_order").alias("fence_order"))
    ok = usable.select("node").distinct()
    ends = edges.join(ok.select(F.col("node").alias("src"), F.lit(True).alias("src_ok")), "src", "left").join(ok.select(F.col("node").alias("dst"), F.lit(True).alias("dst_ok")), "dst", "left")
    seen = ends.join(last, "edge_id", "left").join(fence, "edge_id", "left")
    status = (
        F.when(~F.col("current"), "historical")
        .when(F.col("src_ok").isNull() | F.col("dst_ok").isNull(), "endpoint_unusable")
        .when(F.coalesce("fence_order", F.lit(-1)) > F.coalesce("event_order", F.lit(-1)), "pending")
        .when(F.col("event_order").isNull(), F.when(F.col("original"), "applicable").otherwise("pending"))
        .when(F.col("applicable").isNull(), "pending").when(F.col("applicable"), "applicable").otherwise("inapplicable")
    )
    return seen.select("edge_id", "src", "dst", status.alias("status"))


def contested(statuses: DataFrame, predicates: DataFrame) -> DataFrame:
    """Nodes at either end of an applicable edge that contradicts. predicates: edge_id, predicate."""
    hit = statuses.where("status = 'applicable'").join(predicates.where("predicate = 'contradicts'"), "edge_id", "left_semi")
    return hit.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def impacts(nodes: DataFrame, **routes: DataFrame) -> DataFrame:
    """node, route, ref: everything that refers to the nodes (column node). Each route has columns node, ref."""
    out = None
    for name, refs in sorted(routes.items()):
        hit = refs.join(nodes.select("node").distinct(), "node", "left_semi").select("node", F.lit(name).alias("route"), "ref")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def refresh_targets(links: DataFrame, pages: DataFrame, import_id: str) -> DataFrame:
    """Current pages that impacted links touch, with their links in order.

    links: link_id, request_id, snapshot_id; pages: data_id, page_id, snapshot_id, those that are current. A link counts if it
    was made for import_id and its snapshot is a current page's; any other is in historical_links.
    """
    hit = links.where(F.col("request_id") == import_id).join(pages, "snapshot_id")
    return hit.groupBy("data_id", "page_id", "snapshot_id").agg(F.sort_array(F.collect_list("link_id")).alias("links"))


def historical_links(links: DataFrame, pages: DataFrame, import_id: str) -> DataFrame:
    """The links that refresh_targets leaves aside; links without a request or snapshot are among them."""
    now = pages.select("snapshot_id").distinct().withColumn("is_current", F.lit(True))
    seen = links.join(now, "snapshot_id", "left")
    return seen.where(~(F.col("request_id").eqNullSafe(import_id) & F.col("is_current").eqNullSafe(True))).select(links.columns)
