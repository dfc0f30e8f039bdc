"""The read path over nodes, edges and the derivations that support them. Latest events win; unknown is never a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import graph
from loomspark.operators.relations import contested, latest
from loomspark.sources.workspace import written

#: Predicates whose target has to be a proposition.
PROPOSITION_TARGETS = ("supports", "qualifies")


def current_nodes(nodes: DataFrame, revisions: DataFrame, groundings: DataFrame) -> DataFrame:
    """node, kind, revision, statement and the sorted distinct data_ids of the current revision (empty without groundings).

    nodes: node, kind, current_revision; revisions: revision, statement; groundings: revision, data_id.
    """
    data = groundings.groupBy("revision").agg(F.array_sort(F.collect_set("data_id")).alias("data_ids"))
    held = nodes.withColumnRenamed("current_revision", "revision").join(revisions.select("revision", "statement"), "revision").join(data, "revision", "left")
    none = F.array().cast(data.schema["data_ids"].dataType)
    return held.select("node", "kind", "revision", "statement", F.coalesce("data_ids", none).alias("data_ids"))


def current_edges(edges: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each edge with its current revision's columns. edges: edge_id, predicate, current_revision; revisions: revision (of one edge, once), src, dst."""
    return edges.withColumnRenamed("current_revision", "revision").join(revisions.select("revision", "src", "dst"), "revision").select("edge_id", "predicate", "revision", "src", "dst")


def support_records(origins: DataFrame, supports: DataFrame) -> DataFrame:
    """node, record, from_event: the last event's record, else the one the node came from. origins: node, record; supports: node, event_order, record."""
    last = latest(supports, ["node"], "event_order", "record").select("node", F.col("record").alias("later"))
    return origins.join(last, "node", "left").select("node", F.coalesce("later", "record").alias("record"), F.col("later").isNotNull().alias("from_event"))


def premise_currency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, is_current: whether every node it derives from is usable and each support consumed on the way is still the current one.

    nodes: node, usable; edges: src, dst, consumed (the record of dst that src consumed), record (the one it has now).
    What is wrong is followed backwards, so that a round holds nodes and not pairs.
    """
    changed = edges.where(~F.col("consumed").eqNullSafe(F.col("record"))).select(F.col("src").alias("node"))
    unusable = nodes.where(~F.coalesce("usable", F.lit(False))).select("node")
    direct = edges.join(unusable, edges["dst"] == unusable["node"], "left_semi").select(F.col("src").alias("node"))
    hit = written(changed.unionByName(direct).distinct(), "hit")
    bad = hit.unionByName(graph.reaching(edges, hit)).distinct().withColumn("bad", F.lit(True))
    return nodes.select("node").distinct().join(bad, "node", "left").select("node", F.col("bad").isNull().alias("is_current"))


def routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, route: 'cycle' if its premises reach a cycle, else 'stale' if they aren't current, else 'active'; columns as in premise_currency()."""
    state = premise_currency(nodes, edges)
    loops = graph.unresolved(edges).withColumn("loops", F.lit(True))
    return state.join(loops, "node", "left").select("node", F.when(F.col("loops"), "cycle").when(F.col("is_current"), "active").otherwise("stale").alias("route"))


def provenance(nodes: DataFrame, edges: DataFrame, groundings: DataFrame) -> DataFrame:
    """node, origin, depth, premises, direct_data, all_data.

    origin: 'grounded', 'derived', 'both' or 'none' by what a node rests on itself; all_data counts distinct data_ids of it and all it derives from.
    """
    own = groundings.select("node", "data_id").distinct()
    direct = own.groupBy("node").agg(F.count(F.lit(1)).alias("direct_data"))
    every = graph.lineage(edges, own).groupBy("node").agg(F.count(F.lit(1)).alias("all_data"))
    premises = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("premises"))
    depth = graph.depths(edges).withColumn("known", F.lit(True))
    found = nodes.select("node").join(direct, "node", "left").join(every, "node", "left").join(premises, "node", "left").join(depth, "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    by = F.when(F.col("direct_data").isNotNull() & F.col("premises").isNotNull(), "both").when(F.col("direct_data").isNotNull(), "grounded").when(F.col("premises").isNotNull(), "derived").otherwise("none")
    depth = F.when(F.col("known"), F.col("depth")).otherwise(F.lit(0).cast("long"))
    return found.select("node", by.alias("origin"), depth.alias("depth"), zero("premises").alias("premises"), zero("direct_data").alias("direct_data"), zero("all_data").alias("all_data"))


def input_currency(bound: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, is_current and the names of the bound columns that differ from what holds now (null equals null; all of them if the key is gone)."""
    there = now.select(key, *[F.col(c).alias(f"{c}_now") for c in columns], F.lit(True).alias("there"))
    seen = bound.select(key, *columns).join(there, key, "left")
    same = [F.coalesce(F.col("there"), F.lit(False)) & F.col(c).eqNullSafe(F.col(f"{c}_now")) for c in columns]
    differs = F.filter(F.array(*[F.when(~s, F.lit(c)) for s, c in zip(same, columns, strict=True)]), lambda x: x.isNotNull())
    return seen.select(key, (F.size(differs) == 0).alias("is_current"), F.array_join(differs, ",").alias("differs"))


def graph_query(nodes: DataFrame, statuses: DataFrame, predicates: DataFrame, wanted: Column) -> DataFrame:
    """Nodes that are wanted, with contested, edges_in and edges_out. Contested is told on the whole graph, before any filter; edges count if both ends are wanted."""
    marks = contested(statuses, predicates).withColumn("contested", F.lit(True))
    kept = written(nodes.where(wanted).select("node", "kind"), "kept")
    ends = statuses.where("status = 'applicable'").join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    out = ends.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("edges_out"))
    into = ends.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("edges_in"))
    found = kept.join(marks, "node", "left").join(out, "node", "left").join(into, "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select("node", "kind", F.coalesce("contested", F.lit(False)).alias("contested"), zero("edges_out").alias("edges_out"), zero("edges_in").alias("edges_in"))


def edge_consumers(consumptions: DataFrame, supports: DataFrame) -> DataFrame:
    """edge_id, record, node of the derivations that consumed an edge and still support their result. consumptions: edge_id, record, node; supports: node, record."""
    return consumptions.join(supports.select("node", "record"), ["node", "record"], "left_semi").select("edge_id", "record", "node")


def edges_among(edges: DataFrame, nodes: DataFrame, usable: DataFrame, required: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes that are usable, and all required ones, available or not. usable, required: edge_id.

    Both flags are told by edge_id, with a row for each edge of that id; a required id without an edge has a row, too.
    """
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    known = inside.join(usable.select("edge_id"), "edge_id", "left_semi").select("edge_id", F.lit(True).alias("ok")).distinct()
    asked = required.select("edge_id", F.lit(True).alias("asked")).distinct()
    flag = lambda c: F.coalesce(c, F.lit(False))
    told = known.join(asked, "edge_id", "full").select("edge_id", flag("ok").alias("available"), flag("asked").alias("required"))
    return edges.select("edge_id").join(told, "edge_id", "right")


def with_premises(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """node, selected: the chosen nodes and all that support them."""
    chosen = selected.select("node").distinct()
    below = graph.closure(edges, chosen.select(F.col("node").alias("src"))).select(F.col("dst").alias("node")).distinct()
    return chosen.withColumn("selected", F.lit(True)).unionByName(below.join(chosen, "node", "left_anti").withColumn("selected", F.lit(False)))


def related_links(links: DataFrame, items: DataFrame, current: DataFrame) -> DataFrame:
    """Links (item, node, revision, state) of items now on a page, but those held for review, with is_current of the revision linked. current: node, revision."""
    kept = links.where("state <> 'review_required'").join(items.select("item").distinct(), "item", "left_semi")
    now = current.select("node", F.col("revision").alias("now"))
    return kept.join(now, "node", "left").select("item", "node", "revision", F.col("revision").eqNullSafe(F.col("now")).alias("is_current"))


def derivation_faults(declared: DataFrame, stored: DataFrame, depth: DataFrame) -> DataFrame:
    """record, fault of derivations that don't hold: premises missing or added, or a depth that isn't one more than the deepest premise's.

    declared: record, premises (array), depth; stored: record, premise; depth: node, depth.
    """
    said = declared.select("record", F.explode("premises").alias("premise")).distinct()
    there = stored.select("record", "premise").distinct()
    missing = said.join(there, ["record", "premise"], "left_anti").select("record", F.lit("premise_missing").alias("fault"))
    added = there.join(said, ["record", "premise"], "left_anti").select("record", F.lit("premise_added").alias("fault"))
    deepest = there.join(depth.select(F.col("node").alias("premise"), F.col("depth").alias("d")), "premise", "left").groupBy("record").agg((F.max("d") + 1).alias("d"))
    wrong = declared.join(deepest, "record", "left").where(~F.col("depth").eqNullSafe(F.coalesce("d", F.lit(0)))).select("record", F.lit("wrong_depth").alias("fault"))
    return missing.unionByName(added).unionByName(wrong).distinct()


def endpoint_faults(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """edge_id of edges whose predicate asks for a proposition at its target and has none. edges: edge_id, predicate, dst; kinds: node, kind."""
    asked = edges.where(F.col("predicate").isin(*PROPOSITION_TARGETS))
    return asked.join(kinds.where("kind = 'proposition'").select(F.col("node").alias("dst")), "dst", "left_anti").select("edge_id", "predicate")


def chain_faults(versions: DataFrame, series: list[str]) -> DataFrame:
    """series, version_number of versions that break their chain: the parent isn't the version before, or a number is left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(*series).orderBy("version_number")
    seen = versions.withColumn("before", F.lag("version_id").over(w)).withColumn("n", F.lag("version_number").over(w))
    ok = F.col("parent").eqNullSafe(F.col("before")) & (F.col("version_number") == F.coalesce("n", F.lit(0)) + 1)
    return seen.where(~ok).select(*series, "version_number")


def version_support(supports: DataFrame, members: DataFrame, heads: DataFrame) -> DataFrame:
    """revision, versions (sorted), on_head: the versions whose data supports each revision, and whether a head is among them.

    supports: revision, data_id; members: version_id, data_id; heads: version_id.
    """
    at = supports.join(members, "data_id").join(heads.select("version_id", F.lit(True).alias("head")), "version_id", "left")
    return at.groupBy("revision").agg(F.array_join(F.array_sort(F.collect_set("version_id")).cast("array<string>"), ",").alias("versions"), F.bool_or(F.coalesce("head", F.lit(False))).alias("on_head"))


def frozen_versions(members: DataFrame, heads: DataFrame, data: DataFrame) -> DataFrame:
    """series, data_id, version_id, is_head of the memberships of a set of data, as they stand now."""
    kept = members.join(data.select("data_id").distinct(), "data_id", "left_semi")
    return kept.join(heads.select("version_id", F.lit(True).alias("head")), "version_id", "left").select("series", "data_id", "version_id", F.coalesce("head", F.lit(False)).alias("is_head"))


def merged_media(media: DataFrame) -> DataFrame:
    """sha256, packets, conflict: media of several packets as one, or as a conflict where their type or size differs."""
    return media.groupBy("sha256").agg(F.count_distinct("packet").alias("packets"), (F.count_distinct("media_type", "byte_size") > 1).alias("conflict"))


def regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """commit_id of the old catalogue that the new one lacks, or has at a lower version. Both: commit_id, version."""
    there = new.select("commit_id", F.col("version").alias("now"))
    return old.join(there, "commit_id", "left").where("now is null or now < version").select("commit_id", F.when(F.col("now").isNull(), "missing").otherwise("older").alias("fault"))
