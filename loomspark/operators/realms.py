"""Named collections of sources, their revisions and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revisions(changes: DataFrame) -> DataFrame:
    """realm, revision, valid_from, valid_to, members of each state of a realm from changes (realm, at, members as array): equal successive states are one."""
    w = Window.partitionBy("realm").orderBy("at")
    state = changes.select("realm", "at", F.array_sort(F.array_distinct("members")).alias("members")).withColumn("before", F.lag("members").over(w))
    kept = state.where(F.col("before").isNull() | (F.col("before") != F.col("members")))
    return kept.select("realm", F.row_number().over(w).alias("revision"), F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"), "members")


def common_realms(members: DataFrame, sources: DataFrame) -> DataFrame:
    """realm of those that hold every source. members: realm, data_id; sources: data_id."""
    want = sources.select("data_id").distinct()
    need = want.agg(F.count(F.lit(1)).alias("need"))
    have = members.select("realm", "data_id").distinct().join(want, "data_id", "left_semi").groupBy("realm").agg(F.count(F.lit(1)).alias("have"))
    return have.join(F.broadcast(need), F.col("have") == F.col("need")).select("realm")


def default_realm(common: DataFrame, registered: DataFrame) -> DataFrame:
    """One row: the only common realm, or of several the only registered one, else null with why."""
    marked = common.join(registered.select("realm", F.lit(1).alias("r")).distinct(), "realm", "left")
    n = marked.agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("k"), F.min("realm").alias("one"), F.min(F.when(F.col("r") == 1, F.col("realm"))).alias("reg"))
    return n.select(F.when(F.col("n") == 1, F.col("one")).when(F.col("k") == 1, F.col("reg")).alias("realm"), F.when(F.col("n") == 0, "none").when((F.col("n") > 1) & (F.col("k") != 1), "ambiguous").otherwise("resolved").alias("state"))


def outside_scope(used: DataFrame, members: DataFrame, realm: str) -> DataFrame:
    """data_id of what is used but neither a member nor in a member series. used: data_id, series; members: realm, data_id, series."""
    own = members.where(F.col("realm") == realm)
    by_data = used.join(own.where("data_id is not null").select("data_id"), "data_id", "left_anti")
    return by_data.join(own.where("series is not null").select("series"), "series", "left_anti").select("data_id").distinct()


def disclosed(nodes: DataFrame, sources: DataFrame, owners: DataFrame) -> DataFrame:
    """Nodes all of whose sources (node, data_id) belong to owners (data_id); a node without sources isn't disclosed."""
    foreign = sources.join(owners.select("data_id"), "data_id", "left_anti").select("node")
    return nodes.select("node").join(sources.select("node"), "node", "left_semi").join(foreign, "node", "left_anti").distinct()


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    """page, snapshot, age: each page's snapshots (page, snapshot, previous, ord) newest first; broken tells where `previous` isn't the one before."""
    w = Window.partitionBy("page").orderBy("ord")
    before = F.lag("snapshot").over(w)
    age = F.row_number().over(Window.partitionBy("page").orderBy(F.col("ord").desc())) - 1
    return snapshots.select("page", "snapshot", age.alias("age"), (~before.eqNullSafe(F.col("previous"))).alias("broken"))
