"""Responses of outside reviewers as tables: completed, checked and merged by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.workspace import written

#: Dispositions of a unit, the strongest first.
DISPOSITIONS = ["needs_review", "selected", "context_only", "not_selected"]


def merged_dispositions(reviews: DataFrame, citations: DataFrame) -> DataFrame:
    """unit_id, disposition, reasons over all batches. reviews: unit_id, batch, disposition, reason; citations: unit_id.

    A review that needs one decides; else a unit that a candidate cites is selected; else context counts before none.
    Reasons are distinct, in the order of batches.
    """
    rank = F.when(F.col("disposition") == "needs_review", 0).when(F.col("disposition") == "context_only", 2).otherwise(3)
    first = reviews.groupBy("unit_id", "reason").agg(F.min("batch").alias("batch"))
    reasons = first.where("reason is not null").groupBy("unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))
    cited = citations.select("unit_id", F.lit(1).alias("cited")).distinct()
    least = reviews.groupBy("unit_id").agg(F.min(rank).alias("r")).join(cited, "unit_id", "left").join(reasons, "unit_id", "left")
    place = F.when(F.col("r") == 0, 0).when(F.col("cited") == 1, 1).otherwise(F.col("r"))
    return least.select("unit_id", F.element_at(F.array(*map(F.lit, DISPOSITIONS)), place + 1).alias("disposition"), "reasons")


def selection_faults(units: DataFrame, reviews: DataFrame, keys: DataFrame, citations: DataFrame) -> DataFrame:
    """unit_id, fault. units: unit_id; reviews: unit_id, disposition; keys and citations: unit_id, candidate (declared, and citing).

    Every unit has one review; context and unselected units declare and have no candidates; a declared candidate cites
    the unit; a selected unit is cited.
    """
    n = reviews.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("disposition").alias("disposition"))
    per = units.join(n, "unit_id", "left")
    declared, citing = keys.select("unit_id", "candidate").distinct(), citations.select("unit_id", "candidate").distinct()
    both = per.join(declared.groupBy("unit_id").agg(F.count(F.lit(1)).alias("declared")), "unit_id", "left").join(citing.groupBy("unit_id").agg(F.count(F.lit(1)).alias("citing")), "unit_id", "left")
    passive = F.col("disposition").isin("context_only", "not_selected")
    fault = (
        F.when(F.col("n").isNull(), "unreviewed").when(F.col("n") > 1, "reviewed_twice").when(passive & F.col("declared").isNotNull(), "declares_candidates")
        .when(passive & F.col("citing").isNotNull(), "cited_but_not_selected").when((F.col("disposition") == "selected") & F.col("citing").isNull(), "selected_without_citation")
    )
    loose = declared.join(citing, ["unit_id", "candidate"], "left_anti").select("unit_id", F.lit("declared_without_citation").alias("fault"))
    unknown = reviews.join(units, "unit_id", "left_anti").select("unit_id", F.lit("unknown_unit").alias("fault"))
    return both.select("unit_id", fault.alias("fault")).where("fault is not null").unionByName(loose.distinct()).unionByName(unknown.distinct())


def completed_keys(reviews: DataFrame, keys: DataFrame, citations: DataFrame) -> DataFrame:
    """unit_id, candidate, added: the candidates that cite each selected unit replace those declared; added tells which are new."""
    chosen = reviews.where("disposition = 'selected'").select("unit_id").distinct()
    declared = keys.select("unit_id", "candidate", F.lit(False).alias("added")).distinct()
    return citations.select("unit_id", "candidate").distinct().join(chosen, "unit_id", "left_semi").join(declared, ["unit_id", "candidate"], "left").select("unit_id", "candidate", F.coalesce("added", F.lit(True)).alias("added"))


def reuse_roots(links: DataFrame) -> DataFrame:
    """key, root of keys that point to an equivalent one (key, target; each key once): the end of its way, or the least key of the cycle it runs into.

    Pointers are doubled. After k rounds a pointer is 2^k steps long, so once it is as long as there are keys, a way that
    hasn't ended goes round its cycle, and the least key seen on as many steps from there is the cycle's.
    """
    links = written(links.select("key", "target"), "links")
    rounds = max(1, links.count().bit_length())

    def doubled(now: DataFrame) -> DataFrame:
        step = now.select(F.col("key").alias("target"), F.col("target").alias("next"), F.col("least").alias("next_least"))
        return written(now.join(step, "target", "left").select("key", F.coalesce("next", "target").alias("target"), F.least("least", "next_least").alias("least")), "jumps")

    now = links.withColumn("least", F.col("target"))
    for _ in range(rounds):
        now = doubled(now)
    ends = now.join(links.select(F.col("key").alias("target")), "target", "left_anti").select("key", F.col("target").alias("root"))
    # where a long way leads lies on a cycle; its own long way sees all of the cycle
    on_cycle = now.select(F.col("key").alias("target"), F.col("least").alias("root"))
    return ends.unionByName(now.join(on_cycle, "target").select("key", "root"))


def materiality(reviews: DataFrame) -> DataFrame:
    """target_id, decision from identity_confirmed, grounding_valid, material_change (may be unknown) and content_changed."""
    human = ~F.col("identity_confirmed") | ~F.col("grounding_valid") | F.col("material_change").isNull() | (F.col("material_change") & ~F.col("content_changed"))
    return reviews.select("target_id", F.when(human, "needs_human").when(F.col("material_change"), "accepted_revision").otherwise("reused").alias("decision"))


def proposal_faults(proposals: DataFrame, premises: DataFrame, inputs: DataFrame) -> DataFrame:
    """proposal_id, fault. proposals: proposal_id, kind; premises: proposal_id, node; inputs: node.

    A result is a proposition and has two or more distinct premises, all of them inputs.
    """
    n = premises.groupBy("proposal_id").agg(F.count_distinct("node").alias("distinct"), F.count(F.lit(1)).alias("n"))
    strange = premises.join(inputs, "node", "left_anti").select("proposal_id", F.lit(1).alias("strange")).distinct()
    per = proposals.join(n, "proposal_id", "left").join(strange, "proposal_id", "left")
    fault = (
        F.when(F.col("kind") != "proposition", "result_is_no_proposition").when(F.coalesce("distinct", F.lit(0)) < 2, "too_few_premises")
        .when(F.col("n") > F.col("distinct"), "premise_repeated").when(F.col("strange") == 1, "premise_is_no_input")
    )
    return per.select("proposal_id", fault.alias("fault")).where("fault is not null")


def reuse_by_fingerprint(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """candidate, decision, node. candidates and current (with node) have kind, identity, content and scope.

    The identity decides first; then a unique current node of the same content and scope; several need a person.
    """
    same = current.groupBy("kind", "identity").agg(F.min("node").alias("by_identity"), F.min("content").alias("old"))
    alike = current.where("scope is not null").groupBy("kind", "content", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("by_content"))
    both = candidates.join(same, ["kind", "identity"], "left").join(alike, ["kind", "content", "scope"], "left")
    decision = (
        F.when(F.col("by_identity").isNotNull(), F.when(F.col("old") == F.col("content"), "reused").otherwise("conflict"))
        .when(F.col("n") > 1, "needs_human").when(F.col("n") == 1, "reused").otherwise("accepted_new")
    )
    node = F.coalesce("by_identity", F.when(F.col("n") == 1, F.col("by_content")))
    return both.select("candidate", decision.alias("decision"), F.when(decision == "reused", node).alias("node"))


def compositions(members: DataFrame) -> DataFrame:
    """parchment, parts, digest: members (parchment, ord, part) in order, named by the digest of their order."""
    rows = members.groupBy("parchment").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("part").cast("string").alias("part")))), lambda x: x["part"]).alias("p"))
    return rows.select("parchment", F.array_join("p", ",").alias("parts"), F.sha2(F.array_join("p", ",").cast("binary"), 256).alias("digest"))


def matrix_gaps(options: DataFrame, criteria: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs (option, criterion) that a comparison lacks; options and criteria are the few of one comparison each (key)."""
    return options.join(criteria, "key").join(cells, ["key", "option", "criterion"], "left_anti").select("key", "option", "criterion")
