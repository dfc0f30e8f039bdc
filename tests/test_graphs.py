"""Graphs with cycles, empty tables and nulls."""

import random

from loomspark.functions import figures, scalars
from loomspark.operators import checks, graph, knowledge, transitions
from pyspark.sql import functions as F

EDGES = "src long, dst long"


def test_depths_end_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 5), (7, 6), (8, 8)], EDGES)
    assert dict(map(tuple, graph.depths(edges).collect())) == {1: None, 2: None, 3: None, 4: None, 5: 1, 6: 0, 7: 2, 8: None}
    assert {r["node"] for r in graph.unresolved(edges).collect()} == {1, 2, 3, 4, 8}
    assert {r["node"] for r in graph.cycle_nodes(edges).collect()} == {1, 2, 3, 8}
    none = spark.createDataFrame([], EDGES)
    assert graph.depths(none).collect() == graph.cycle_nodes(none).collect() == []


def test_reaching_against_brute_force(spark):
    r = random.Random(4)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(60)]
    targets = [1, 7, 30]
    want = set()
    front = set(targets)
    while front:
        front = {a for a, b in pairs if b in front} - want
        want |= front
    got = graph.reaching(spark.createDataFrame(pairs, EDGES), spark.createDataFrame([(t,) for t in targets], "node long"))
    assert {x["node"] for x in got.collect()} == want


def test_currency_and_routes(spark):
    nodes = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, None), (6, True)], "node long, usable boolean")
    edges = spark.createDataFrame([(1, 2, "a", "a"), (3, 1, "a", "a"), (4, 6, "a", "b"), (6, 6, None, None)], EDGES + ", consumed string, record string")
    assert dict(map(tuple, knowledge.premise_currency(nodes, edges).collect())) == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True}
    assert dict(map(tuple, knowledge.routes(nodes, edges).collect())) == {1: "stale", 2: "active", 3: "stale", 4: "cycle", 5: "active", 6: "cycle"}


def test_fence_of_tokens_and_epochs(spark):
    log = [(1, 1, "claim", 7, 0), (1, 2, "finish", 8, 0), (2, 1, "claim", 7, 0), (2, 2, "finish", 7, 1), (3, 1, "finish", 7, 0), (4, 1, "claim", 7, 0), (4, 2, "block", 7, 0)]
    got = transitions.states(spark.createDataFrame(log, "task long, seq long, kind string, token long, epoch long"))
    assert dict(map(tuple, got.collect())) == {1: "leased", 2: "leased", 3: "pending", 4: "blocked"}


def test_coverage_of_nothing_and_twice(spark):
    wanted = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "key string, n long")
    given = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("c", 0)], "key string, page long")
    assert sorted(map(tuple, checks.coverage(wanted, given, "key", "page").collect())) == [("a", 0, "repeated"), ("a", 1, "missing"), ("b", 0, "beyond")]


def test_figure_panels_and_supplements():
    said = lambda t: [(s, n, p, w) for _, _, s, n, p, w in figures.mentions(t)]
    assert said("Figure 1(a,b)") == [("main", "1", "ab", "")] and said("Fig. 2 (c-e)") == [("main", "2", "cde", "")]
    assert said("Supplemental Figure 2") == said("supp. fig. 2") == said("Supplementary Figs. 2") == [("supplement", "2", "", "")]
    assert said("Fig. 2(e-c)") == [("main", "2", "ec", "panel_range_not_expanded")]
    assert said("configure 3") == said("") == []


def test_json_that_is_none(spark):
    df = spark.createDataFrame([('{"b":1,"a":[" é "]}',), ("x",), (None,), ("[" * 100000,)], "j string")
    assert [r[0] for r in df.select(scalars.normalised_json(F.col("j"))).collect()] == ['{"a":["é"],"b":1}', None, None, None]
