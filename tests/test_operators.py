"""Operators on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomspark.functions import digests, text
from loomspark.operators import graph, quotes, relations, retrieval, sets, spans, versions, worklist


def made(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lines_and_windows(spark):
    docs = made(spark, [(1, "é\n\nab"), (2, ""), (3, None), (4, "x" * 1025)], "doc_id long, text string")
    assert got(text.line_table(docs).where("doc_id < 4")) == [(1, 0, 0, 1, 0, "é"), (1, 1, 2, 2, 3, ""), (1, 2, 3, 5, 4, "ab"), (2, 0, 0, 0, 0, "")]
    assert [r[1:4] for r in got(text.char_windows(docs)) if r[0] == 4] == [(0, 0, 512), (1, 448, 960), (2, 896, 1025)]
    assert not [r for r in got(text.char_windows(docs)) if r[0] in (2, 3)]


def test_text_functions(spark):
    df = made(spark, [("é", " a\r\nb\rc "), (None, None)], "a string, b string")
    assert got(df.select(text.nfc("a"), text.folded(F.col("b")))) == [("é", "a\nb\nc"), (None, None)]
    assert got(df.limit(1).select(text.sequence_ratio(F.lit("abcd"), F.lit("bcde")))) == [(0.75,)]


def test_digests(spark):
    import hashlib
    import json

    [(j, d)] = got(spark.range(1).select(digests.canonical_json(b=F.lit("é\"\n"), a=F.lit(1), c=F.lit(None).cast("string")), digests.fingerprint("x", 2, k=F.lit("v"))))
    assert j == json.dumps({"a": 1, "b": "é\"\n", "c": None}, ensure_ascii=False, separators=(",", ":"))
    assert d == hashlib.sha256(b'{"domain":"x","schema":2,"value":{"k":"v"}}').hexdigest()


def test_quotes(spark):
    docs = made(spark, [(1, "aaa b"), (2, "A μm café. end"), (3, None), (4, "")], "doc_id long, text string")
    items = made(spark, [(1, "aa"), (2, "μm café."), (3, ""), (4, None), (5, "b"), (6, "μm café.")], "item_id long, text string")
    assert [r[:4] for r in got(quotes.locate_once(docs, items))] == [(1, 5, 4, 5), (2, 2, 2, 10), (2, 6, 2, 10)]


def test_spans(spark):
    a = made(spark, [("k", 0, 10), ("k", 5, 5), ("k", 20, 30), ("j", 0, 4)], "key string, a_start long, a_end long")
    b = made(spark, [("k", 9, 21), ("k", 30, 31), ("k", 0, 10), ("j", 4, 8)], "key string, b_start long, b_end long")
    for width in (3, 7, 1000):
        assert [r[1:] for r in got(spans.overlap_join(a, b, "key", width))] == [(0, 10, 0, 10), (0, 10, 9, 21), (20, 30, 9, 21)]
    sizes = made(spark, [(1, 10), (2, 10), (3, 10), (4, 10), (5, 10)], "k long, size long")
    parts = made(spark, [(1, 0, 6), (1, 4, 10), (2, 0, 4), (2, 5, 10), (3, 1, 10), (4, 0, 9)], "k long, char_start long, char_end long")
    assert got(spans.coverage_violations(parts, sizes, "k")) == [(2, "gap"), (3, "start"), (4, "end"), (5, "missing")]
    assert {r[0] for r in got(spans.tiling_violations(parts, sizes, "k"))} == {1, 2, 3, 4}
    box = made(spark, [([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 2.0]), ([0.0, 0.0, 1.0, 1.0], [1.0, 0.0, 2.0, 1.0])], "a array<double>, b array<double>")
    assert got(box.select(spans.boxes_overlap("a", "b"), spans.shared_of_smaller("a", "b"))) == [(False, 0.0), (True, 0.5)]
    pieces, src = made(spark, [(1, "x"), (2, "y"), (3, "z")], "piece_id long, key string"), made(spark, [(7, "x"), (8, "y"), (9, "y")], "source_id long, key string")
    assert got(spans.unique_match(pieces, src, "key")) == [(1, "matched", 7), (2, "ambiguous", None), (3, "unmatched", None)]


def test_sets(spark):
    a, b = made(spark, [(1,), (2,), (2,)], "k long"), made(spark, [(2,), (3,)], "k long")
    assert got(sets.two_sided_difference(a, b)) == [(1, "left"), (3, "right")]
    assert got(sets.assignment_faults(made(spark, [(1,), (2,), (3,)], "k long"), made(spark, [(1,), (1,), (2,), (9,)], "k long"), "k")) == [(1, 2, True), (3, 0, True), (9, 1, False)]
    pairs = made(spark, [("p", 1), ("p", 2), ("q", 1), ("p", 1)], "who string, what long")
    assert got(sets.relational_division(pairs, "who", "what", pairs.select("what"))) == [("p",)]
    assert got(sets.precision_recall(a, b, ["k"])) == [(1, 2, 2, 0.5, 0.5, 0.5)]
    none = a.where("k > 9")
    assert got(sets.precision_recall(none, none, ["k"])) == [(0, 0, 0, 1.0, 1.0, 1.0)]
    assert got(sets.mode(made(spark, [("g", 2), ("g", 1), ("h", 5)], "g string, v long"), ["g"], "v")) == [("g", 1, 1), ("h", 5, 1)]


def test_versions(spark):
    rows = made(spark, [("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("t", 4, "b"), ("t", 5, "a")], "series string, o long, data string")
    chain = versions.version_chain(rows, ["series"], "o", "data")
    assert got(chain) == [("s", 1, "a", 1, None, False), ("s", 3, "b", 2, 1, True), ("t", 4, "b", 1, None, False), ("t", 5, "a", 2, 4, True)]
    assert got(versions.version_status(chain, ["series"], "data")) == [("a", "historical", 2), ("b", "historical", 2)]
    kinds = made(spark, [("application/pdf", None, None), ("text/plain", "code", None), ("image/png", None, "web"), ("text/markdown", None, None), ("x/y", None, None)], "m string, p string, o string")
    assert [r[0] for r in kinds.select(versions.source_kind(F.col("m"), F.col("p"), F.col("o"))).collect()] == ["pdf", "code", "web", "markdown", "other"]


def test_graph(spark):
    chain = made(spark, [(i, i + 1) for i in range(128)], "src long, dst long")
    assert graph.closure(chain, made(spark, [(0,)], "src long")).count() == 128
    loop = made(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert got(graph.cycle_nodes(loop)) == [(1,), (2,), (3,)]
    assert got(graph.depths(made(spark, [(3, 2), (3, 1), (2, 1)], "src long, dst long"))) == [(1, 0), (2, 1), (3, 2)]
    premises = made(spark, [("d1", 10, 1), ("d1", 10, 2), ("d2", 20, 10), ("d3", 30, 31), ("d4", 31, 30), ("d5", 40, 9)], "derivation string, result long, premise long")
    assert got(graph.supported(premises, made(spark, [(1,), (2,)], "node long"))) == [(1, 0), (10, 1), (2, 0), (20, 2)]


def test_relations(spark):
    edges = made(spark, [(1, 1, 2, True, True), (2, 1, 2, False, True), (3, 1, 9, True, True), (4, 1, 2, True, True), (5, 1, 2, True, False), (6, 1, 2, True, True), (7, 1, 2, True, True)], "edge_id long, src long, dst long, current boolean, original boolean")
    events = made(spark, [(4, 10, True), (6, 10, True), (6, 11, False), (7, 12, None)], "edge_id long, event_order long, applicable boolean")
    fences = made(spark, [(4, 11), (6, 5)], "edge_id long, fence_order long")
    status = relations.edge_status(edges, events, fences, made(spark, [(1,), (2,)], "node long"))
    assert [(r[0], r[3]) for r in got(status)] == [(1, "applicable"), (2, "historical"), (3, "endpoint_unusable"), (4, "pending"), (5, "pending"), (6, "inapplicable"), (7, "pending")]
    assert got(relations.contested(status, made(spark, [(1, "contradicts"), (6, "contradicts")], "edge_id long, predicate string"))) == [(1,), (2,)]


def test_vectors(spark):
    v = made(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r[0] for r in retrieval.topk(v, [1.0, 0.0], 2).collect()] == [1, 5]
    asked = v.where("vec_id = 2").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(r["vec_id"], round(r["score"], 6)) for r in sorted(retrieval.cosine_topk(v, asked, 3).collect(), key=lambda r: r["rank"])] == [(2, 1.0), (1, 0.707107), (5, 0.707107)]


def test_worklist(spark):
    now = datetime.datetime(2024, 1, 2)
    old, new = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 3)
    rows = [(1, "pending", None, None, 1), (2, "retry", old, None, 1), (3, "retry", new, None, 1), (4, "leased", None, old, 2), (5, "leased", None, new, 2), (6, "leased", None, new, 1), (7, "done", None, None, 1)]
    tasks = made(spark, rows, "task_id long, state string, retry_after timestamp, lease_expires timestamp, epoch int")
    assert [r[0] for r in got(worklist.claimable(tasks, F.lit(now), 2))] == [1, 2, 4, 6]
    turns = made(spark, [("c", i, n) for i, n in enumerate([5, 5, 1, 20, 1])], "g string, o long, n long")
    assert [r[3] for r in got(worklist.greedy_batches(turns, ["g"], "o", "n", 10))] == [0, 0, 1, 2, 3]
    log = made(spark, [("u", 1, "A"), ("u", 2, "B"), ("u", 3, "A"), ("u", 4, "A")], "w string, o long, v string")
    assert got(worklist.oscillations(log, "w", "o", "v")) == [("u", 3, "A", "B")]
    assert got(worklist.streaks(log, "w", "o", F.col("v") == "A")) == [("u", 2)]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_blocks_of_passages(spark, monkeypatch, n):
    monkeypatch.setattr(quotes, "BLOCK_CHARS", 4)
    docs, items = made(spark, [(1, "one two three")], "doc_id long, text string"), made(spark, [(i, t) for i, t in enumerate(["one", "two", "three"][:n])], "item_id long, text string")
    assert [r[:2] for r in got(quotes.locate_once(docs, items))] == [(1, i) for i in range(n)]
