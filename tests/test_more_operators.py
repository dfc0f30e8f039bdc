"""Storage, segmentation, review, realms, code and figures on literals."""

import random

from loomspark.functions import figures
from loomspark.operators import realms, relations, retrieval, review, segments, sets
from loomspark.sources import code, store
from loomspark.sources.workspace import fresh_path


def made(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_store(spark, tmp_path):
    for name, body in (("a.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"one")):
        (tmp_path / name).write_bytes(body)
    files, path = store.hashed_files(spark, str(tmp_path)), fresh_path(spark, "store")
    assert store.publish(files, path).count() == 2
    assert store.publish(files, path).count() == 0
    rows = store.verified(spark, path)
    assert sorted(bytes(r["content"]) for r in rows.collect()) == [b"one", b"two"] and rows.where("not valid").isEmpty()
    requests = made(spark, [(1, "x"), (2, "x"), (3, "y")], "request_id long, data_id string")
    assert got(store.import_states(requests, made(spark, [("y",)], "data_id string"))) == [(1, "x", "committed"), (2, "x", "duplicate"), (3, "y", "duplicate")]
    sent = made(spark, [("C1", "A", 1), ("C1", "A", 2), ("C2", "A", 3), ("C1", "B", 4)], "request_id string, fingerprint string, order long")
    assert [r["state"] for r in sorted(store.replays(sent).collect(), key=lambda r: r["order"])] == ["new", "replay", "new", "idempotency_conflict"]


def test_segmented(spark):
    from hashlib import sha256

    name = sha256(b"ab").hexdigest()
    segs, manifest = store.segmented(made(spark, [(name, 0, b"a"), (name, 1, b"b"), ("bad", 0, b"a")], "data_id string, pos long, body binary"))
    assert segs.count() == 2
    assert sorted((bytes(r["content"]), r["whole"]) for r in store.reassembled(segs, manifest).collect()) == [(b"a", False), (b"ab", True)]


def test_sections(spark):
    blocks = [("title", "My paper"), ("header", "h"), ("title", "1. Introduction"), ("text", "a"), ("title", "Detail"), ("text", "b"), ("title", "2 Results"), ("title", "First finding"), ("text", "c"), ("title", "Second finding"), ("text", "d"), ("title", "References"), ("text", "e")]
    df = made(spark, [("d", i, t, x) for i, (t, x) in enumerate(blocks)], "doc string, ord long, type string, text string")
    assert [(r[2], r[3]) for r in sorted(got(segments.sections(df, "doc")), key=lambda r: r[1])] == [
        (0, None), (0, None), (1, "introduction"), (1, "introduction"), (1, "introduction"), (1, "introduction"), (2, "results"), (2, "results"), (2, "results"), (3, "results"), (3, "results"), (4, "references"), (4, "references"),
    ]


def test_chunks_and_ranges(spark):
    df = made(spark, [("d", i, i // 2, n) for i, n in enumerate([5, 5, 5, 30, 5, 5])], "doc string, ord long, page long, chars long")
    assert [r[2] for r in sorted(got(segments.bounded_chunks(df, "doc", 17, 2)), key=lambda r: r[1])] == [0, 0, 1, 2, 3, 3]
    assert segments.split_ranges("aa bb\ncc dd", 7) == [(0, 6), (6, 11)]
    assert segments.split_ranges("aaaaaaaaaa", 4) == [(0, 4), (4, 8), (8, 10)]
    assert segments.split_ranges("aa bb cc", 4) == [(0, 3), (3, 6), (6, 8)]
    pairs = made(spark, [(0, 1, 2), (0, 1, 3), (0, 4, 5), (0, 4, 6)], "group long, a long, b long")
    assert [r[3] for r in sorted(got(segments.pair_batches(pairs, 3, 9)))] == [0, 0, 1, 1]
    assert [r[2:] for r in got(segments.assembled(made(spark, [("g", 1, "ab"), ("g", 2, "c")], "g string, o long, text string"), ["g"], "o"))] == [("ab", 0, 2), ("c", 4, 5)]


def test_markdown_groups(spark):
    text = "﻿intro\r\n\r\n# A\r\n\r\n## B\r\ntext\r\n```\r\n# no heading\r\n```\r\n> # quoted\r\n\r\nUnder\r\n-----\r\nmore\r\n# C #\r\n# D\r\nend"
    groups = segments.markdown_groups(text)
    assert [g["titles"] for g in groups] == [[], ["A", "B"], ["Under"], ["C"], ["D"]]
    assert [g["path"] for g in groups] == [[], ["A", "B"], ["A", "Under"], ["C"], ["D"]]
    for t in (text, "", "plain", "# only", "\n\n# x\r# y", "Title\n===\n\n--\nz"):
        found = segments.markdown_groups(t)
        assert "".join(t[g["char_start"] : g["char_end"]] for g in found) == t
    rows = sorted(got(segments.markdown_table(made(spark, [(1, text), (2, None)], "k long, text string"), "k")), key=lambda r: r[1])
    assert rows[0][4] == 0 and rows[-1][5] == len(text.encode()) and all(a[5] == b[4] for a, b in zip(rows, rows[1:], strict=False))


def test_html_headings(spark):
    html = "<h1 class=x>A &amp; <b>b</b></h1><p>t</p><H3>c</H3><h2>d\n e</h2><h2>f</h2>"
    df = made(spark, [(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    assert [r[2:] for r in sorted(got(segments.html_headings(df)), key=lambda r: r[1])] == [(1, "A & b", "A & b"), (3, "c", "A & b > c"), (2, "d e", "A & b > d e"), (2, "f", "A & b > f")]


def test_figures():
    short = lambda t: [(s, n, p, w) for *_, s, n, p, w in figures.mentions(t)]
    assert short("see Fig. 1 and 3") == [("main", "1", "", ""), ("main", "3", "", "")]
    assert short("Figures 2-4") == [("main", n, "", "") for n in "234"]
    assert short("Figure 1a-c, 2B") == [("main", "1", "abc", ""), ("main", "2", "b", "")]
    assert short("Supplementary Figs. 1, S2 & 3") == [("supplement", "1", "", ""), ("supplement", "2", "", ""), ("supplement", "3", "", "")]
    assert [w for *_, w in short("Fig. 1-900")] == ["figure_range_not_expanded"] * 2
    assert short("Figure 1 a dog; figment 3; Fig. IV") == [("main", "1", "", "")]
    assert [m[:2] for m in figures.mentions("x Fig. 1, 2 y")] == [(2, 11), (2, 11)]


def test_dispositions(spark):
    reviews = made(spark, [("a", 1, "context_only", "r1"), ("a", 2, "not_selected", "r0"), ("b", 1, "needs_review", None), ("c", 1, "not_selected", "x"), ("c", 2, "not_selected", "x"), ("d", 1, "context_only", "y")], "unit_id string, batch long, disposition string, reason string")
    cited = made(spark, [("b",), ("d",)], "unit_id string")
    assert got(review.merged_dispositions(reviews, cited)) == [("a", "context_only", "r1; r0"), ("b", "needs_review", None), ("c", "not_selected", "x"), ("d", "selected", "y")]


def test_selection(spark):
    units = made(spark, [(u,) for u in "abcdef"], "unit_id string")
    reviews = made(spark, [("a", "selected"), ("b", "context_only"), ("c", "selected"), ("d", "selected"), ("d", "selected"), ("e", "not_selected"), ("z", "selected")], "unit_id string, disposition string")
    keys = made(spark, [("a", "k1"), ("a", "k9"), ("b", "k1")], "unit_id string, candidate string")
    cites = made(spark, [("a", "k1"), ("a", "k2"), ("e", "k2")], "unit_id string, candidate string")
    assert got(review.selection_faults(units, reviews, keys, cites)) == [
        ("a", "declared_without_citation"), ("b", "declared_without_citation"), ("b", "declares_candidates"), ("c", "selected_without_citation"),
        ("d", "reviewed_twice"), ("e", "cited_but_not_selected"), ("f", "unreviewed"), ("z", "unknown_unit"),
    ]
    assert got(review.completed_keys(reviews, keys, cites)) == [("a", "k1", False), ("a", "k2", True)]


def test_reuse(spark):
    r = random.Random(2)
    links = {i: r.randrange(60) for i in range(50)}
    want = {}
    for k in links:
        seen, x = [], k
        while x in links and x not in seen:
            seen.append(x)
            x = links[x]
        want[k] = x if x not in links else min(seen[seen.index(x) :])
    assert dict(got(review.reuse_roots(made(spark, list(links.items()), "key long, target long")))) == want
    rows = made(spark, [(1, True, True, True, True), (2, True, True, False, True), (3, True, True, None, True), (4, True, True, True, False), (5, False, True, True, True)], "target_id long, identity_confirmed boolean, grounding_valid boolean, material_change boolean, content_changed boolean")
    assert [d for _, d in got(review.materiality(rows))] == ["accepted_revision", "reused", "needs_human", "needs_human", "needs_human"]
    current = made(spark, [("n1", "p", "i1", "c1", "s"), ("n2", "p", "i2", "c2", "s"), ("n3", "p", "i3", "c2", "s"), ("n4", "p", "i4", "c4", "s")], "node string, kind string, identity string, content string, scope string")
    asked = made(spark, [("a", "p", "i1", "c1", "s"), ("b", "p", "i1", "c9", "s"), ("c", "p", "x", "c2", "s"), ("d", "p", "x", "c4", "s"), ("e", "p", "x", "c4", None)], "candidate string, kind string, identity string, content string, scope string")
    assert got(review.reuse_by_fingerprint(asked, current)) == [("a", "reused", "n1"), ("b", "conflict", None), ("c", "needs_human", None), ("d", "reused", "n4"), ("e", "accepted_new", None)]


def test_proposals_and_compositions(spark):
    proposals = made(spark, [(1, "proposition"), (2, "observation"), (3, "proposition"), (4, "proposition"), (5, "proposition"), (6, "proposition")], "proposal_id long, kind string")
    premises = made(spark, [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "b"), (4, "b"), (5, "a"), (5, "z")], "proposal_id long, node string")
    inputs = made(spark, [("a",), ("b",)], "node string")
    assert got(review.proposal_faults(proposals, premises, inputs)) == [(2, "result_is_no_proposition"), (3, "too_few_premises"), (4, "premise_repeated"), (5, "premise_is_no_input"), (6, "too_few_premises")]
    assert [r[1] for r in got(review.compositions(made(spark, [("p", 2, "x"), ("p", 1, "y")], "parchment string, ord long, part string")))] == ["y,x"]


def test_realms(spark):
    changes = made(spark, [("r", 1, ["a", "b", "a"]), ("r", 2, ["b", "a"]), ("r", 3, ["b"])], "realm string, at long, members array<string>")
    assert got(realms.revisions(changes)) == [("r", 1, 1, 3, ["a", "b"]), ("r", 2, 3, None, ["b"])]
    members = made(spark, [("r", "x", None), ("r", "y", None), ("s", "x", None), ("s", None, "q")], "realm string, data_id string, series string")
    common = realms.common_realms(members, made(spark, [("x",), ("y",)], "data_id string"))
    assert got(common) == [("r",)]
    one = made(spark, [("r",)], "realm string")
    assert got(realms.default_realm(common, one.limit(0))) == [("r", "resolved")]
    assert got(realms.default_realm(members.select("realm").distinct(), one)) == [("r", "resolved")]
    assert got(realms.default_realm(members.select("realm").distinct(), one.limit(0))) == [(None, "ambiguous")]
    used = made(spark, [("x", None), ("z", "q"), ("w", "v")], "data_id string, series string")
    assert got(realms.outside_scope(used, members, "s")) == [("w",)]


def test_code(spark):
    text = "import os\n\n@dec\ndef a():\n    pass\n\ndef b():\n    pass\n\nclass C:\n    x = 1\n    def m(self):\n        return 1\n    def n(self):\n        return 2\n"
    assert code.units(text, 10_000) == [("<preamble>", 1, 2), ("a,b,C", 3, 15)]
    small = code.units(text, 40)
    assert [u[0] for u in small] == ["<preamble>", "a", "b", "C.<preamble>", "C.m", "C.n"] and small[0][1] == 1 and small[-1][2] == 15
    assert all(a[2] + 1 == b[1] for a, b in zip(small, small[1:], strict=False))
    assert code.units("def (", 10) == [("<unparsed>", 1, 1)] and code.units("", 10) == []
    files = made(spark, [("r", "b.py", "x = 1\n"), ("r", "a.py", "é\n")], "repo string, path string, text string")
    placed = code.dossier(files, ["repo"])
    [(_, whole)] = got(code.dossier_text(placed, ["repo"]))
    assert [whole[r["char_start"] : r["char_end"]] for r in sorted(placed.collect(), key=lambda r: r["path"])] == ["é\n", "x = 1\n"]
    assert [r[2] for r in got(code.code_units(files))] == ["<preamble>", "<preamble>"]


def test_neighbour_graph(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(120)] + [(200 + i, [1.0, 2.0, 3.0]) for i in range(9)] + [(300, [0.0, 0.0, 0.0]), (301, None)]
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if v and any(v)}
    want = set()
    for a, v in unit.items():
        near = sorted(((round(sum(x * y for x, y in zip(v, u, strict=True)), 12), b) for b, u in unit.items() if b != a), reverse=True)
        want |= {(min(a, b), max(a, b), round(s, 8)) for s, b in near[:3] if s >= 0.75}
    for size in (7, 2000):  # many blocks, and one
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", size)
        found = retrieval.neighbour_graph(made(spark, rows, "vec_id long, embedding array<double>"), 3, 0.75)
        assert sorted((x["src"], x["dst"], round(x["score"], 8)) for x in found.collect()) == sorted(want)


def test_rank_distinct_cut(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.9), ("b", 3, 0.9), ("b", 4, 0.1), ("c", 5, 0.2), ("d", 6, 0.9)]
    out = retrieval.rank_distinct_cut(made(spark, rows, "doc string, chunk long, score double"), "doc", "chunk", 3)
    assert [tuple(x) for x in out.collect()] == [("a", 2, 0.9), ("b", 3, 0.9), ("d", 6, 0.9)]


def test_manifest_diff_of_all_documents(spark, tmp_path):
    from loomspark.plans import catalogue

    made(spark, [(i, "de", 5 + i) for i in range(1, 72)], "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {f"de/{i}": "added" if i % 10 == 0 else "removed" if i % 14 == 0 else "changed" if i % 6 == 0 else "unchanged" for i in range(1, 72) if i % 70}
    assert dict(map(tuple, catalogue.manifest_diff(spark, str(tmp_path)).collect())) == want


def test_object_aggregate(spark):
    rows = [(1, "b", "x"), (1, "a", None), (1, "b", "z"), (1, None, "q"), (2, None, "q"), (None, "k", '"')]
    df = spark.createDataFrame(rows, "g int, k string, v string")
    got = {r["g"]: r["object"] for r in sets.object_aggregate(df, ["g"], "k", "v").collect()}
    assert got == {1: '{"a":null,"b":"z"}', None: '{"k":"\\""}'}
    assert sets.object_aggregate(df.limit(0), ["g"], "k", "v").count() == 0


def test_caption_anchors(spark):
    rows = [
        (1, "Figure 2(a,b): cells, as in Figure 1", "text"), (2, "Figure 2 shows cells", "text"), (3, "Figure 2 shows cells", "figure_title"), (4, "Figs. 2-3 cont. from page 1", "text"),
        (5, "In Figure 2: cells", "image_caption"), (6, None, "image_caption"), (7, "", None), (8, "\n Fig. S4 | x", None),
    ]
    got = figures.caption_anchors(made(spark, rows, "block_id long, text string, type string")).collect()
    want = [(1, "main", "2", "ab", "", False), (3, "main", "2", "", "", False), (4, "main", "2", "", "", True), (4, "main", "3", "", "", True), (8, "supplement", "4", "", "", False)]
    assert sorted(map(tuple, got)) == want


def test_refresh_targets_and_historical_links(spark):
    links = made(spark, [(3, "now", "s1"), (1, "now", "s1"), (2, "then", "s1"), (4, "now", "old"), (5, None, "s1"), (6, "now", None), (7, "now", "s2")], "link_id long, request_id string, snapshot_id string")
    pages = made(spark, [("d1", "p1", "s1"), ("d2", "p2", "s2"), ("d3", "p3", "s3")], "data_id string, page_id string, snapshot_id string")
    got = sorted((r["data_id"], r["links"]) for r in relations.refresh_targets(links, pages, "now").collect())
    assert got == [("d1", [1, 3]), ("d2", [7])]
    assert sorted(r["link_id"] for r in relations.historical_links(links, pages, "now").collect()) == [2, 4, 5, 6]
    assert relations.refresh_targets(links.limit(0), pages, "now").count() == 0
