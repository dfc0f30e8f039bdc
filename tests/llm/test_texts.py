import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomspark.llm import batches, exact, media, neardup, pii, repeats, toxicity
from tests.llm.data import empty, frame, texts


def brute_repeats(rows, n):
    seen = Counter(b[i : i + n] for b in rows for i in range(len(b) - n + 1))
    out = []
    for b in rows:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i + 1 : i + n + 1] = True
        edges = int(((gone[1:] & ~gone[:-1]).sum()))
        raw = np.frombuffer(b, np.uint8)
        out.append((len(b), int(gone.sum()), edges, hashlib.sha256(raw[~gone[1 : len(b) + 1]].tobytes()).hexdigest()))
    return out


def test_repeats(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    shared = [" ".join(word() for _ in range(90)) for _ in range(4)]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 200)))) for i in range(30)]
    rows += [(100 + i, " ".join([*(word() for _ in range(r.randint(0, 90))), r.choice(shared), *(word() for _ in range(r.randint(0, 90)))])) for i in range(40)]
    rows += [(200, "z" * 1500), (201, "z" * 399), (202, "ab" * 500), (203, rows[0][1] * 3), (204, shared[0][:400]), (205, shared[0][:399]), (206, "é" * 450), (207, None), (208, ""), rows[5], (None, shared[1] + "x")]
    df, _ = frame(spark, rows)
    got = Counter(tuple(x) for x in repeats.digest(df).collect())
    want = Counter((k, *v) for (k, _), v in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 400), strict=True))
    assert got == want
    assert repeats.digest(empty(spark)).collect() == []


def test_corpus_order(monkeypatch):
    """The order from the suffix arrays of dictionary and parse finds what counting all strings finds."""
    r = random.Random(1)
    for trial in range(150):
        n = r.choice([17, 20, 30, 50, 100, 400])
        base = [bytes(r.choices(b"ab" if trial % 3 == 0 else b"abcdefgh \x00\xff", k=r.randint(1, 600))) for _ in range(4)]
        parts = {}
        for q in range(r.randint(1, 12)):
            t = (b"z" * r.randint(1, 900) if trial % 5 == 0 else b"") + b"".join(r.choice(base)[r.randint(0, 50) :] for _ in range(r.randint(1, 5)))
            if len(t) >= n and t not in parts.values():
                parts[q] = t
        seen = Counter(b[i : i + n] for b in parts.values() for i in range(len(b) - n + 1))
        want = {}
        for q, b in parts.items():
            x = [False, *(seen[b[i : i + n]] > 1 for i in range(len(b) - n + 1)), False]
            if any(x):
                want[q] = [i for i in range(len(x) - 1) if x[i] != x[i + 1]]
        monkeypatch.setattr(repeats, "TRIGGER", r.choice([1, 2, 8, 64]))
        assert not parts or repeats.repeated_starts(parts, n) == want, trial
    order = repeats.Order([b"banana", b"bandana"], 2)
    text = b"bananabandana"
    assert [text[order.starts[k] : order.starts[k] + 2] for k in order.order.tolist()] == sorted(text[i : i + 2] for i in [*range(5), *range(6, 12)])


def test_repeats_of_hot_parts(spark, monkeypatch):
    """A gram hash with many distinct segments is counted by rows, with the same result."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(90))
    rows = [(i, " ".join([*(word() for _ in range(5)), passage, *(word() for _ in range(5))])) for i in range(20)]
    bodies = {(i, 0): t.encode() for i, t in rows}
    found = repeats.repeated_starts(bodies, 400)
    df, _ = frame(spark, rows)
    want = Counter((k, *v) for (k, _), v in zip(rows, brute_repeats([t.encode() for _, t in rows], 400), strict=True))
    monkeypatch.setattr(repeats, "HOT_BYTES", 900)
    texts_ = repeats.stored(df)
    segs = repeats.cut(texts_, repeats.phrases_once(texts_), 400, 4)
    assert segs.count() and found
    assert Counter(tuple(x) for x in repeats.digest(df).collect()) == want


def test_repeats_of_other_lengths(spark):
    """A passage of over 50 words, below 400 bytes, that is a text of its own and also lies within a longer one."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(52))
    rows = [(0, passage), (1, " ".join([*(word() for _ in range(90)), passage, *(word() for _ in range(90))])), (2, " ".join(word() for _ in range(60)))]
    df, _ = frame(spark, rows)
    for n in (100, len(passage), len(passage) + 1):
        want = [v[:2] for v in brute_repeats([t.encode() for _, t in rows], n)]
        got = {x["doc_id"]: (x["n_bytes"], sum(x["spans"][1::2]) - sum(x["spans"][::2])) for x in repeats.without_repeats(df, n).collect()}
        assert [got[k] for k, _ in rows] == want, n


def brute_shared(rows, words):
    found = [[b[x.start() : y.end()] for x, y in zip(w, w[words - 1 :], strict=False)] for b in rows for w in [list(re.finditer(rb"[^\x20\x09-\x0d]+", b))]]
    seen = Counter(p for f in found for p in set(f))
    return [sum(seen[p] > 1 for p in f) for f in found]


def test_shared_passages(spark, monkeypatch):
    """A passage of over 50 words, below 400 bytes, counts where another text has it; the digest's other columns stay."""
    r = random.Random(8)
    word = lambda n=5: "".join(r.choices("abcdefgh", k=n))
    some = lambda n: [word() for _ in range(n)]
    short = [" ".join(word(r.randint(1, 9)) for _ in range(r.choice([50, 51, 57]))) for _ in range(5)]
    rows = [(i, " ".join([*some(r.randint(0, 150)), short[i % 5], *some(r.randint(0, 150))])) for i in range(25)]
    rows += [(50 + i, " ".join(some(r.randint(30, 150)))) for i in range(10)]
    twice = " ".join(some(60))
    rows += [(70, " ".join([twice, *some(40), twice])), (71, short[0]), (72, " ".join(short[1].split(" ")[:49])), (73, short[2].replace(" ", "\n", 1)), (74, "\t " + short[3] + "\r\n")]
    rows += [(75, "a " * 200), (76, " ".join("a" * 60)), (77, " ".join("b" * 300)), (78, None), (79, ""), (80, " \n "), (81, " ".join(["é"] * 70)), rows[3], (None, rows[4][1] + " x"), (82, twice[: twice.rindex(" ")]), (83, rows[5][1]), (84, rows[5][1])]
    df, _ = frame(spark, rows)
    raw = [(t or "").encode() for _, t in rows]
    want = Counter((k, *v, n) for (k, _), v, n in zip(rows, brute_repeats(raw, 400), brute_shared(raw, 50), strict=True))
    assert all(len(x) < 400 for x in short[:2]) and sum(n > 0 == v[1] for *v, n in (x[1:] for x in want)) > 5
    assert Counter(tuple(x) for x in repeats.digest(df, 50).collect()) == want
    monkeypatch.setattr(repeats, "SPLIT", 3)
    assert Counter((x["doc_id"], x["n_shared"]) for x in repeats.without_repeats(df, 400, 17).collect()) == Counter((k, n) for (k, _), n in zip(rows, brute_shared(raw, 17), strict=True))
    assert repeats.digest(empty(spark), 50).collect() == []


def test_media(spark):
    df, rows = frame(spark)
    got = defaultdict(set)
    for x in media.digest(df).collect():
        got[x["doc_id"]].add(tuple(x)[1:7])
    for k, t in rows:
        raw = (t or "").encode()
        full = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        stored = media.as_wav(full)
        assert (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest()) in got[k]
    assert media.digest(empty(spark)).collect() == []


def png():
    import struct

    chunk = lambda n, d: struct.pack(">I4s", len(d), n) + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import gzip
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
    wav, packed = media.as_wav(b"12345"), gzip.compress(b"x" * 1000)
    rows = [
        ("wav", wav, "image/png"), ("png", png(), "image/png"), ("zip", held.getvalue(), None), ("cut", wav[:-3], "audio/wav"),
        ("inside", b"BM junk RIFF" + png() + b"tail" + packed, "text/plain"), ("none", None, "x/y"), ("empty", b"", "x/y"), ("bad", png()[:-5] + b"xxxxx", "image/png"),
    ]
    df = spark.createDataFrame(rows, "media_id string, content binary, declared string")
    got = {x["media_id"]: x for x in media.sniffed(df).collect()}
    assert [(k, got[k]["type"], got[k]["corrected"]) for k, *_ in rows] == [
        ("wav", "audio/wav", True), ("png", "image/png", False), ("zip", "application/zip", True), ("cut", "audio/wav", False),
        ("inside", "text/plain", False), ("none", None, False), ("empty", "x/y", False), ("bad", "image/png", False),
    ]
    assert [(e["type"], bytes(e["content"])) for e in got["inside"]["embedded"]] == [("image/png", png()), ("application/gzip", packed)]


def test_scans_take_time_in_proportion(spark):
    """Magic bytes over and over, and what ends a PDF or an archive."""
    import io
    import time
    import zipfile

    began = time.time()
    for v in (b"%PDF-1.4" * 200_000, b"PK\x03\x04" * 200_000, b"%PDF-1.4startxref 1 %%EOF" * 50_000, b"PK\x03\x04PK\x05\x06" * 100_000):
        media.sniffer().find(v)
    assert time.time() - began < 20
    pdf = b"%PDF-1.4 x\nstartxref\n9\n%%EOF"
    added = pdf + b" more startxref\n11\n%%EOF"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
    v = b"junk" + added + b"\n" + pdf + b"%PDF-1.x" + held.getvalue() + b"PK\x03\x04"
    assert [(f.kind, v[f.start : f.end]) for f in media.sniffer().find(v)] == [("pdf", added), ("pdf", pdf), ("zip", held.getvalue())]


def test_media_that_vary(spark):
    """Declared types are corrected and media inside texts are found by the same path that the query takes."""
    texts_ = ["plain", "GIF89a" + "x" * 40, "a RIFF b", "%PDF-1.4 x\nstartxref\n9\n%%EOF tail", None]
    df, _ = frame(spark, list(enumerate(texts_)))
    got = {x["doc_id"]: x["feature"] for x in media.digest(df).collect()}
    assert all(f.startswith("text/plain>audio/wav;44-") for f in got.values())
    assert "embedded=0;" in got[0] and "embedded=0;" in got[1] and "embedded=pdf:0-28;" in got[3]
    for k, t in enumerate(texts_):
        payload = np.frombuffer(media.padded((t or "").encode()), np.uint8).astype(int)
        assert got[k].endswith(f";mean={payload.sum() * 1000 // len(payload)};step={abs(np.diff(payload)).max()}")


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(t):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_luhn():
    assert pii.luhn("4994226020900891") and pii.luhn("79927398713") and not pii.luhn("79927398710")


def test_base_spans():
    r = random.Random(9)
    for alphabet in ("a.@-0 ", "0123.+ ()-", "1.25", "ab@.c\n", "4990 8-", "é@a.b0"):
        for _ in range(400):
            t = "".join(r.choices(alphabet, k=r.randint(0, 60)))
            assert pii.base_spans(t) == brute_base(t), t
    for t in ("9" * 50_000, "a" * 50_000 + "@", "+1" * 20_000, "1." * 20_000, "a@" * 20_000):
        assert pii.base_spans(t) == ([] if t[0] != "1" else pii.base_spans(t))


def test_pii(spark):
    more = ["mail a.b@c.de or +1 (523) 555-1055 from 10.0.0.256 and 10.0.0.255, card 4994 2260 2090 0891", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" x', "ssn 123-45-6789 and Mr. John Smith", "key 00000000000000000000"]
    rows = [*enumerate(texts() + more * 3), (None, more[0])]
    df, _ = frame(spark, rows)
    got = Counter(tuple(x)[:6] for x in pii.digest(df).collect())
    want = Counter()
    for k, t in rows:
        spans = brute_base(t or "")
        n = Counter(s[1] for s in spans)
        said = ",".join(f"{pii.KINDS[j]}:{a}:{b}" for a, j, b in spans)
        want[k, n[0], n[1], n[2], n[3], hashlib.sha256(said.encode()).hexdigest()] += 1
    assert got == want
    for x in pii.digest(df).collect():
        t = dict(rows)[x["doc_id"]] or ""
        for s in filter(None, x["spans"].split(",")):
            kind, a, b = s.split(":")
            assert kind in pii.KINDS + pii.MORE and 0 <= int(a) < int(b) <= len(t)
    done = pii.redact(df)
    assert done.columns == df.columns
    out = {x["doc_id"]: x["text"] for x in done.collect() if x["doc_id"] is not None}
    first = out[len(texts())]
    assert "a.b@c.de" not in first and "[EMAIL]" in first and "[PHONE]" in first and "10.0.0.256" in first and "[IP]" in first and "[CARD]" in first
    assert "1eb9c654e721b4f812088970e66a6345cee33dd6" not in out[len(texts()) + 1]
    assert out[1] is None and out[20] == rows[20][1]
    assert pii.digest(empty(spark)).collect() == pii.redact(empty(spark)).collect() == []


def test_added_spans_of_each_kind(spark):
    """What the labelers agree on is added beside the base spans; what they speak against is not."""
    r = random.Random(5)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows, want = [], {}
    for i in range(240):
        kind, word = (("secret", f"token: {hexes(40)}"), ("number", f"ssn {r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"), ("name", f"contact Mr. John {r.choice(['Smith', 'Miller'])}"), (None, f"order {'0' * 12}"), (None, "see @media here"))[i % 5]
        head = " ".join(r.choices(["alpha", "beta", "gamma"], k=r.randint(1, 30)))
        rows.append((i, f"{head} {word} and more"))
        at = len(head) + 1 + len(word.split(" ")[0]) + 1 + (4 if kind == "name" else 0)
        want[i] = f"{kind}:{at}:{len(head) + 1 + len(word)}" if kind else ""
    df, _ = frame(spark, rows)
    got = {x["doc_id"]: x["spans"] for x in pii.digest(df).collect()}
    assert got == want


def test_reliabilities_finds_the_labelers():
    r = random.Random(0)
    counts = Counter()
    for _ in range(5000):
        y = r.random() < 0.3
        counts[tuple((1 if (r.random() < q) == y else -1) if r.random() < 0.8 else 0 for q in (0.95, 0.9, 0.85, 0.6, 0.8))] += 1
    share, table, likely = pii.reliabilities(counts)
    assert 0.2 < share < 0.4 and table[0, 1, 2] > table[3, 1, 2]
    assert likely[max(counts, key=sum)] > 0.9 > 0.1 > likely[min(counts, key=sum)]


def brute_near(rows, k):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(x for x in (least.get(find(i)), key) if x is not None) if (least.get(find(i)), key) != (None, None) else None
    return Counter((key, len(s), c := (least[find(i)] if s else key), key == c) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    r = random.Random(8)
    words = ["".join(r.choices("etaoinshrdlu", k=6)) for _ in range(500)]
    rows = list(enumerate(texts(20)))
    for g in range(6):  # chains: each copy differs a little from the one before
        t = r.choices(words, k=200)
        for _ in range(10):
            rows.append((len(rows) * 3, " ".join(t)))
            t = list(t)
            t[r.randrange(200)] = r.choice(words)
    rows += [(5000, "A b  C d"), (4999, "a B c\nD"), (4998, "a b c"), (4997, "A B C"), rows[16], (None, rows[40][1]), (None, "only here without an id at all")]
    df, _ = frame(spark, rows)
    got = Counter(tuple(x) for x in neardup.group(df, k).collect())
    assert got == brute_near(rows, k)
    assert neardup.group(empty(spark), k).collect() == []
    kept = neardup.keep(df, k)
    assert kept.columns == df.columns


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    comp = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: comp[x] for x in linked}


def chained(groups, copies, seed=8):
    """Groups whose copies each differ a little from the one before, and some exact ones."""
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlu", k=6)) for _ in range(500)]
    rows = list(enumerate(texts(10)))
    for _ in range(groups):
        t = r.choices(words, k=200)
        for _ in range(copies):
            rows.append((len(rows) * 3, " ".join(t)))
            t = list(t)
            t[r.randrange(200)] = r.choice(words)
    return [*rows, (5000, rows[16][1]), (4999, rows[-1][1])]


def test_near_duplicates_take_few_tasks(spark):
    """Where the number of shuffle partitions is held, as on check_h, each shuffle counts."""
    rows, held = chained(6, 10), {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    sc, before = spark.sparkContext, {k: spark.conf.get(k) for k in held}
    tracker = sc.statusTracker()

    def stage():
        sc.setJobGroup(group := f"near-{random.random()}", "")
        sc.parallelize([1], 1).count()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return max(s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds)

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = frame(spark, rows)[0]
        first = stage()
        got = Counter(tuple(x) for x in neardup.group(df, 4).collect())
        last = stage()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_near(rows, 4)
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, range(first + 1, last)) if i)
    assert 0 < tasks < 1300, tasks


def test_near_duplicates_without_broadcast_sides(spark, monkeypatch):
    """Sides above SIDE_BYTES are merged, hot keys apart: the same result."""
    monkeypatch.setattr(batches, "SIDE_BYTES", -1)
    rows = chained(3, 8)
    assert Counter(tuple(x) for x in neardup.group(frame(spark, rows)[0], 4).collect()) == brute_near(rows, 4)


@pytest.mark.parametrize("side", [-1, batches.SIDE_BYTES])
def test_components_of_repeated_and_turned_edges(spark, monkeypatch, side):
    monkeypatch.setattr(batches, "SIDE_BYTES", side)
    star, path = [(7, i) for i in range(400, 1100)], [(i, i + 1) for i in range(2000, 2040)]
    edges = [*star, *star[:50], *((b, a) for a, b in star[:50]), *path, *path, (5, 5), (3, 400), (9, 8), (8, 9)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {3: 3, 7: 3, 8: 8, 9: 8} | {b: 3 for _, b in star} | {i: 2000 for i in range(2000, 2041)}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact(spark):
    rows = [*enumerate(texts()), (900, " a"), (901, "a  "), (902, "a "), (903, "\t\na"), (904, None), (905, " "), (2, "a x"), (None, "a    ")]
    df, _ = frame(spark, rows)
    got = Counter(tuple(x) for x in exact.digest(df).collect())
    by = defaultdict(list)
    for i, (k, t) in enumerate(rows):
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k is None, k or 0, i))
    assert len(rows) == sum(got.values())
    want = Counter()
    for norm, group in by.items():
        best = min(group)
        for g in group:
            key = rows[g[3]][0]
            want[key, rows[best[3]][0], len(group), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((a, b, c, e) for (a, b, c, _, e), n in got.items() for _ in range(n)) == want
    assert sum(n for (*_, kept, _), n in got.items() if kept) == len(by)
    assert exact.digest(empty(spark)).collect() == []
    kept = exact.keep(df)
    assert kept.columns == df.columns
    assert Counter((x["doc_id"], x["text"]) for x in kept.collect()) == Counter(rows[min(g)[3]] for g in by.values())
    con = duckdb.connect()
    plain = df.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    documents = plain.toPandas()  # noqa: F841
    assert sorted(map(tuple, exact.digest(plain).collect())) == sorted(con.sql(exact.ORACLE).fetchall())


def test_bloom_has_all_and_little_else(spark):
    rows = spark.range(20000).selectExpr("xxhash64(id) AS h", "id")
    held = rows.where("id % 4 = 0").select("h")
    got = exact.probed(rows, held, 5000)
    assert got.where("id % 4 = 0 and not maybe").count() == 0 and got.where("id % 4 <> 0 and maybe").count() < 300
    assert exact.probed(rows, held.limit(0), 0).where("maybe").count() == 0


def test_slices_change_nothing(spark, monkeypatch):
    df, _ = frame(spark)
    want = Counter(map(tuple, exact.digest(df).collect()))
    monkeypatch.setattr(exact, "SLICE_BYTES", 8)
    assert Counter(map(tuple, exact.digest(df).collect())) == want


CLASHING = "key own gone said mark stays each any all some _gone _id _s _m _sha _n h maybe row uid comp size place slice KEY".split()


def test_keep_takes_any_names_and_repeated_ids(spark):
    """Rows that share a doc_id or have none are told apart by their text; the columns may have any names."""
    a, b = "one two three four five six seven eight nine ten", "quite another text with several words in it"
    rows = [(1, a), (2, a + " "), (2, b), (2, b), (3, ""), (3, ""), (None, a), (None, None), (None, ""), (7, "alone and apart from all")]
    df = spark.createDataFrame([(i, t, *([str(n)] * len(CLASHING[:-1]))) for n, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING[:-1])).repartition(3)
    got = exact.keep(df)
    assert got.columns == df.columns
    # of the texts like `a` the longest stays; of empty ones the least id
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == Counter([(2, a + " "), (2, b), (3, ""), (7, "alone and apart from all")])
    got = neardup.keep(df)
    assert got.columns == df.columns
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == Counter([(1, a), (2, b), (3, ""), (3, ""), (None, None), (None, ""), (7, "alone and apart from all")])
    for keep in (exact.keep, neardup.keep):
        assert keep(df.limit(0)).collect() == []


def test_toxicity(spark):
    import math

    r = random.Random(6)
    bad = ["idiot", "worthless", "grumblefrotz"]
    plain = ["".join(r.choices("bcdfgaeiou", k=r.randint(4, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = r.choices(plain, k=60)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    base = " ".join(plain[:50])
    rows += [(2000, f"{base} you idiot, you wortless grumblefrots {base}"), (2001, f"{base} he wrote \"idiot\" once {base}"), (2002, ""), (2003, None), (None, base), (2004, f"{base} 1d10t 1d10t w0rthless {base}")]
    df, _ = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.digest(df, marks).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got.values())
    held = [(got[i]["predicted"], y) for i, _, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.99 * len(held) and len(held) > 200
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    assert got[2000]["predicted"] == 1 and got[2004]["predicted"] == 1
    assert got[2001]["score"] < 0.7 and got[2002]["score"] < 0.5 and got[2003]["score"] == got[2002]["score"]
    assert got[2001]["score"] < got[2000]["score"]
    none = toxicity.digest(df, spark.createDataFrame([], marks.schema)).collect()
    assert len(none) == len(rows) and all(math.isfinite(x["score"]) for x in none)
    assert toxicity.digest(empty(spark), marks).collect() == []
    clean = toxicity.keep_clean(df, marks)
    assert clean.columns == df.columns and {x["doc_id"] for x in clean.collect()} == {k for k, x in got.items() if not x["predicted"]}


def test_levenshtein_walk_is_exact():
    lex = toxicity.Lexicon({"idiot": 1.0, "worthless": 1.0, "scum": 1.0}, {"achlich": 1.0})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(4000):
        w = list(r.choice(["idiot", "worthless", "scum", "achlichen"]))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choices("abcdiotslwrhe", k=r.randint(0, 1))
        w = "".join(w)
        near = [t for t in lex.words if distance(w, t) <= toxicity.distance_bound(t)]
        found = lex.match(w)
        assert (found is not None) == (bool(near) or w.startswith("achlich")), (w, found)


def test_walk_gives_the_nearest_term_and_its_distance():
    words, starts = {"idiot": 1.0, "idiots": 1.0, "worthless": 1.0, "scum": 1.0}, {"stupid": 1.0, "idioti": 1.0, "moronical": 1.0}
    lex = toxicity.Lexicon(words, starts)

    def last_row(term, word):
        row = list(range(len(word) + 1))
        for i, x in enumerate(term, 1):
            new = [i]
            for j, y in enumerate(word, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row

    r = random.Random(3)
    for _ in range(2000):
        w = list(r.choice([*words, *starts]))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choices("abcdiotslwrhe", k=r.randint(0, 1))
        w = "".join(w) + r.choice(["", "ly", "ation"])
        for end, terms, of in (("word", words, lambda row: row[-1]), ("start", starts, min)):
            near = [(d, t) for t in terms if (d := of(last_row(t, w))) <= toxicity.distance_bound(t)]
            assert lex.walked(w, end) == min(near, default=None), (w, end)


def test_misspelt_beginnings_and_the_words_under_them():
    lex = toxicity.Lexicon({"worthless": 1.0}, {"achlich": 1.0, "thtib": 1.0})

    def prefix_distance(term, word):
        row = list(range(len(word) + 1))
        for i, x in enumerate(term, 1):
            new = [i]
            for j, y in enumerate(word, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    r = random.Random(2)
    for _ in range(4000):
        w = list(r.choice(["achlichen", "achlich", "thtiblee", "thtibxyz"]))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choices("abchiltx", k=r.randint(0, 1))
        w = "".join(w)
        d = min(prefix_distance(t, w) for t in lex.beginnings)
        found = lex.match_any(w)
        assert (found and found[1:]) == ((d, True) if d <= 1 else None), (w, found)
    assert lex.of("aclichen") == ("achlich", 1, True) and lex.features("aclichen")[2] > 0
    # a beginning over several words leaves them in the trie, and so their misspellings are found
    counts = [(f"wertlos{e}", 30, 0) for e in ("eres", "enden", "igkeit")] + [("wertl*", 90, 1)]
    made = toxicity.choose(counts, 100, 100)
    assert set(made.words) == {"wertloseres", "wertlosenden", "wertlosigkeit"} and set(made.beginnings) == {"wertl"}
    assert made.of("wärtlösigkeit") == ("wertlosigkeit", 2, False)


def test_quotations_pair_and_quoted_hits_weigh():
    lex = toxicity.Lexicon({"idiot": 2.0}, {})
    quoted = lambda t: lex.features(t)[4] > 0
    for t in ('he says "fine" you idiot so "bye"', '"Go away," he told the idiot. "Now."', 'you idiot, the dogs’ bowl', '5" or 6" idiot 7"', '“fine” you idiot “bye”', '« oui » idiot « non »', 'don’t ‘go’ idiot, it’s', '"never closed you idiot', 'an „a“ idiot „b“'):
        assert not quoted(t) and lex.features(t)[1] == math.log1p(2), t
    for t in ('he wrote "idiot" once', 'a "long one, with many words before the idiot and with many words after it" b', '“a ‘b’ idiot”', '„du idiot“', '« un idiot »', '»ein idiot« x', '‘you don’t say, idiot’', '"a" b "an idiot"', 'a "x" 5" "idiot" y'):
        assert quoted(t) and 0 < lex.features(t)[1] < math.log1p(2), t
    one, more = (lex.features('x "' + "idiot " * n + '" y') for n in (1, 9))
    assert more[1] > one[1] and more[6] > 0
