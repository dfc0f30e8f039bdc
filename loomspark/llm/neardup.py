"""Operator 7: near-duplicate groups by min-max hashing.

A text, with A-Z in lower case, is cut into words at the characters U+0020 and U+0009 to U+000D; its set holds the
distinct shingles of `words` words, or its whole sequence if it has fewer. Under each of PERMUTATIONS permutations both
the least and the greatest hash of the set are kept, so each evaluation gives two signature values; BANDS bands of ROWS
values make the buckets, half of them of minima, half of maxima. Two sets of similarity 0.8 miss each other with
probability (1 - 0.8^ROWS)^BANDS, about 1 in 7000, at 0.85 1 in 4 million, and groups usually have many ways to be joined.

Equal sets are one class from the start: classes, not documents, meet in buckets. In a bucket the member with most
company is the hub; hubs are compared with the members first, components are formed, and only members that lie in
different components after that are compared, those outside a bucket's largest component with the others, so a large
group of copies costs about one comparison a member. Buckets with many members are told by a count of one in SAMPLED
sets (which decides where rows are joined, not what is found); their rows stay where they are and what they are joined
with is broadcast. Every link is confirmed on the full sets (64-bit shingle hashes). Components are found by rounds of large and
small stars over written tables.

A null or empty text, or one without words, has an empty set and is linked with nothing. component_id is the smallest
doc_id reachable. Rows that repeat a doc_id are rows of their own; a row without doc_id links others but gives no
component_id (a group of such rows alone has a null one). An empty table gives no rows. Other columns are left aside.
keep() returns all of them, whatever their names; one row of each group stays, that with the smallest doc_id (null after
all others), and the first of several.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import batches
from loomspark.llm.batches import carried, groups, map_batches, schema_of, side_join, side_of, small_batches, texts_of
from loomspark.sources.workspace import forget, written

PERMUTATIONS = 192
ROWS = 8
BANDS = 2 * PERMUTATIONS // ROWS
SIMILAR = (80, 100)  # 100 * intersection >= 80 * union
#: Members of a hub that one group of rows compares; a hub with more is dealt over several, and its words are read for each.
MEMBERS_AT_ONCE = 64
#: Members of a bucket that one group of rows holds in the last turn.
DEALT_AT_ONCE = 256
SAMPLED = 64
#: Keys that are joined by a broadcast, at most.
HOT_KEYS = 50_000
RARE = 4
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z and the six blanks


def shingles(words: list[bytes], k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    import numpy as np
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    m = len(words) - n + 1  # words in a shingle: k, or all there are
    out = np.full(n, m, np.uint64)
    for j in range(m):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(_MULTIPLIERS[j % 8]) + h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(1)
def _permutations():
    import numpy as np

    g = np.random.Generator(np.random.PCG64(7))
    return g.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1), g.integers(0, 1 << 32, PERMUTATIONS, np.uint32)


def bands(shingle_set) -> list[int]:
    """The bucket keys of a set that isn't empty."""
    import numpy as np
    import xxhash

    a, b = _permutations()
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    s = (shingle_set >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(s), 256):
        v = s[lo : lo + 256, None] * a
        v += b
        np.minimum(low, v.min(0), out=low)
        np.maximum(high, v.max(0), out=high)
    out = []
    for values in (low, high):
        raw = values.tobytes()
        out += [xxhash.xxh3_64_intdigest(raw[i : i + 4 * ROWS], seed=len(out) + 1 + i) - (1 << 63) for i in range(0, len(raw), 4 * ROWS)]
    return out


def similar(a, b) -> bool:
    import numpy as np

    small, large = min(len(a), len(b)), max(len(a), len(b))
    if SIMILAR[1] * small < SIMILAR[0] * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (small + large - both)


def text_mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).cast("string")


def sets_of(documents: DataFrame, k: int) -> DataFrame:
    """A written table with a row for each document: uid, doc_id, n, s1 and s2 (128 bits that name the set), bands, the words, compressed, and a hash of the text."""

    def start():
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(1).compress

        def f(ids, texts, marks):
            out = [[] for _ in range(6)]
            for key, t in zip(ids, texts, strict=True):
                words = words_of(t)
                s = shingles(words, k)
                name = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                row = (key, len(s), None, None, None, None) if name is None else (key, len(s), (name >> 64) - (1 << 63), (name & (1 << 64) - 1) - (1 << 63), bands(s), pack(b" ".join(words)))
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            return [*out, marks]

        return f

    rows = texts_of(documents).withColumn("mark", text_mark())
    made = map_batches(rows, start, "doc_id long, n long, s1 long, s2 long, bands array<long>, words binary, mark string")
    return written(made.withColumn("uid", F.monotonically_increasing_id()), "sets")


def confirmed(pairs: DataFrame, core: DataFrame, k: int) -> DataFrame:
    """Of pairs (hub, uid) those whose sets are similar.

    Each hub's words are read once for every MEMBERS_AT_ONCE members, which follow them in the same partition.
    """
    many = written(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_AT_ONCE).cast("int").alias("parts")), "many")
    dealt = pairs.join(side_of(many.where("parts > 1")), "hub", "left")
    member = dealt.select("hub", F.pmod(F.xxhash64("uid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "uid", F.col("uid").alias("key"))
    hub = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("uid"), F.col("hub").alias("key"))
    words = core.select(F.col("uid").alias("key"), "words")
    both = hub.unionByName(member).join(words, "key").drop("key").repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("uid").asc_nulls_first())
    out = schema_of("hub long, uid long")

    def run(batches):
        import zstandard

        unpack, at, own = zstandard.ZstdDecompressor().decompress, None, None
        for hubs, parts, uids, blobs in groups(batches, 3):
            found = []
            for h, p, u, blob in zip(hubs, parts, uids, blobs, strict=True):
                s = shingles(unpack(blob).split(b" "), k)
                if u is None:
                    at, own = (h, p), s
                elif at == (h, p) and similar(own, s):
                    found.append((h, u))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], names=["hub", "uid"])

    return small_batches(both).mapInArrow(run, out)


def components(links: DataFrame) -> DataFrame:
    """uid, comp (the least uid that is reachable) of all ends of the links (a, b), by large and small stars in turn.

    links, a union of written tables, may repeat edges and turn them round. A round has two shuffles, one for each star's least
    neighbours; the edges become no more by it. It ends when every node with a lesser neighbour has no other: then each
    component is a star around its least node.
    """
    edges, made = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), (F.min("b") < F.max("b")).alias("several"), F.count(F.lit(1)).alias("size"))
        least = written(least, "least")
        found = least.agg(F.count_if(F.expr("m < a and several")).alias("open"), F.sum("size").alias("ends")).first()
        if not found["open"]:
            forget(made)
            return least.select(F.col("a").alias("uid"), F.col("m").alias("comp"))
        bound = max(256, found["ends"] // 2 // HOT_KEYS)
        # large star: neighbours above a node go to the least of its neighbourhood
        above = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = written(side_join(above, least.drop("several"), "a", "size", bound).select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        # small star: a node and its lesser neighbours go to the least of them
        lower = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")), "lower")
        others = side_join(large, lower, "a", "size", bound).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(others.unionByName(lower.select("a", F.col("m").alias("b"))), "small")
        forget(made, least, large, lower)
        made = edges


def rare(core: DataFrame, uids: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(uid, own) and (hub, uid, both) over the shingles that at most RARE of these sets hold: how many of them a set has, and a pair shares."""

    def start():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def f(ids, blobs):
            import numpy as np

            got = [shingles(unpack(b).split(b" "), k) for b in blobs]
            return [np.concatenate(got).view(np.int64).tolist(), np.repeat(np.array(ids, np.int64), [len(g) for g in got]).tolist()]

        return f

    rows = written(map_batches(core.join(side_of(uids), "uid", "left_semi").select("uid", "words"), start, "shingle long, uid long"), "shingles")
    few = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= RARE)
    held = written(rows.join(few, "shingle"), "rare")
    sets = held.where("c > 1").groupBy("shingle").agg(F.collect_list("uid").alias("u"))  # RARE at most
    pairs = sets.select("u", F.explode("u").alias("hub")).select("hub", F.explode("u").alias("uid")).where("hub > uid")
    return held.groupBy("uid").agg(F.count(F.lit(1)).alias("own")), pairs.groupBy("hub", "uid").agg(F.count(F.lit(1)).alias("both"))


def links_of(sets: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """uid, comp of the classes' first members that are linked with another class.

    Before members of different components are compared in the last turn, a bound leaves out what can't be similar. Pairs
    that share a rare shingle are found by it, with how many they share; any others share none of their rare ones.
    """
    again = written(sets.join(side_of(classes.where("rows > 1").select("s1", "s2", "rep")), ["s1", "s2"]).where("uid <> rep").select("uid"), "again")
    first = sets.where("n > 0").join(side_of(again), "uid", "left_anti")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = first.select("uid", "n", F.explode("bands").alias("band"))
    some = written(first.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLED)) == 0).select("bands"), "some")
    hot = some.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("c"))
    hot = written(hot.where(F.col("c") >= max(8, some.count() * BANDS // HOT_KEYS)).select("band"), "hot")  # HOT_KEYS at most
    in_hot = keys.join(F.broadcast(hot), "band")
    in_hot = in_hot.join(F.broadcast(in_hot.groupBy("band").agg(F.count(F.lit(1)).alias("size"))), "band")
    other = keys.join(F.broadcast(hot), "band", "left_anti").repartition(parts, "band")  # dealt out once for both uses
    shared = other.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    in_shared = written(in_hot.unionByName(other.join(shared.hint("merge"), "band")), "shared")
    bound = max(256, in_shared.count() // HOT_KEYS)
    company = in_shared.groupBy("uid").agg(F.sum("size").alias("company"))
    members = written(in_shared.select("band", "uid", "n").join(company, "uid"), "members")
    # the list of sets grows with the corpus at every size, so it is never broadcast
    core = written(sets.select("uid", "words").join(company.select("uid").hint("merge"), "uid", "left_semi"), "core")
    fits = (F.lit(SIMILAR[1]) * F.least("hub_n", "n") >= F.lit(SIMILAR[0]) * F.greatest("hub_n", "n")) & (F.col("hub") != F.col("uid"))

    def hubs(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("band").agg(F.max_by(F.struct("uid", "n", "comp"), F.struct("company", -F.col("uid"))).alias("h"), F.count(F.lit(1)).alias("size"))
        return written(best.select("band", F.col("h.uid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.comp").alias("hub_comp"), "size"), "hubs")

    rows, comps, tested = members.withColumn("comp", F.col("uid")), None, None
    for turn in range(3):
        if turn < 2:
            pairs = side_join(rows, hubs(rows), "band", "size", bound).where(fits & (F.col("comp") != F.col("hub_comp")))
        else:
            # uid, n, comp and bands, BANDS at most, of each member
            every = written(rows.groupBy("uid").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_list("band").alias("bands")), "every")
            own, meet = rare(core, every.select("uid"), k)
            every = written(every.join(own, "uid", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own"), "every")
            # members outside the largest component of a bucket meet the others; a bucket's members are dealt over several tasks
            held = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
            largest = held.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.sum("c").alias("size"))
            largest = written(largest.withColumn("deals", F.ceil(F.col("size") / DEALT_AT_ONCE).cast("int")), "largest")
            mine = side_join(rows.select("band", "uid"), largest, "band", "size", bound).withColumn("deal", F.pmod(F.xxhash64("uid"), F.col("deals")).cast("int"))
            mine = written(mine.join(every, "uid"), "mine")
            other = mine.where("comp <> big").select("band", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("uid").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), F.col("most").alias("hub_most"), F.col("bands").alias("hub_bands"))
            here = F.array_min(F.array_intersect("bands", "hub_bands")) == F.col("band")  # a pair counts in one of its buckets
            can = F.lit(SIMILAR[0] + SIMILAR[1]) * (F.least("most", "hub_most") + F.col("both")) >= F.lit(SIMILAR[0]) * (F.col("n") + F.col("hub_n"))
            once = ((F.col("comp") == F.col("big")) | (F.col("comp") < F.col("hub_comp"))) & (F.col("comp") != F.col("hub_comp"))
            pairs = mine.withColumn("both", F.lit(0)).join(other.hint("shuffle_hash"), ["band", "deal"]).where(fits & can & once & here)
            one = every.drop("bands")
            ends = one.select(F.col("uid").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), F.col("most").alias("hub_most"))
            rest = meet.join(side_of(one), "uid").join(side_of(ends), "hub").where(fits & can & (F.col("comp") != F.col("hub_comp")))
            pairs = pairs.select("hub", "uid").unionByName(rest.select("hub", "uid"))
        pairs = pairs.select("hub", "uid").distinct()
        if tested is not None:
            pairs = pairs.join(side_of(tested), ["hub", "uid"], "left_anti")
        pairs = written(pairs, "pairs")
        if turn and pairs.isEmpty():
            continue
        found = written(confirmed(pairs, core, k), "links")
        both = pairs.unionByName(pairs.select(F.col("uid").alias("hub"), F.col("hub").alias("uid")))
        tested = both if tested is None else tested.unionByName(both)
        if turn and found.isEmpty():
            continue
        edge = found.select(F.col("hub").alias("a"), F.col("uid").alias("b"))
        comps = components(edge if comps is None else edge.unionByName(comps.select(F.col("uid").alias("a"), F.col("comp").alias("b"))))
        if turn < 2:  # buckets that still hold several components
            rows = members.join(side_of(comps), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
            open_ = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("band", "size")
            rows = written(side_join(rows, written(open_, "bands"), "band", "size", bound), "open")
    return comps


def judged(documents: DataFrame, k: int = 5) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, mark (a hash of its text), comp (null if it is alone) and uid."""
    sets = sets_of(documents, k)
    classes = written(sets.where("n > 0").groupBy("s1", "s2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("rows")), "classes")
    comps = links_of(sets, classes, k)
    # classes of one document that aren't linked need no row here
    linked = written(classes.join(side_of(comps.withColumnRenamed("uid", "rep")), "rep", "left").where("rows > 1 or comp is not null"), "linked")
    bound = max(256, sets.count() // HOT_KEYS)
    least = written(linked.where("comp is not null").groupBy("comp").agg(F.min("lo").alias("component"), F.count(F.lit(1)).alias("classes")), "least")
    tied = side_join(linked.where("comp is not null"), least, "comp", "classes", bound).select("s1", "s2", "component", "comp", F.col("rows").alias("size"))
    alone = linked.where("comp is null").select("s1", "s2", F.col("lo").alias("component"), F.col("rep").alias("comp"), F.col("rows").alias("size"))
    named = written(tied.unionByName(alone), "named")
    rows = sets.select("doc_id", "n", "s1", "s2", "mark", "uid")
    if batches.fits_in(named, batches.SIDE_BYTES):
        told = rows.join(F.broadcast(named.drop("size")), ["s1", "s2"], "left")
    else:
        many = named.where(F.col("size") > bound)  # HOT_KEYS at most
        keys = F.struct("s1", "s2")
        hot = rows.withColumn("set", keys).join(F.broadcast(many.select(keys.alias("set"), "component", "comp")), "set").drop("set")
        other = rows.join(F.broadcast(many.select("s1", "s2")), ["s1", "s2"], "left_anti").join(named.where(F.col("size") <= bound).drop("size").hint("merge"), ["s1", "s2"], "left")
        told = hot.unionByName(other)
    component = F.when(F.col("comp").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "mark", "comp", "uid")


def group(documents: DataFrame, k: int = 5) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept."""
    return judged(documents, k).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(documents: DataFrame, k: int = 5) -> DataFrame:
    """The rows of documents that stay, one of each group; all columns, in order."""
    rows = written(judged(documents, k), "judged")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(order)["uid"].alias("uid"))
    stays = rows.where("comp is null").unionByName(rows.join(first.select("uid"), "uid", "left_semi").select(rows.columns)).select("uid").withColumn("stays", F.lit(True))
    told = rows.select("uid", "doc_id", "mark").join(stays, "uid", "left").select("doc_id", "mark", F.coalesce("stays", F.lit(False)).alias("stays"))
    return carried(documents, written(told, "told"), text_mark())
