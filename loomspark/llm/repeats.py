"""Operator 3: removal of byte strings that repeat anywhere in the corpus, by prefix-free parsing.

A byte is removed if a string of `length` bytes that covers it also starts elsewhere, in the same text or another.

Parse. A rolling hash over GRAM bytes triggers where its low bits are zero; a phrase runs from one trigger string to the
end of the next, so phrases overlap by a trigger and none is a prefix of another. The dictionary counts phrases over the
corpus. A string that repeats repeats with all phrases in it, so what holds a phrase that occurs once is out; what is
left of a text are runs between such phrases. Where text is unique, this is nearly all of the work.

Order. The runs' starts are dealt to parts by the least gram hash within the `length` bytes from a start, so equal
strings meet; consecutive starts with the same least hash travel as one segment of at most SPLIT starts. Equal segments
are one entry of a part. A part parses its distinct segments once more: ranks of all suffixes of its dictionary come
from prefix doubling over the phrases' bytes, ranks of the suffixes of its parse from prefix doubling over the phrases'
ranks, with their common prefixes. A start is then ordered by the rank of the phrase suffix it begins and, within equal
ones, by the rank of the parse suffix that follows: corpus order. A start repeats if its common prefix with a neighbour
in this order is `length` bytes at least. All of it compares bytes, not hashes. Starts of a segment that occurs twice
(equal by a 128-bit BLAKE2 digest, compared byte by byte where two of them meet in a part) repeat anyway.

Parts are sized by their bytes. A gram hash with more than HOT_BYTES of distinct segments is not gathered: its starts
are counted as rows by a 128-bit digest of their bytes.

Passages. Beside the strings of `length` bytes, strings of a number of words (runs of bytes other than white space, from the
first byte of the first to the last of the last) that another row's text has as well are counted, whatever their length in
bytes; nothing is removed for them. Those that hold a phrase that occurs once are out here, too. The rest are cut into
segments of consecutive passages with the same least gram hash; segments of two texts are equal by their digests, and where
different segments of two texts share a gram hash, their passages are compared one by one by a 128-bit digest.

A null text is the empty text. Texts shorter than `length` bytes keep all. Repeated rows are texts of their own. An empty
table gives no rows. Columns besides doc_id and text are left aside.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.batches import groups, map_batches, schema_of, small_batches, spread_join, texts_of
from loomspark.sources.workspace import written

LENGTH = 400
WORDS = 50  # words of a passage
WIDE = 32  # bytes of the grams of passages
TOGETHER = 500_000  # bytes of texts in which passages are looked for at once
GRAM = 16
TRIGGER = 64  # a trigger about every so many bytes
SPLIT = 4096  # starts in a segment: long stretches of one gram are cut, and equal cuts are one entry
PART_BYTES = 2_000_000
HOT_BYTES = 4_000_000
HOT_KEYS = 5_000  # hot keys at most, each with over 2000 rows
_ENTRY = "<QQQI"  # gram hash, name of the segment, its bytes
_ENTRY_BYTES = 28


def _mixed(x, y):
    """A 64-bit hash of two numbers of 8 bytes."""
    import numpy as np

    h = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(raw: bytes):
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    import numpy as np

    h = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(h) < GRAM:
        return h[:0]
    width = 1
    while width < 8:
        h = (h[:-width] << np.uint64(8 * width)) + h[width:]
        width *= 2
    return _mixed(h[:-8], h[8:])


def phrases(raw: bytes) -> list[tuple[int, int, int]]:
    """(hash, start, end) of each phrase."""
    import numpy as np
    import xxhash

    at = np.flatnonzero(gram_hashes(raw) % np.uint64(TRIGGER) == 0).tolist()
    view = memoryview(raw)
    return [(xxhash.xxh3_64_intdigest(view[a : b + GRAM]) - (1 << 63), a, b + GRAM) for a, b in zip(at, at[1:], strict=False)]


def sliding_least(h, k: int):
    """Least of each k consecutive values: the running least from both ends of blocks of k."""
    import numpy as np

    n = len(h) - k + 1
    full = np.full(-(-len(h) // k) * k, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(h)] = h
    blocks = full.reshape(-1, k)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[k - 1 : k - 1 + n])


def segments(raw: bytes, once: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """(start, starts in it, least gram hash) of the segments of a text; once: spans of the phrases that occur once."""
    import numpy as np

    n, out, free = len(raw), [], 0
    if n < length:
        return out
    h = None
    edges = [(-1, 0), *sorted(once), (n, n + 1)]
    for (a, _), (_, b) in zip(edges, edges[1:], strict=False):
        lo, hi = max(a + 1, free), b - 1 - length  # first and last start of a string between the two
        if hi < lo:
            continue
        free = hi + 1
        if h is None:
            h = gram_hashes(raw)
        least = sliding_least(h[lo : hi + length - GRAM + 1], length - GRAM + 1)
        cuts = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
        out += [(lo + k, min(SPLIT, y - k), int(least[x])) for x, y in zip(cuts, cuts[1:], strict=False) for k in range(x, y, SPLIT)]
    return out


def words_of(raw: bytes):
    """Where the words of a text start and end, in its bytes."""
    import numpy as np

    b = np.frombuffer(raw, np.uint8)
    word = np.r_[False, (b != 32) & (b - np.uint8(9) > 4), False]  # bytes below 9 wrap round
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def passage_segments(texts: list[bytes], once: list[list[int]], words: int) -> list[tuple[int, int, int, bytes, int]]:
    """(number of the text, first word, passages in it, name, least gram hash) of the segments of texts; once: as phrases_once() has it.

    Texts are taken together, as most of them have few passages to look at.
    """
    import numpy as np

    raw = b"\n".join(texts)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends = words_of(raw)
    n = len(starts) - words + 1
    if n < 1:
        return []
    # out are the passages over a phrase that occurs once or over the end of a text
    spans, base = np.array([s for x in once for s in x], np.int64), np.repeat(begin[:-1], [len(x) for x in once])
    lo = np.searchsorted(ends[words - 1 :], np.r_[base + (spans & 0x7FFFFFFF), begin[1:]])
    hi = np.searchsorted(starts[:n], np.r_[base + (spans >> 31), begin[1:] - 1], "right")
    some = lo < hi
    at = np.flatnonzero(np.cumsum(np.bincount(lo[some], minlength=n + 1) - np.bincount(hi[some], minlength=n + 1))[:n] == 0)
    if not len(at):
        return []
    # grams at the first words of a passage: the words from the last of these on have WIDE bytes at least
    within, new = words - WIDE // 2, at[1:] != at[:-1] + 1
    first, last = at[np.r_[True, new]], at[np.r_[new, True]] + within
    need = np.cumsum(np.bincount(first, minlength=len(starts) + 1) - np.bincount(last, minlength=len(starts) + 1)) > 0
    grams = np.ndarray(len(raw) - WIDE + 1, f"V{WIDE}", raw, 0, 1)[starts[need[:-1]]].view("<u8").reshape(-1, WIDE // 8)
    least = sliding_least(_mixed(_mixed(grams[:, 0], grams[:, 1]), _mixed(grams[:, 2], grams[:, 3])), within)[np.cumsum(need)[at] - 1]
    cuts = np.flatnonzero(np.r_[True, new | (least[1:] != least[:-1]), True])
    if (cuts[1:] - cuts[:-1]).max() > SPLIT:
        cuts = np.r_[np.concatenate([np.arange(x, y, SPLIT) for x, y in zip(cuts, cuts[1:], strict=False)]), len(at)]
    k, m = at[cuts[:-1]], cuts[1:] - cuts[:-1]
    text = np.searchsorted(begin, starts[k], "right") - 1
    names = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(starts[k].tolist(), ends[k + m + words - 2].tolist(), strict=True)]
    return list(zip(text.tolist(), (k - np.searchsorted(starts, begin)[text]).tolist(), m.tolist(), names, least[cuts[:-1]].view(np.int64).tolist(), strict=True))


def dense(keys):
    """The rank of each key among the distinct keys, from 1."""
    import numpy as np

    order = np.argsort(keys)
    ahead = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.r_[True, ahead[1:] != ahead[:-1]][: len(keys)])
    return out


def suffix_ranks(codes, left, length: int, packed: int = 1):
    """Suffix array by prefix doubling: [(width, ranks by the first `width` codes)], and the ranks by the first `length` codes.

    codes: numbers from 1; left: codes from each position to the end of its string, beyond which nothing follows (rank 0).
    packed: how many codes, of 9 bits then, the second level takes at once.
    """
    import numpy as np

    n, width, levels = len(codes), 1, [(1, codes)]
    if packed > 1:
        keys = codes.astype(np.int64)
        for k in range(1, packed):
            keys <<= 9
            keys[: max(0, n - k)] |= np.where(left[: max(0, n - k)] > k, codes[k:], 0)
        width = packed
        levels.append((width, dense(keys)))
    ranks = levels[-1][1].astype(np.int64)
    sizes = np.bincount(ranks)
    ranks = (np.cumsum(sizes) - sizes + 1)[ranks]  # from now on a rank is one more than the suffixes below it: finer ranks fit in between
    while width < length:
        step = min(width, length - width)
        # only suffixes that go on and have an equal change, with those they equal
        open_ = np.zeros(n + 2, bool)
        open_[ranks[left > width]] = True
        at = np.flatnonzero(open_[ranks] & (np.bincount(ranks, minlength=n + 2) > 1)[ranks])
        if not len(at):
            break
        then = np.where(left[at] > step, ranks[np.minimum(at + step, n - 1)], 0)
        order = np.argsort(ranks[at] << 32 | then)
        at, then = at[order], then[order]
        group, place = ranks[at], np.arange(len(at))
        new = np.r_[True, (group[1:] != group[:-1])]
        finer = new | np.r_[True, then[1:] != then[:-1]]
        ranks = ranks.copy()
        ranks[at] = group + np.maximum.accumulate(np.where(finer, place, 0)) - np.maximum.accumulate(np.where(new, place, 0))
        width += step
        levels.append((width, ranks.astype(np.int32)))
    return levels, ranks


def common(levels, a, b, left):
    """How many codes the suffixes at a and b share, up to the last level's width at least."""
    import numpy as np

    total, above = np.zeros(len(a), np.int64), 0
    inside = np.minimum(left[a], left[b])
    for width, ranks in reversed(levels):
        for _ in range(max(1, -(-above // width) - 1)):
            at = np.flatnonzero(total + width <= inside)
            at = at[ranks[a[at] + total[at]] == ranks[b[at] + total[at]]]
            total[at] += width
        above = width
    return total


class Order:
    """Corpus order of the starts of some strings, from the suffix arrays of their dictionary and parse."""

    def __init__(self, strings: list[bytes], length: int):
        import numpy as np

        raw = b"".join(strings)
        lens = np.array([len(p) for p in strings], np.int64)
        ends = np.cumsum(lens)
        # parse: a phrase begins where a string does or where a trigger lies within it
        trigger = np.flatnonzero(gram_hashes(raw) % np.uint64(TRIGGER) == 0)
        trigger = trigger[trigger + GRAM <= ends[np.searchsorted(ends, trigger, "right")]] if len(trigger) else trigger
        self.cut = cut = np.union1d(ends - lens, trigger).astype(np.int64)
        string = np.searchsorted(ends, cut, "right")
        last = np.r_[string[1:] != string[:-1], True]
        end = np.where(last, ends[string], np.r_[cut[1:], 0] + GRAM)
        # dictionary: distinct phrases one after another
        known: dict[bytes, int] = {}
        phrase = np.array([known.setdefault(raw[x:y], len(known)) for x, y in zip(cut.tolist(), end.tolist(), strict=True)], np.int64)
        sizes = np.array([len(p) for p in known], np.int64)
        first = np.cumsum(sizes) - sizes
        left = np.repeat(first + sizes, sizes) - np.arange(int(sizes.sum()))
        codes = np.frombuffer(b"".join(known), np.uint8).astype(np.int16) + 1
        words, alpha = suffix_ranks(codes, left, length, 7)
        # parse: each phrase has at least one byte of its own, so `length` phrases are enough
        left_in_parse = np.searchsorted(string, string, "right") - np.arange(len(cut))
        # by `length` bytes behind the first trigger, too: phrases of one rank that differ have that many bytes of their own
        further = np.where(sizes > GRAM, alpha[np.minimum(first + GRAM, len(alpha) - 1)], 0)
        symbols = dense(alpha[first] << 32 | further) if len(first) else further
        parse, rank = suffix_ranks(symbols[phrase], left_in_parse, length)
        array = np.argsort(rank, kind="stable")
        x, y = array[:-1], array[1:]
        shared = common(parse, x, y, left_in_parse)
        far_x, far_y = x + shared, y + shared
        over = (shared >= left_in_parse[x]) | (shared >= left_in_parse[y])
        at_x, at_y = np.minimum(far_x, len(cut) - 1), np.minimum(far_y, len(cut) - 1)
        tail = common(words, first[phrase[at_x]], first[phrase[at_y]], left)
        prefix = np.where(over, np.minimum(ends[string[x]] - cut[x], ends[string[y]] - cut[y]), cut[at_x] - cut[x] + tail)
        prefix[rank[x] == rank[y]] = length
        # starts: the phrase suffix that begins there, then the parse suffix behind it
        self.starts = starts = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)] or [np.zeros(0, np.int64)])
        j = np.searchsorted(cut, starts, "right") - 1
        place = first[phrase[j]] + starts - cut[j]
        alphas = alpha[place]
        behind = np.where(last[j], 0, np.searchsorted(rank[array], np.r_[rank[1:], 0][j]) + 1)  # place of the first of equal ranks
        order = np.argsort(alphas << 32 | behind)
        self.order, self.length = order, length
        size, behind, alphas = left[place][order], behind[order], alphas[order]
        lo, hi = behind[:-1], behind[1:]
        least = _least_between(prefix, lo, hi)
        self.shared = np.where(alphas[:-1] != alphas[1:], 0, np.where((size[:-1] >= length) | (lo == hi), length, size[:-1] - GRAM + least))

    def repeated(self):
        """For each start, in text order, whether its string also starts elsewhere."""
        import numpy as np

        same, hit = self.shared >= self.length, np.zeros(len(self.order), bool)
        hit[self.order[:-1][same]] = True
        hit[self.order[1:][same]] = True
        return hit


def _least_between(values, lo, hi):
    """Least of values[lo - 1 : hi - 1] for places lo < hi from 1 (0 where a place is 0 or lo = hi), by a table of runs of powers of two."""
    import numpy as np

    out = np.zeros(len(lo), np.int64)
    ask = np.flatnonzero((lo > 0) & (lo < hi))
    a, b = lo[ask] - 1, hi[ask] - 1
    power = np.frexp((b - a).astype(np.float64))[1] - 1  # the greatest power of two within b - a
    table, k = values, 0
    while len(ask) and k <= int(power.max()):
        now = power == k
        out[ask[now]] = np.minimum(table[a[now]], table[b[now] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1
    return out


def repeated_starts(parts: dict, length: int) -> dict:
    """name -> ranges (first, one after the last, flat) of starts whose string also starts elsewhere among distinct segments."""
    import numpy as np

    names = list(parts)
    first = np.cumsum([0, *(len(p) - length + 1 for p in parts.values())])
    hit = Order(list(parts.values()), length).repeated()
    out = {}
    for k in np.unique(np.searchsorted(first, np.flatnonzero(hit), "right") - 1).tolist():
        x = np.r_[False, hit[first[k] : first[k + 1]], False]
        out[names[k]] = np.flatnonzero(x[1:] != x[:-1]).tolist()
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shortest(length: int, words: int) -> int:
    """Bytes of the shortest text that may repeat something."""
    return min(length, 2 * words - 1) if words else length


def stored(documents: DataFrame) -> DataFrame:
    """uid, doc_id, n and the compressed bytes of each text, in a written table."""

    def start():
        import zstandard

        pack = zstandard.ZstdCompressor(3).compress

        def f(ids, texts):
            raw = [t.encode() for t in texts]
            return [ids, [len(r) for r in raw], [pack(r) for r in raw]]

        return f

    made = map_batches(texts_of(documents), start, "doc_id long, n long, body binary")
    return written(made.withColumn("uid", F.monotonically_increasing_id()), "texts")


def phrases_once(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """uid, once: the spans (start * 2^31 + end) of the phrases of a text that occur once in the texts of `length` bytes at least."""

    def start():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def f(uids, bodies):
            got = [(h, uid, a << 31 | b) for uid, body in zip(uids, bodies, strict=True) for h, a, b in phrases(unpack(body))]
            return list(zip(*got, strict=True)) if got else None

        return f

    rows = map_batches(texts.where(F.col("n") >= length).select("uid", "body"), start, "h long, uid long, span long")
    alone = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid"), F.min("span").alias("span")).where("c = 1")
    return alone.groupBy("uid").agg(F.collect_list("span").alias("once"))  # a text's own phrases


def cut(texts: DataFrame, once: DataFrame, length: int, parts: int, words: int = 0) -> DataFrame:
    """The segments of all texts, in a written table: uid, start, count, g1, g2 (name), and a task's distinct segments by part, compressed.

    A row has either a segment's place or, at the end of a task, a part (number, gram hashes, body). With words, segments of
    passages have places, too: start is the first word, least their gram hash.
    """
    out = schema_of("uid long, start long, count long, g1 long, g2 long, least long, part int, body binary")

    def run(batches):
        import zstandard

        unpack, seen, held, size = zstandard.ZstdDecompressor().decompress, set(), defaultdict(list), 0

        def packed():
            pack = zstandard.ZstdCompressor(3).compress
            for part, entries in sorted(held.items()):
                none = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, none, none, pa.array([part], pa.int32()), pa.array([pack(b"".join(entries))], pa.binary())], names=out.names)
            held.clear()

        for uids, bodies, spans in groups(batches, 1):
            rows, held_back, waits = [], [], 0
            for k, (uid, body, bad) in enumerate(zip(uids, bodies, spans, strict=True)):
                raw = unpack(body)
                if words:
                    held_back.append((uid, raw, bad or ()))
                    waits += len(raw)
                    if waits > TOGETHER or k == len(uids) - 1:
                        own, raws, alone = zip(*held_back, strict=True)
                        rows += [(own[q], first, m, *struct.unpack("<qq", name), least) for q, first, m, name, least in passage_segments(raws, alone, words)]
                        held_back, waits = [], 0
                for lo, m, least in segments(raw, [(s >> 31, s & 0x7FFFFFFF) for s in bad or ()], length):
                    piece = raw[lo : lo + m + length - 1]
                    name = int.from_bytes(hashlib.blake2b(piece, digest_size=16).digest(), "big")
                    g1, g2 = name >> 64, name & (1 << 64) - 1
                    rows.append((uid, lo, m, _signed(g1), _signed(g2), None))
                    if name not in seen:
                        seen.add(name)
                        held[least % parts].append(struct.pack(_ENTRY, least, g1, g2, len(piece)) + piece)
                        size += len(piece)
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=out.names)
            if size > 60_000_000:
                yield from packed()
                seen, size = set(), 0
        yield from packed()

    both = texts.where(F.col("n") >= shortest(length, words)).join(once, "uid", "left").select("uid", "body", "once")
    return written(small_batches(both).mapInArrow(run, out), "segments")


def _entries(body: bytes):
    at = 0
    while at < len(body):
        least, g1, g2, n = struct.unpack_from(_ENTRY, body, at)
        at += _ENTRY_BYTES
        yield least, (g1, g2), body[at : at + n]
        at += n


def repeats_in_parts(bodies: DataFrame, length: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(g1, g2, ranges) of the segments with starts that repeat among distinct segments, and the starts of hot gram hashes as rows."""
    out = schema_of("g1 long, g2 long, ranges array<int>, k1 long, k2 long, at int")
    dealt = bodies.repartition(parts, "part").sortWithinPartitions("part")

    def run(batches):
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        now, entries, sizes, hot = None, defaultdict(dict), defaultdict(int), set()

        def rows(segs):
            for name, piece in segs.items():
                n = len(piece) - length + 1
                h1, h2 = np.frombuffer(b"".join(hashlib.blake2b(piece[i : i + length], digest_size=16).digest() for i in range(n)), "<u8").reshape(n, 2).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array([_signed(name[0])] * n), pa.array([_signed(name[1])] * n), pa.nulls(n, pa.list_(pa.int32())), pa.array(h1.view("i8")), pa.array(h2.view("i8")), pa.array(range(n), pa.int32())], names=out.names)

        def done():
            together, size = {}, 0
            for least, segs in entries.items():
                together |= segs
                size += sizes[least]
                if size > PART_BYTES:
                    yield from told(together)
                    together, size = {}, 0
            if together:
                yield from told(together)
            entries.clear()
            sizes.clear()
            hot.clear()

        def told(segs):
            found = repeated_starts(segs, length)
            if found:
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([_signed(k[0]) for k in found]), pa.array([_signed(k[1]) for k in found]), pa.array(list(found.values()), pa.list_(pa.int32())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=out.names)

        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and now is not None:
                    yield from done()
                now = part
                for least, name, piece in _entries(unpack(body.as_py())):
                    if least in hot:
                        yield from rows({name: piece})
                    elif name not in entries[least]:
                        entries[least][name] = piece
                        sizes[least] += len(piece)
                        if sizes[least] > HOT_BYTES:
                            hot.add(least)
                            yield from rows(entries.pop(least))
                    elif entries[least][name] != piece:
                        raise ValueError("two segments have one digest")
        if now is not None:
            yield from done()

    made = written(dealt.mapInArrow(run, out), "repeats")
    return made.where("ranges is not null").select("g1", "g2", "ranges"), made.where("k1 is not null").select("g1", "g2", "k1", "k2", "at")


def shared_passages(segs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """uid, n_shared: how many passages of a text another text has, too, of the texts that have any. segs: the segments of passages."""
    name, ends, one = ["g1", "g2"], [F.min("uid").alias("lo"), F.max("uid").alias("hi")], F.count(F.lit(1))
    # least and count are the same for equal segments; uid and start are of one of them
    firsts = [F.first(c).alias(c) for c in ("least", "count", "uid", "start")]
    named = written(segs.groupBy(*name).agg(*ends, *firsts, one.alias("places")), "passages")
    bound = max(2000, (named.agg(F.sum("places")).first()[0] or 0) // HOT_KEYS)

    def joined(rows, side, key, size):
        if side.where(F.col(size) > bound).isEmpty():
            return rows.join(side.drop(size).hint("merge"), key)
        return spread_join(rows, side, key, size, bound)

    whole = joined(segs.select("uid", "count", *name), named.where("lo < hi").select(*name, "places"), name, "places")
    # what one text alone has as a whole segment meets one of each of the other segments with its gram hash
    mixed = named.groupBy("least").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.bool_or(F.col("lo") == F.col("hi")).alias("open"), one.alias("size"))
    some = joined(named, written(mixed.where("a < b and open and size > 1").select("least", "size"), "mixed"), "least", "size")
    known = F.col("lo") < F.col("hi")
    todo = some.groupBy("uid").agg(F.collect_list(F.struct("start", "count", known.alias("known"), "places")).alias("todo"))  # a text's own segments

    def start():
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def f(uids, bodies, todos):
            names, whose, known, times = [], [], [], []
            for uid, body, ask in zip(uids, bodies, todos, strict=True):
                raw = unpack(body)
                starts, ends = (x.tolist() for x in words_of(raw))
                for s in ask:
                    k, n = s["start"], s["count"]
                    names += [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(starts[k : k + n], ends[k + words - 1 : k + words - 1 + n], strict=True)]
                    whose += [uid] * n
                    known += [s["known"]] * n
                    times += [s["places"]] * n
            return [whose, *np.frombuffer(b"".join(names), np.int64).reshape(-1, 2).T.copy(), known, times]

        return f

    each = written(map_batches(texts.select("uid", "body").join(todo, "uid"), start, "uid long, k1 long, k2 long, known boolean, count long"), "each")
    twice = each.groupBy("k1", "k2").agg(*ends, F.bool_or("known").alias("known"), one.alias("size")).where("(lo < hi or known) and size > 1")
    parts = joined(each.where("not known").select("uid", "count", "k1", "k2"), written(twice.select("k1", "k2", "size"), "twice"), ["k1", "k2"], "size")
    return whole.select("uid", "count").unionByName(parts.select("uid", "count")).groupBy("uid").agg(F.sum("count").alias("n_shared"))


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans, joined where they touch, under the strings from the given ranges of starts."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [(a, b) for a, b in out]


def without_repeats(documents: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte spans, flat) and kept (the bytes that stay) of every row.

    With words (17 at least), n_shared as well: how many passages of so many words another row's text has, too.
    """
    texts = stored(documents)
    total = texts.agg(F.sum("n")).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) * 3 // PART_BYTES)
    segs = cut(texts, phrases_once(texts, shortest(length, words)), length, parts, words)
    places = segs.where("uid is not null and least is null").select("uid", "start", "count", "g1", "g2")
    ranges, rows = repeats_in_parts(segs.where("part is not null").select("part", "body"), length, parts)
    if not rows.isEmpty():
        twice = rows.distinct().groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
        hot = rows.distinct().join(twice, ["k1", "k2"]).groupBy("g1", "g2").agg(F.flatten(F.collect_set(F.array("at", F.col("at") + 1))).alias("ranges"))
        ranges = ranges.unionByName(hot)
    often = places.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("places")).where("places > 1")
    named = often.join(ranges, ["g1", "g2"], "full").select("g1", "g2", F.when(F.col("places") > 1, F.lit(None)).otherwise(F.col("ranges")).alias("ranges"))
    hits = places.join(named, ["g1", "g2"]).select("uid", "start", F.coalesce("ranges", F.array(F.lit(0), F.col("count").cast("int"))).alias("ranges"))
    by_text = hits.groupBy("uid").agg(F.collect_list(F.struct("start", "ranges")).alias("hits"))  # a text's own segments

    shared = shared_passages(segs.where("least is not null").drop("part", "body"), texts, words) if words else None

    def start():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def f(ids, n, bodies, found, *more):
            spans, kept = [], []
            for body, hs in zip(bodies, found, strict=True):
                raw = unpack(body)
                gone = covered([(h["start"] + a, h["start"] + b) for h in hs or () for a, b in zip(h["ranges"][::2], h["ranges"][1::2], strict=True)], length)
                at, left = 0, []
                for a, b in gone:
                    left.append(raw[at:a])
                    at = b
                spans.append([x for s in gone for x in s])
                kept.append(b"".join([*left, raw[at:]]) if gone else raw)
            return [ids, n, spans, kept, *more]

        return f

    both = texts.join(by_text, "uid", "left")
    if words:
        both = both.join(shared, "uid", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    both = both.select("doc_id", "n", "body", "hits", *["n_shared"] * bool(words))
    return map_batches(both, start, "doc_id long, n_bytes long, spans array<long>, kept binary" + ", n_shared long" * bool(words), text=2)


def digest(documents: DataFrame, words: int = 0) -> DataFrame:
    """The query's columns; with words, n_shared after them."""
    made = without_repeats(documents, words=words)
    ends = F.expr("aggregate(spans, 0L, (s, x) -> x - s)")  # alternating sum: removed bytes
    return made.select("doc_id", "n_bytes", ends.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *["n_shared"] * bool(words))
