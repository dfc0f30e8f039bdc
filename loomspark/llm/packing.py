"""Operator 6: best-fit decreasing packing of tokenised documents into windows.

A document longer than the window is first cut into full windows; what remains is packed whole. Best-fit decreasing
puts each remainder, longest first, into the open window with the least room that still takes it. Its decisions depend
on lengths alone, so plan() runs it on the histogram of lengths: windows that have equal room are handled as runs, and a
segment tree indexed by room finds the tightest. The plan's size follows the window, not the documents. Documents
look up their place by their rank among those of their length; ranks are made within salts, whose sizes the histogram
has, so no task holds all documents of a length, and the driver gets one row for each length.

Best fit decides for all windows but the few that stay open with more than MAX_GAP tokens of room (and whose fill isn't a
power of two): these are laid end to end and cut anew into full windows, the last of them into powers of two, which take
no padding.

A null text is the empty text (its end id alone is packed). Repeated rows are packed each. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.batches import map_batches, texts_of
from loomspark.llm.tokenize import rank_encoder
from loomspark.sources.workspace import written

WINDOW = 1024
ROWS_PER_SALT = 5_000
#: A sixteenth of a window. At sf0.1 0.01 % of the tokens are padding then, at sf0.01 (456 windows) 0.13 %.
MAX_GAP = 64


class Tightest:
    """Segment tree over room 0..n: the least room of at least k that has an open window."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, k: int, on: bool) -> None:
        k += self.size
        self.any[k] = on
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def at_least(self, k: int) -> int | None:
        k += self.size
        if self.any[k]:
            return k - self.size
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW, max_gap: int = MAX_GAP) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], int, int]:
    """Places for remainders by length.

    Returns (moves, loose, windows, pooled): moves (length, first rank, first window, offset, how many to a window), in
    ascending order of length and rank, one for each run of ranks that goes to windows in order; loose (first window, one after the last,
    fill, start in the pool) of the windows to cut anew; how many windows there are, and the tokens of the pool.
    """
    tree, open_at, moves, windows = Tightest(window), defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                room, per = window, window // length
                lo, n = windows, -(-left // per)
                windows += n
            else:
                lo, hi = open_at[room].pop()
                per = room // length
                n = min(-(-left // per), hi - lo)
                if n < hi - lo:
                    open_at[room].append((lo + n, hi))
                if not open_at[room]:
                    tree.set(room, False)
            # having taken one, a window is the tightest for the next of this length, as long as it takes it
            put = min(left, n * per)
            moves.append((length, rank, lo, window - room, per))
            filled, rest = divmod(put, per)
            for first, after, room_left in ((lo, lo + filled, room - per * length), (lo + filled, lo + n, room - rest * length)):
                if first < after and room_left:
                    open_at[room_left].append((first, after))
                    tree.set(room_left, True)
            left -= put
            rank += put
    loose, pooled = [], 0
    for room in sorted(open_at):
        fill = window - room
        if room > max_gap and fill & (fill - 1):
            for lo, hi in sorted(open_at[room]):
                loose.append((lo, hi, fill, pooled))
                pooled += (hi - lo) * fill
    return sorted(moves), sorted(loose), windows, pooled


def bounds(pooled: int, window: int) -> tuple[int, list[int]]:
    """How many full windows the pool has, and where its rest is cut into powers of two."""
    full, at, cuts = pooled // window, pooled // window * window, []
    rest = pooled - at
    while rest:
        cuts.append(at)
        part = 1 << (rest.bit_length() - 1)
        at, rest = at + part, rest - part
    return full, cuts


def tokenised(documents: DataFrame, path: str, ranks: str, pattern: str, end_id: int = 0) -> DataFrame:
    """uid, doc_id, n, ids (unsigned 16-bit, little-endian; the vocabulary has less than 65536) in a written table."""
    import numpy as np

    def start():
        enc = rank_encoder(path, ranks, pattern)

        def f(doc, texts):
            got = [np.array([*e, end_id], "<u2") for e in enc.encode(texts)]
            return [doc, [len(g) for g in got], [g.tobytes() for g in got]]

        return f

    made = map_batches(texts_of(documents), start, "doc_id long, n long, ids binary")
    return written(made.withColumn("uid", F.monotonically_increasing_id()), "tokens")


def pack(tokens: DataFrame, window: int = WINDOW, max_gap: int = MAX_GAP) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 16-bit). tokens: a written table of tokenised()."""
    import numpy as np

    spark = tokens.sparkSession
    rows = tokens.count()
    salts = max(1, rows // ROWS_PER_SALT)
    small = tokens.select("uid", "n", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"), (F.col("n") % window).cast("int").alias("r"), F.floor(F.col("n") / window).alias("full"))
    # ranks within (length, salt), then what lies before each salt of a length; the driver gets a row for each length
    sizes = written(small.groupBy("r", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum("full").alias("full")), "sizes")
    histogram, full_base, fulls = {}, [], 0
    for x in sorted(sizes.groupBy("r").agg(F.sum("rows").alias("rows"), F.sum("full").alias("full")).collect()):
        full_base.append((x["r"], fulls))
        fulls += x["full"]
        if x["r"]:
            histogram[x["r"]] = x["rows"]
    moves, loose, windows, pooled = plan(histogram, window, max_gap)
    full, cuts = bounds(pooled, window)
    earlier = Window.partitionBy("r").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("r", "salt", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rank_base"), F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("salt_full"))
    bases = F.broadcast(spark.createDataFrame(full_base, "r int, length_full long"))  # as many rows as the window has lengths
    order = Window.partitionBy("r", "salt").orderBy("uid")
    placed = (
        small.withColumn("rank", F.row_number().over(order).cast("long") - 1)
        .withColumn("full_at", F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(before.hint("merge"), ["r", "salt"]).join(bases, "r")  # the salts grow with the rows
        .select("uid", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("full_at") + F.col("salt_full") + F.col("length_full")).alias("full_at"))
    )
    m = np.array(moves, np.int64).reshape(-1, 5)
    keys = m[:, 0] << 44 | m[:, 1]
    lo = np.array(loose, np.int64).reshape(-1, 4)
    edges = np.array(cuts, np.int64)

    def start():
        def f(uid, doc, n, ids, rank, full_at):
            out = [[] for _ in range(7)]

            def put(i, at, length, seq, offset):
                for c, v in zip(out, (doc[i], at, length, n[i], seq, offset, ids[i][2 * at : 2 * (at + length)]), strict=True):
                    c.append(v)

            for i in range(len(n)):
                whole, rest = divmod(n[i], window)
                for k in range(whole):
                    put(i, k * window, window, windows + full + len(cuts) + full_at[i] + k, 0)
                if not rest:
                    continue
                j = int(np.searchsorted(keys, rest << 44 | rank[i], "right")) - 1
                past, nth = divmod(rank[i] - int(m[j, 1]), int(m[j, 4]))
                bin_, offset = int(m[j, 2]) + past, int(m[j, 3]) + nth * rest
                q = int(np.searchsorted(lo[:, 0], bin_, "right")) - 1
                if q < 0 or bin_ >= lo[q, 1]:
                    put(i, whole * window, rest, bin_, offset)
                    continue
                at, done = int(lo[q, 3] + (bin_ - lo[q, 0]) * lo[q, 2]) + offset, 0
                while done < rest:  # cut at the borders of the pool's new windows
                    if at < full * window:
                        seq, first, after = at // window, at // window * window, (at // window + 1) * window
                    else:
                        e = int(np.searchsorted(edges, at, "right")) - 1
                        seq, first, after = full + e, int(edges[e]), int(edges[e + 1]) if e + 1 < len(edges) else pooled
                    part = min(rest - done, after - at)
                    put(i, whole * window + done, part, windows + seq, at - first)
                    at, done = at + part, done + part
            return out

        return f

    both = tokens.join(placed, "uid").select("uid", "doc_id", "n", "ids", "rank", "full_at")
    return map_batches(both, start, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary", text=3)


def digest(documents: DataFrame, path: str, ranks: str, pattern: str) -> DataFrame:
    """The query's columns: pieces with the crc32 of their ids as unsigned 32-bit integers."""
    import numpy as np

    pieces = pack(tokenised(documents, path, ranks, pattern))

    def start():
        return lambda doc, at, length, total, seq, offset, ids: [doc, at, length, [zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes()) for b in ids], total, seq, offset]

    return map_batches(pieces, start, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", text=6)
