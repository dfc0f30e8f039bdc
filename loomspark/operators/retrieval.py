"""Exact vector search. Sums run in one order, so results don't depend on partitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of neighbour_graph(); a task holds the scores of two blocks.
BLOCK_ROWS = 2000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v: unit vectors; zero, null and non-finite ones are left out."""
    n = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).withColumn("n", norm(F.col("v")))
    return n.where("n > 0 and not isnan(n) and n < double('infinity')").select(key, F.transform("v", lambda x: x / F.col("n")).alias("v"))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of vectors for each query (query_id, vector), ties by key: query_id, key, score, rank.

    Vectors and queries are of one length and keys unique. Both sides are cut into blocks of about BLOCK_ROWS; each pair of
    blocks is one task's work, which hands on k rows a query, so nothing is broadcast and no task holds all scores of a query.
    """
    import numpy as np

    a = normalised(vectors, key, vector).select(F.col(key).cast("long").alias("id"), "v")
    q = normalised(queries, "query_id", vector).select(F.col("query_id").cast("long").alias("id"), "v")
    many, few = (max(1, -(-x.count() // BLOCK_ROWS)) for x in (a, q))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = a.select("id", "v", F.lit(False).alias("asks"), own(many).alias("i"), every(few).alias("j"))
    dealt = dealt.unionByName(q.select("id", "v", F.lit(True).alias("asks"), every(many).alias("i"), own(few).alias("j")))

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending")])
        asks, ids = rows["asks"].to_numpy().astype(bool), rows["id"].to_numpy()
        out: list[tuple] = []
        if asks.any() and not asks.all():
            v = rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            scores = v[asks] @ v[~asks].T
            found, every_q = ids[~asks], np.arange(int(asks.sum()))
            for _ in range(min(k, len(found))):
                at = scores.argmax(axis=1)  # the first of equals, which has the least key
                out.append((ids[asks], found[at], scores[every_q, at]))
                scores[every_q, at] = -np.inf
        cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, t) for c, t in enumerate(("int64", "int64", "float64"))]
        return pa.table({"query_id": cols[0], key: cols[1], "score": cols[2]})

    near = dealt.groupBy("i", "j").applyInArrow(best, f"query_id long, {key} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)  # k rows of each block of vectors
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest to one query vector, ties by key. A task sends k rows at most."""
    q = F.array(*[F.lit(float(x)) for x in query])
    n = sum(x * x for x in query) ** 0.5
    score = dot(F.col("v"), q) / F.lit(n)
    return normalised(vectors, key, vector).select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def neighbour_graph(vectors: DataFrame, k: int, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """src < dst and score: the union of every node's k nearest of all others whose cosine is least or more, ties by the higher key.

    Vectors are of one length and keys unique. Each pair of blocks is one task's work, which hands on k rows a node at most.
    Scores count by 12 digits, as the last ones depend on where a pair stands in its block.
    """
    import numpy as np

    unit = normalised(vectors, key, vector).select(F.col(key).cast("long").alias("id"), "v")
    blocks = max(1, -(-unit.count() // BLOCK_ROWS))
    own = unit.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select("id", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def best(pair: tuple, rows: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in pair)
        rows = rows.sort_by([("id", "descending")])
        block, ids = rows["b"].to_numpy(), rows["id"].to_numpy()
        flat = rows["v"].combine_chunks().flatten().to_numpy() if rows.num_rows else np.empty(0)
        v = flat.reshape(rows.num_rows, -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out: list[tuple] = []
        if len(left) and len(right):
            scores = np.round(v[left] @ v[right].T, 12)
            for a, b, s in [(left, right, scores)] if i == j else [(left, right, scores), (right, left, scores.T.copy())]:
                s = np.where(s >= least, s, -np.inf)
                if i == j:
                    np.fill_diagonal(s, -np.inf)
                every = np.arange(len(a))
                for _ in range(min(k, len(b))):
                    at = s.argmax(axis=1)  # the first of equals, which has the highest key
                    top = s[every, at]
                    ok = top > -np.inf
                    out.append((ids[a[ok]], ids[b[at[ok]]], top[ok]))
                    s[every, at] = -np.inf
        cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, t) for c, t in enumerate(("int64", "int64", "float64"))]
        return pa.table({"node": cols[0], "other": cols[1], "score": cols[2]})

    near = dealt.groupBy("i", "j").applyInArrow(best, "node long, other long, score double")
    w = Window.partitionBy("node").orderBy(F.col("score").desc(), F.col("other").desc())
    kept = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return kept.groupBy(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).agg(F.max("score").alias("score"))


def rank_distinct_cut(scored: DataFrame, document: str, key: str, n: int) -> DataFrame:
    """document, key, score of each document's best row, the n best documents: by score, then key. A task sends one row a document."""
    best = scored.groupBy(document).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))).alias("best"))
    return best.select(document, F.col("best.k").alias(key), (-F.col("best.s")).alias("score")).orderBy(F.col("score").desc(), key).limit(n)


#: Tokens of a query of maxsim() at most: it is broadcast.
QUERY_TOKENS = 4096


def mean_pool(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, pos, value: the mean vector of each group at unit length, one row a dimension."""
    parts = vectors.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    mean = parts.groupBy(group, "pos").agg(F.avg("x").alias("m"))
    n = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return mean.join(n, group).where("n > 0").select(group, "pos", (F.col("m") / F.col("n")).alias("value"))


def maxsim(tokens: DataFrame, query: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """group, score: for each query token the best dot product over the group's tokens, averaged over query tokens. query is a bounded set (token_id, vector)."""
    q = query.select("token_id", F.col(vector).cast("array<double>").alias("q"))
    if q.count() > QUERY_TOKENS:
        raise ValueError(f"a query has {QUERY_TOKENS} tokens at most")
    pairs = tokens.select(group, F.col(vector).cast("array<double>").alias("v")).join(F.broadcast(q)).select(group, "token_id", dot(F.col("q"), F.col("v")).alias("s"))
    return pairs.groupBy(group, "token_id").agg(F.max("s").alias("s")).groupBy(group).agg(F.avg("s").alias("score"))
