"""Exact top-k by inner product from sorted lists that are only read in order (no random access).

Each component is a list of candidates sorted by its value; a query reads it from the top where its own component is
positive, from the bottom where it is negative. After reading all lists to some depth, a candidate's score lies between a
lower bound (what was not read has the list's worst value) and an upper bound (at best the value read last). When no more
candidates than a few can still reach the k-th best lower bound, reading stops and these few get their final scores.

On Spark, candidates are dealt into blocks and queries into blocks; a task reads the lists of one block for one block of
queries, all at once, to growing depths. The best k of each pair of blocks are merged per query. A block has a bounded
size, whatever vectors or ids it holds; copies of one vector are spread over all blocks. A query's block follows from its id
and vector, a candidate's from its place in a table written once, so a task that runs again deals its rows as before.

Components x become floor(256 x). Rows with a null id or vector, or a null or non-finite component, take no part. Only
vectors of the same length are compared. A query is not its own candidate: rows with its vec_id are left out. Repeated
queries are answered once, repeated candidates count each for itself; ties go to the smaller vec_id. A score beyond 64
bits is cut to the largest or smallest such number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import stage

SCALE = 256
TOP = 5
CANDIDATES, QUERIES = 4096, 1024  # in a block, about
#: Depths to which lists are read, as parts of a block; after the last one every score is known.
DEPTHS = (0.5, 0.75, 0.85, 0.9, 0.95, 1.0)
#: Reading stops once so many candidates are left for each place.
LEFT = 8


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and `v`, the whole-number components, of the rows that take part."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v"))


def _bounds(queries: np.ndarray, best: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over components, with `best` and `worst` for positive and negative query components side by side."""
    split = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    return split @ worst.T, split @ best.T


def block_top(query_ids, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = TOP) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query in one block."""
    n, d = vectors.shape
    largest = max(1, *(int(abs(int(m))) for x in (queries, vectors) for m in (x.min(initial=0), x.max(initial=0))))
    if d * largest * largest >= 1 << 53:
        queries, vectors = queries.astype(object), vectors.astype(object)  # exact, if slow
    else:
        queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
    order = np.argsort(vectors, axis=0, kind="stable")
    rising = np.empty((n, d), dtype=np.int64)
    np.put_along_axis(rising, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    in_order = np.take_along_axis(vectors, order, axis=0)
    low, high = in_order[0], in_order[-1]
    own = np.asarray(query_ids)[:, None] == ids[None, :]
    open_queries, found = np.arange(len(queries)), []
    for part in DEPTHS:
        depth = min(n, max(1, int(np.ceil(n * part))))
        last = depth == n
        own_open = own[open_queries]
        if last:
            lower = upper = queries[open_queries] @ vectors.T
            viable = ~own_open
        else:
            from_top, from_bottom = rising >= n - depth, rising < depth
            best = np.concatenate([np.where(from_top, vectors, in_order[n - depth]), np.where(from_bottom, vectors, in_order[depth - 1])], 1)
            worst = np.concatenate([np.where(from_top, vectors, low), np.where(from_bottom, vectors, high)], 1)
            lower, upper = _bounds(queries[open_queries], best, worst)
            lower = np.where(own_open, -np.inf, lower)
            reach = np.partition(lower, -k, axis=1)[:, -k] if n > k else np.full(len(lower), -np.inf)
            viable = (upper >= reach[:, None]) & ~own_open
        done = viable.sum(axis=1) <= LEFT * k
        for row in np.arange(len(open_queries)) if last else np.flatnonzero(done):
            left = np.flatnonzero(viable[row])
            q = open_queries[row]
            scores = upper[row, left] if last else vectors[left] @ queries[q]
            if len(left) > 4 * k and scores.dtype != object:
                bar = np.partition(scores, -k)[-k]
                left, scores = left[scores >= bar], scores[scores >= bar]
            ranked = sorted(zip((-scores).tolist(), ids[left].tolist()))[:k]
            found += [(int(query_ids[q]), c, max(min(int(-s), (1 << 63) - 1), -(1 << 63))) for s, c in ranked]
        open_queries = open_queries[:0] if last else open_queries[~done]
        if not len(open_queries):
            break
    return found


def dealt(vectors: DataFrame, is_query) -> DataFrame:
    """vec_id, v, width, asks, part, query_part: each candidate once per block of queries, each query once per block of candidates."""
    usable = stage(quantised(vectors), "topk-vectors")
    n, asked = usable.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    parts, query_parts = 1 + n // CANDIDATES, 1 + asked // QUERIES
    width, number = F.size("v").alias("width"), F.monotonically_increasing_id()
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = usable.select("vec_id", "v", width, F.lit(False).alias("asks"), (number % parts).cast("int").alias("part"))
    candidates = candidates.withColumn("query_part", every(query_parts))
    queries = usable.filter(is_query).dropDuplicates(["vec_id", "v"])
    hashed = F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_parts)).cast("int")
    queries = queries.select("vec_id", "v", width, F.lit(True).alias("asks"), every(parts).alias("part"), hashed.alias("query_part"))
    return candidates.unionByName(queries)


def nearest(vectors: DataFrame, is_query, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all `vectors` for each row that `is_query` (a condition) selects."""

    def best(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy()
        found = []
        if asks.any() and not asks.all():
            values = np.stack(block["v"].to_numpy()).astype(np.int64)
            ids = block["vec_id"].to_numpy()
            found = block_top(ids[asks], values[asks], ids[~asks], values[~asks], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    blocks = dealt(vectors, is_query).groupBy("width", "part", "query_part")
    local = blocks.applyInPandas(best, "query_id BIGINT, vec_id BIGINT, score BIGINT")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
