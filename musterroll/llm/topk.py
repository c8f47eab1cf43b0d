"""Exact top-k by inner product with Fagin's threshold algorithm, block by block.

Vectors and queries are dealt into blocks by hash, and every pair of blocks is
a group of its own.  In a block each dimension has a sorted list.  A query
walks all lists in step, from the end that its sign prefers, scores every row
that it meets, and stops when no row still unseen can beat its kth score: at
most the sum over dimensions of its component times the value at the current
depth.  The results of the blocks are merged by rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.runtime import written


_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    k: int = 5
    scale: int = 256
    block_rows: int = 4096
    query_rows: int = 2048


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if one is null or not finite."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.when(sound, F.transform(embedding, lambda x: F.greatest(F.floor(x.cast("double") * scale), F.lit(-_LONG))))


def exact_type(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The fastest type in which no sum of products can be rounded."""
    if not vectors.size or not queries.size:
        return np.float32
    largest = int(max(vectors.max(), -int(vectors.min()))) * int(max(queries.max(), -int(queries.min()))) * vectors.shape[1]
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object


class SortedLists:
    """One sorted list per dimension over a block of vectors, in ascending order of id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, kind: type):
        self.vectors, self.ids = vectors.astype(kind), ids
        self.order = np.argsort(-vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows, by score and then id; fewer if there are."""
        n = len(self.ids)
        query = query.astype(self.vectors.dtype)
        used = np.flatnonzero(query != 0)
        upward = query[used] < 0  # lists read from their low end
        seen = self.ids == own_id
        best, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth, ahead = 0, max(1, n // 64)
        while depth < n:
            reach = min(n, depth + ahead) if len(used) else n
            met = np.zeros(n, bool)
            if len(used):
                down = self.order[depth:reach, used]
                up = self.order[n - reach : n - depth, used][::-1]
                met[np.where(upward, up, down)] = True
            else:
                met[:] = True
            met &= ~seen
            new = np.flatnonzero(met)
            seen |= met
            best, scores = _best(np.concatenate([best, new]), np.concatenate([scores, self.vectors[new] @ query]), k)
            depth, ahead = reach, 2 * ahead
            if seen.all():
                break
            if len(best) == k:
                edge = np.where(upward, self.values[n - depth, used], self.values[depth - 1, used])
                # A row that ties with the kth could have a smaller id, so the bound must be below it.
                if (edge * query[used]).sum() < scores[-1]:
                    break
        return best, scores


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then by row number, which follows the id."""
    if len(rows) > 4 * k and scores.dtype != object:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth
        rows, scores = rows[near], scores[near]
    order = np.lexsort((rows, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k], np.int64)
    return rows[order], scores[order]


FOUND = "query_id bigint, vec_id bigint, score bigint, copies bigint"


def _blocks_top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    names = [part.split()[0] for part in FOUND.split(", ")]
    if queries.empty or rows.empty:
        return pd.DataFrame(columns=names)
    rows = rows.sort_values("vec_id", kind="stable")
    vectors, asked = np.stack(rows["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    ids, copies = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
    lists = SortedLists(vectors, ids, exact_type(vectors, asked))
    parts = []
    for query_id, query in zip(queries["vec_id"].to_numpy(), asked, strict=True):
        at, scores = lists.top(query, query_id, k)
        held = [max(-_LONG, min(_LONG, int(s))) for s in scores]
        parts.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at], "score": np.array(held, np.int64), "copies": copies[at]}))
    return pd.concat(parts, ignore_index=True)


def top_k(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of ``vectors``.

    Both tables have ``vec_id, embedding``.  Vectors that are null or hold a
    null or a component that is not finite take no part, nor do rows without
    an id; a query meets vectors of its own length only, and no row of its own
    id.  Of query rows that repeat an id, the one with the least vector asks.
    Rows that repeat are scored once and listed as often as they occur.
    Components and scores beyond a long are held at its ends.
    """
    ready = lambda df: df.select("vec_id", quantized(F.col("embedding"), settings.scale).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = written(ready(vectors).groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "topk-rows")
    asked = written(ready(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n_blocks = max(1, -(-rows.count() // settings.block_rows))
    n_asked = max(1, -(-asked.count() // settings.query_rows))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["dims", "asked_block", "block"]
    left = asked.select("vec_id", "v", F.size("v").alias("dims"), own(n_asked).cast("int").alias("asked_block"), every(n_blocks).alias("block"))
    right = rows.select("vec_id", "v", "copies", F.size("v").alias("dims"), own(n_blocks).cast("int").alias("block"), every(n_asked).alias("asked_block"))
    k = settings.k
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, r: _blocks_top(q, r, k), FOUND)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM sound q JOIN sound r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
