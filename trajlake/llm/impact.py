"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are turned into whole numbers. The index of a block of vectors holds, for each
dimension, the distance of each value from the dimension's least one in the block, cut
into digits of ``DIGIT_BITS`` bits. The first digits of all dimensions are the segments of
largest impact, the next ones those of the next impact, and so on. Queries are taken some
together and add up impacts plane by plane, the largest first: a plane adds q_d times the
part of the distance that its digit of d stands for. After some planes,

* a vector's sum so far plus R-, the least that the digits not yet added can give (all
  their bits set where q_d is negative), is a lower bound of its score;
* the sum plus R+, the most that they can give, is an upper bound (both up to a constant
  of the query).

A vector whose upper bound is below the k-th largest lower bound can't be among the k best.
A query stops when few enough vectors remain possible, or all planes are done; all possible
members are then scored exactly. So the result is exact for any data.

Vectors of the same numbers are one entry with their k + 1 smallest ids: no other of them
can be in a result. Queries go to every block of the index, in blocks, and the blocks'
best are merged; a block's result is k rows per query, whatever the block holds.

Nulls: vectors that are null or hold a null or non-finite number take no part, as query or
candidate, and neither do null ids. A shorter vector counts as filled up with zeros; an
empty one scores 0. Ties go to the smaller id. Rows of the same id and numbers are one row,
rows of the same id and other numbers are rows of their own, and a query then leaves out
the one row that it is. An empty table gives no rows. Other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import save

BLOCK = 8192  # vectors of an index block
QUERY_BLOCK = 2048  # queries that meet a block in one task
DIGIT_BITS = 3  # of an impact, in a plane
TOGETHER = 64  # queries that a block answers at once
EXACT = 1 << 53  # sums below this are exact in float64, whose products are far faster
FEW = 64  # possible members that are rescored without further planes


def whole_numbers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``id`` and ``v`` array<long>: floor(scale * x); unusable vectors left out, repeated rows once."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("id"), whole.alias("v")).distinct()


class BlockIndex:
    """Planes of impact digits of one block; ``search`` gives the k best entries of a query."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        self.dims = matrix.shape[1]
        # Distances are unsigned: the range of a dimension may pass 63 bits.
        self.low = matrix.min(axis=0)
        far = matrix.astype(np.uint64) - self.low.astype(np.uint64)
        self.bits = np.array([int(x).bit_length() for x in far.max(axis=0)], np.int64)
        self.greatest = int(self.bits.max(initial=0))
        self.planes, self.rest = [], []
        for done in range(DIGIT_BITS, self.greatest + DIGIT_BITS, DIGIT_BITS):
            # Each dimension starts at its own highest bit.
            below = np.maximum(self.bits - done, 0).astype(np.uint64)
            above = np.minimum(self.bits - done + DIGIT_BITS, 63).clip(0).astype(np.uint64)
            digits = (far >> below << below) & ((np.uint64(1) << above) - np.uint64(1) if done > DIGIT_BITS else ~np.uint64(0))
            self.planes.append(digits.astype(np.float64))
            self.rest.append(((np.uint64(1) << below) - np.uint64(1)).astype(np.float64))

    def possible(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows that can be among its k best: few, or what all planes leave."""
        n = len(self.matrix)
        every = np.arange(n)
        size = int(np.abs(queries.astype(object)).max(initial=0)) if queries.size else 0
        if n <= max(FEW, k) or size * (self.dims << self.greatest) >= EXACT:
            return [every] * len(queries)
        found: list[np.ndarray] = [every] * len(queries)
        asking = np.arange(len(queries))
        q = queries.astype(np.float64)
        total = np.zeros((len(queries), n))
        for plane, rest in zip(self.planes, self.rest):
            total += q @ plane.T
            bar = np.partition(total, n - k, axis=1)[:, n - k] - np.abs(q) @ rest
            alive = total >= bar[:, None]
            few = np.count_nonzero(alive, axis=1) <= FEW
            for i, j in enumerate(asking):
                found[j] = np.flatnonzero(alive[i])
            if few.all():
                break
            q, total, asking = q[~few], total[~few], asking[~few]
        return found

    def search_all(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, rows and scores of the possible members that reach the k-th best score, ties included."""
        for first in range(0, len(queries), TOGETHER):
            some = queries[first : first + TOGETHER]
            for q, rows in zip(some, self.possible(some, k)):
                scores = self.matrix[rows] @ q
                if len(rows) > k:
                    bar = np.partition(scores, len(rows) - k)[len(rows) - k]
                    rows, scores = rows[scores >= bar], scores[scores >= bar]
                yield rows, scores

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return next(self.search_all(q[None, :], k))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    if len(vectors) and (vectors.str.len() == dims).all():
        return np.stack(vectors.to_numpy()).astype(np.int64).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top(numbers: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all rows but its own for each row with ``is_query``."""
    rows = save(numbers, "numbers")
    # One entry for equal vectors, with the smallest ids that any result can name.
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = rows.withColumn("_n", smallest).where(F.col("_n") <= k + 1).groupBy("v").agg(F.collect_list("id").alias("ids"))
    n = max(1, rows.count() // BLOCK)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    index = save(entries.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")), "entries")
    queries = save(rows.where(is_query), "queries")
    parts = max(1, queries.count() // QUERY_BLOCK)
    # Blocks of queries meet blocks of the index: blocks are copied, not rows joined with rows.
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(wanted):
            block = BlockIndex(_matrix(found["v"], dims))
            ids = found["ids"].to_numpy()
            asked_for = _matrix(wanted["v"], dims)
            # One more than k: the query's own row may be among them.
            for query_id, key, q, (hits, scores) in zip(wanted["id"], wanted["key"], asked_for, block.search_all(asked_for, k + 1)):
                best = sorted(
                    (-int(s), int(i))
                    for h, s in zip(hits, scores)
                    for i in _without(ids[h], query_id, block.matrix[h], q)
                )[:k]
                out.extend((query_id, key, i, -s) for s, i in best)
        return pd.DataFrame(
            {
                "query_id": np.array([x[0] for x in out], np.int64),
                "key": np.array([x[1] for x in out], np.int64),
                "vec_id": np.array([x[2] for x in out], np.int64),
                "score": np.array([x[3] for x in out], np.int64),
            }
        )

    asked = asked.withColumn("key", F.xxhash64("v"))
    met = index.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(
        search, "query_id long, key long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _without(ids: np.ndarray, own: int, vector: np.ndarray, q: np.ndarray) -> list[int]:
    """The ids of an entry, less the query's own if the entry is the query's vector."""
    if own in ids and np.array_equal(vector, q):
        return [i for i in ids if i != own]
    return list(ids)
