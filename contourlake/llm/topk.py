"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size, queries likewise, and every pair of blocks is one group.
In a group each dimension's list is the block sorted by that component. The lists are read from the end
that a query's own component favours; every vector met is scored in full, and the sum of the products at
the reading depth bounds all vectors not met yet. A query stops reading when its k-th best score beats its
bound. The queries of a group read side by side, so a vector that any of them meets is scored for all that
still read, in one matrix product. Depth doubles from round to round. Equal vectors of a block are read
once. The k best of every block are merged by a window per query.

Components become integers before scoring, so scores are exact: in floating point or 64-bit numbers where the
largest components of queries and block leave room, else in Python's integers of any size. Ties go to the smaller id.

Edge cases: vectors that are null, empty or hold a null or non-finite component take no part, rows without an id
neither; only vectors of one length are compared; a query meets all rows but its own id; fewer candidates than k
give all of them; repeated ids are candidates each, and as queries they ask once for each distinct vector; a score
among the k best that does not fit a long raises OverflowError; empty tables give empty results; extra columns are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contourlake.llm.chunks import spans

#: Most candidates and queries in a block, on average.
CANDIDATES, QUERIES = 8192, 4096
FIRST_DEPTH = 16
#: Queries that read the lists side by side.
TOGETHER = 256


#: From here on a double times 64 is whole.
WHOLE = float(1 << 46)


def taking_part(vector: Column) -> Column:
    """The vector as doubles; null where it takes no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    return F.when(fine, v)


def whole_components(x: np.ndarray) -> np.ndarray:
    """floor(64 * x): 64-bit numbers, or Python's integers where one is too large for them."""
    if np.abs(x).max(initial=0) < WHOLE:
        return np.floor(x * 64).astype(np.int64)
    return np.array([[int(v) * 64 if abs(v) >= WHOLE else math.floor(v * 64) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _largest(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


class SortedLists:
    """A block of distinct integer vectors with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        first = np.ones(len(ids), bool)
        first[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.starts = np.append(np.flatnonzero(first), len(ids))
        self.ids, self.vectors, self.largest = ids, vectors[first], _largest(vectors)
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.lists, axis=0)

    def top(self, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best for each query (a row of q), ties to the smaller id."""
        n, most = len(self.vectors), self.largest * _largest(q) * q.shape[1]
        kind = np.float64 if most < 2**52 else np.int64 if most < 2**63 else object
        q, values, ordered = q.astype(kind), self.vectors.astype(kind), self.sorted.astype(kind)
        scores = np.full((len(q), n), -most - 1 if kind is object else np.iinfo(np.int64).min if kind is np.int64 else -np.inf, kind)
        met, alive, depth = np.zeros(n, bool), np.arange(len(q)), min(FIRST_DEPTH, n)
        while len(alive):
            now = q[alive]
            reached = np.zeros(n, bool)
            reached[self.lists[:depth, (now < 0).any(axis=0)].ravel()] = True
            reached[self.lists[n - depth :, (now > 0).any(axis=0)].ravel()] = True
            fresh = np.flatnonzero(reached & ~met) if depth < n else np.flatnonzero(~met)
            scores[np.ix_(alive, fresh)] = now @ values[fresh].T
            met[fresh] = True
            count = int(met.sum())
            if count == n:
                break
            if count > k + 1:  # one more than k: the query itself may be among them
                best = _place(scores[alive][:, met], count - (k + 1))
                bound = (now * np.where(now < 0, ordered[depth - 1], ordered[n - depth])).sum(axis=1)
                alive = alive[best <= bound]
            depth = min(n, 2 * depth)
        return [self._best(row, o, k) for row, o in zip(scores, own)]

    def _best(self, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(scores)
        found = np.flatnonzero(scores >= _place(scores[None], n - (k + 1))[0]) if n > k + 1 else np.arange(n)
        sizes = np.minimum(self.starts[found + 1] - self.starts[found], k + 1)  # ids of equal vectors are in order
        ids = self.ids[spans(self.starts[found], sizes)]
        at = np.repeat(scores[found], sizes)
        other = ids != own
        ids, at = ids[other], at[other]
        order = np.lexsort((ids, -at))[:k]
        if at.dtype == object and any(not -(1 << 63) <= s < 1 << 63 for s in at[order]):
            raise OverflowError(f"a score of query {own} does not fit a long")
        return ids[order], at[order].astype(np.int64)


def _place(scores: np.ndarray, i: int) -> np.ndarray:
    """The i-th smallest of each row."""
    return np.sort(scores, axis=1)[:, i] if scores.dtype == object else np.partition(scores, i, axis=1)[:, i]


def _block(k: int):
    def run(key, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(candidates) or not len(queries):
            return empty
        lists = SortedLists(candidates["vec_id"].to_numpy(np.int64), whole_components(np.stack(candidates["v"].to_numpy())))
        out = []
        own, number, q = queries["vec_id"].to_numpy(np.int64), queries["query"].to_numpy(np.int64), whole_components(np.stack(queries["v"].to_numpy()))
        for i in range(0, len(own), TOGETHER):
            part = slice(i, i + TOGETHER)
            for o, p, (ids, scores) in zip(own[part], number[part], lists.top(q[part], own[part], k)):
                out.append((np.full(len(ids), o, np.int64), np.full(len(ids), p, np.int64), ids, scores))
        return pd.DataFrame(dict(zip(("query_id", "query", "vec_id", "score"), (np.concatenate(c) for c in zip(*out))))) if out else empty

    return run


def top_k(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of every row for which ``queries`` (a condition on vec_id) holds."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), taking_part(F.col(vector)).alias("v")).filter("v is not null and vec_id is not null")
    rows = rows.withColumn("dim", F.size("v"))
    n, n_queries = rows.agg(F.count("*"), F.count_if(queries)).first()
    blocks, parts = max(16, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    candidates = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("long"))
    asked = rows.filter(queries).dropDuplicates(["vec_id", "v"]).withColumn("query", F.xxhash64("vec_id", "v")).withColumn("part", F.pmod("query", F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    keys = ("dim", "block", "part")
    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_block(k), "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
