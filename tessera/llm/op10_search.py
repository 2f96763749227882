"""Nearest neighbours by largest inner product: collision counting with query-aware hashing.

Vectors are scaled by the largest norm and get one more component that brings them to length one, so
that the largest inner product is the smallest distance.  The rows are dealt to blocks; a block holds,
for each of ``PROJECTIONS`` random directions, its rows sorted by their projection.  A query opens a
window around its own projection in each array and widens it by virtual rehashing (radius R, R x
``GROWTH``, ...; the first R is guessed from some rows); each row counts the windows that hold it, and a wider window adds
only the rows that enter it.  Rows that reach the collision
threshold are verified by the exact product; the search of a block ends when ``k`` verified rows lie
within R, for which the threshold is set so that a row at distance R itself passes with about 84 %, nearer rows with more.
There is no cap on candidates: a query that finds too few goes on until the windows hold everything.

The query set is stated (ids divisible by ``EVERY``) and meets all rows block by block; each block
returns its k best, and these are merged.  A table of n rows moves once a ``QUERIES_AT_ONCE`` queries and the
queries once a ``BLOCK`` rows.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows
without id; a query meets the vectors of its own length; rows of the query's own id are not its
candidates; of repeated query rows one searches, repeated candidates are listed each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

K = 20
EVERY = 20
PROJECTIONS = 96
GROWTH = 1.05
#: Half width of a window over the radius, and the threshold's distance from the mean in deviations.
HALF_WIDTH = 1.0
SLACK = 1.0
#: Least radius to begin with, and rows of a block from the nearest of which a query's first radius is guessed, as a
#: share of its distance; a bad guess costs time, not results.
START = 0.05
BEGIN = 0.95
PROBES = 512
BLOCK = 32_768
QUERIES_AT_ONCE = 4096
SEED = 20


def valid_vectors(table_: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part, checkpointed."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table_.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return cut(rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0.0)))


class Block:
    """The sorted projections of one block's rows."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors, self.longest = vectors, longest
        unit = vectors / longest
        extra = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
        n, d = unit.shape
        self.directions = np.random.default_rng(SEED).standard_normal((PROJECTIONS, d + 1))
        at = self.directions[:, :d] @ unit.T + self.directions[:, d:] * extra
        order = np.argsort(at, axis=1, kind="stable")
        kind = np.uint16 if n < 1 << 16 else np.uint32
        self.order = order.astype(kind)  # rows by their projection
        self.place = np.empty(order.shape, kind)  # of a row in each array
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n, dtype=kind), order.shape), axis=1)
        # all arrays one after the other, each moved beyond the one before, so that one search serves all
        self.low, self.high = float(at.min()) - 1.0, float(at.max()) + 1.0
        self.shift = np.arange(PROJECTIONS) * (self.high - self.low)
        self.flat = (np.take_along_axis(at, order, axis=1) + self.shift[:, None]).ravel()
        self.first = np.arange(PROJECTIONS) * n
        self.probe = vectors[np.random.default_rng(SEED + 1).permutation(n)[:PROBES]]
        p = math.erf(HALF_WIDTH / math.sqrt(2.0))
        self.threshold = max(1, math.floor(PROJECTIONS * p - SLACK * math.sqrt(PROJECTIONS * p * (1 - p))))

    def _distance(self, score: float, norm: float) -> float:
        return math.sqrt(max(0.0, 2.0 - 2.0 * score / (self.longest * norm)))

    def window(self, here: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (from, to) of the rows in each window of a query."""
        ends = [np.clip(here + side * HALF_WIDTH * radius, self.low, self.high) + self.shift for side in (-1.0, 1.0)]
        return self.flat.searchsorted(ends[0], "left") - self.first, self.flat.searchsorted(ends[1], "right") - self.first

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many windows hold each row: its place lies between the window's ends."""
        kind = self.place.dtype
        if (high - low > np.iinfo(kind).max).any():
            kind = np.dtype(np.uint32)
        # places below the window wrap round to large numbers
        inside = (self.place.astype(kind, copy=False) - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
        return inside.sum(axis=0, dtype=np.uint8).astype(np.int64)  # at most PROJECTIONS

    def entered(self, low: np.ndarray, high: np.ndarray, new_low: np.ndarray, new_high: np.ndarray) -> np.ndarray:
        """How many windows each row enters when they grow to the new ends: the rings on both sides of all windows are
        gathered by one index over the arrays."""
        begin, many = np.concatenate([new_low, high]), np.concatenate([low - new_low, new_high - high])
        ends = np.cumsum(many)
        starts = begin + np.tile(self.first, 2) - (ends - many)
        rows = self.order.ravel()[np.arange(ends[-1]) + np.repeat(starts, many)]
        return np.bincount(rows, minlength=len(self.vectors))

    def nearest(self, query: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
        """Rows found: at least the ``k`` best of those verified (all rows but ``skip``, if there are no more)."""
        n, norm = len(self.vectors), float(np.sqrt(query @ query))
        want = min(k, n - len(skip))
        if want <= 0:
            return np.zeros(0, np.int64)
        here = self.directions[:, : len(query)] @ (query / norm)
        scores, seen = np.full(n, -np.inf), np.zeros(n, bool)
        seen[skip] = True
        likely = -np.sort(-(self.probe @ query))[min(len(self.probe) - 1, -(-want * len(self.probe) // n))]  # the first may be the query itself
        radius = max(START, self._distance(float(likely), norm) * BEGIN)
        found = 0
        low, high = self.window(here, radius)
        counts = self.collisions(low, high)
        while True:
            new = np.flatnonzero((counts >= self.threshold) & ~seen) if radius < 8.0 else np.flatnonzero(~seen)
            seen[new] = True
            scores[new] = (self.vectors @ query)[new] if 8 * len(new) > n else self.vectors[new] @ query
            found += len(new)
            if found >= want:
                worst = -np.partition(-scores, want - 1)[want - 1]
                if self._distance(worst, norm) <= radius or seen.all():
                    return np.flatnonzero(scores >= worst - 1e-9 * (1.0 + abs(worst)))
            radius *= GROWTH
            wider = self.window(here, radius)
            counts += self.entered(low, high, *wider)
            low, high = wider


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``vectors`` and ``queries``: vec_id, v, checkpointed.  query_id, rank, vec_id, score."""
    n, longest = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    nq = queries.count()
    blocks = max(1, math.ceil(n / BLOCK))
    # enough groups for all cores; beyond that, groups grow in number only with rows x queries
    chunks = max(1, math.ceil(nq / QUERIES_AT_ONCE), min(nq, math.ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / blocks)))
    deal = lambda count: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    keys = [F.size("v").alias("d"), "block", "chunk"]
    left = vectors.select("vec_id", "v", deal(blocks).alias("block")).select("vec_id", "v", "block", every(chunks).alias("chunk"))
    right = queries.select("vec_id", "v", deal(chunks).alias("chunk")).select("vec_id", "v", "chunk", every(blocks).alias("block"))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            ids, found = rows["vec_id"].to_numpy(), Block(_matrix(rows["v"]), longest)
            place: dict[int, list[int]] = {}
            for i, own in enumerate(ids.tolist()):
                place.setdefault(own, []).append(i)
            for query_id, query in zip(asked["vec_id"].to_pylist(), _matrix(asked["v"])):
                got = found.nearest(query, k, np.array(place.get(query_id, []), np.int64))
                exact = (found.vectors[got] * query).sum(axis=1)  # the same sum wherever a row lies
                for i in np.lexsort((ids[got], -exact))[:k]:
                    out.append((query_id, int(ids[got[i]]), float(exact[i])))
        kinds = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds)})

    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"))
    queries = cut(vectors.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    return search(vectors, queries)
