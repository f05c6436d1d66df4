"""Nearest vectors by collision-counting hashing.

Every block of vectors keeps one sorted array per random projection. A query's
window on each array is centred on its own projection and widens round by round
(virtual rehashing: a wider window is the coarser hash, no table is rebuilt).
A vector that falls into the windows of enough projections is a candidate and
is verified by its exact inner product in double precision. A query stops in a
block once its windows span the distance that its best answers may have.

Inner product as distance: within a block whose largest norm is M, a vector x
becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0), so that a smaller distance is a
larger product. Blocks are ranges of norms, so one long vector changes M only
in its own block.

Bounded sample: ``sample`` vectors (chosen by hash of the id, 8,192 by default)
give each query a lower bound of its k-th best product, and with it the widest
window it needs; its k best in the sample stay among the found. Every row is in
a block, and every query visits every block.

Rows: vectors that are null, zero, or hold a null or non-finite component, or
whose width differs from the most common one, or whose id is null, take no part.
Rows that repeat an id count once in an answer; a query never meets rows of its
own id. Ties go to the smaller id. Fewer than k candidates give them all; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

PROJECTIONS = 48
SAMPLE = 8192
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
WIDEST = 1.5  # the widest half-window, in units of the target distance
STEPS = (0.85, 1.0)  # the rounds, as shares of the widest window
MISS = 1.2  # standard deviations below the expected collisions that still count


def _projections(dim: int, m: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, m))


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever the row stands, so
    that equal vectors tie exactly."""
    return (rows * q).sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best ids, each by its best row, largest product first,
    ties to the smaller id."""
    take = k
    while True:
        if len(ids) > 4 * take:  # all that tie with the last stay in
            floor = np.partition(scores, len(scores) - take)[len(scores) - take]
            near = np.flatnonzero(scores >= floor)
        else:
            near = np.arange(len(ids))
        near = near[np.lexsort((ids[near], -scores[near]))]
        first = np.sort(np.unique(ids[near], return_index=True)[1])
        if len(first) >= k or len(near) == len(ids):
            return near[first[:k]]
        take *= 4  # ids repeat among the best rows: look at more of them


class Block:
    """Sorted projections of some vectors, and the search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = PROJECTIONS, seed: int = 42):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.most = float(squares.max())
        self.directions = _projections(self.vectors.shape[1], m, seed)
        wide = np.concatenate([self.vectors, np.sqrt(np.maximum(self.most - squares, 0))[:, None]], axis=1)
        p = (wide @ self.directions).T
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        self.m, share = m, math.erf(WIDEST / math.sqrt(2))
        self.threshold = max(1, math.floor(m * share - MISS * math.sqrt(m * share * (1 - share))))

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window on each sorted array [array, query]."""
        lo = np.stack([s.searchsorted(x - half, "left") for s, x in zip(self.sorted, at.T)])
        hi = np.stack([s.searchsorted(x + half, "right") for s, x in zip(self.sorted, at.T)])
        return lo, hi

    def collisions(self, lo: list[int], hi: list[int]) -> np.ndarray:
        """In how many windows each vector lies: counted inside them or, where
        they span more than half of the arrays, by what they leave out."""
        n = len(self.ids)
        if 2 * (sum(hi) - sum(lo)) <= n * self.m:
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo, hi)]), minlength=n)
        out = [o[:a] for o, a in zip(self.order, lo)] + [o[b:] for o, b in zip(self.order, hi)]
        return self.m - np.bincount(np.concatenate(out), minlength=n)

    def search(self, query_ids: list[int], queries: np.ndarray, lower: np.ndarray, k: int):
        """For each query the ids and products of the k best ids found. ``lower``: a
        product that k other ids are known to reach."""
        norm2 = np.einsum("ij,ij->i", queries, queries)
        at = queries @ self.directions[:-1]
        distance = np.sqrt(np.maximum(self.most + norm2 - 2 * lower, 0))  # infinite without a bound
        whole = np.maximum(self.sorted[:, -1].max() - at.min(axis=1), at.max(axis=1) - self.sorted[:, 0].min()) + 1.0
        widest = np.minimum(WIDEST * distance * (1 + 1e-9) + 1e-12, whole)
        rounds = [(widest * step, *self.windows(at, widest * step)) for step in STEPS]
        out = []
        for i, query_id in enumerate(query_ids):
            q, low = queries[i], lower[i]
            verified = np.zeros(len(self.ids), bool)
            found, scores = np.empty(0, np.int64), np.empty(0)
            for half, lo, hi in rounds:
                hits = np.flatnonzero((self.collisions(lo[:, i].tolist(), hi[:, i].tolist()) >= self.threshold) & ~verified)
                verified[hits] = True
                near = hits[self.vectors[hits] @ q >= low - abs(low) * 1e-9 - 1e-12] if math.isfinite(low) else hits
                near = near[self.ids[near] != query_id]
                found = np.concatenate([found, near])
                scores = np.concatenate([scores, products(self.vectors[near], q)])
                best = _best(self.ids[found], scores, k)
                if len(best) == k and WIDEST * math.sqrt(max(self.most + norm2[i] - 2 * scores[best[-1]], 0)) <= half[i]:
                    break
            out.append((self.ids[found[best]], scores[best]))
        return out


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm2) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = rows.where(f"size(v) > 0 and {finite}").withColumn("norm2", F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))
    return rows.where("norm2 > 0")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, m: int = PROJECTIONS, sample: int = SAMPLE,
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` to each
    row of ``queries`` (both as ``usable`` gives them)."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dim = int(sizes["d"])
    # Equal rows of one id are one row; what an id repeats with other vectors is counted once by _best.
    vectors, queries = (x.where(F.size("v") == dim).dropDuplicates(["vec_id", "v"]) for x in (vectors, queries))
    vectors = staged(vectors, "ann-vectors")
    n = vectors.count()
    blocks, q_blocks = -(-n // block_rows), max(1, -(-queries.count() // query_rows))

    # The sample is at most `sample` vectors (64 MB at 1,024 wide), sent to every task.
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(sample).select("vec_id", "v").toPandas()
    shared = spark.sparkContext.broadcast((some["vec_id"].to_numpy(np.int64), _stack(some["v"])))

    def bound(batches):
        ids, sampled = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            lows, near_ids, near_scores = [], [], []
            mine = _stack(pdf["v"])
            for lo in range(0, len(pdf), 256):
                rough = mine[lo:lo + 256] @ sampled.T
                for query_id, v, r in zip(pdf["vec_id"].tolist()[lo:lo + 256], mine[lo:lo + 256], rough):
                    r[ids == query_id] = -np.inf
                    # those that may be among the k best, by the product's rounding error, are scored exactly
                    take, floor, best = k, np.inf, ()
                    while len(best) < k and floor > -np.inf:  # more rows where ids repeat
                        floor = np.partition(r, -take)[-take] if len(r) >= take else -np.inf
                        near = np.flatnonzero((r >= floor - abs(floor) * 1e-9 - 1e-12) & (ids != query_id)) if math.isfinite(floor) else np.flatnonzero(ids != query_id)
                        scores = products(sampled[near], v)
                        best = _best(ids[near], scores, k)
                        take *= 4
                    # rounded down a little: a bound, not a score
                    lows.append(scores[best[-1]] - abs(scores[best[-1]]) * 1e-9 - 1e-12 if len(best) == k else -np.inf)
                    near_ids.append(ids[near][best])
                    near_scores.append(scores[best])
            yield pdf.assign(low=lows, near_ids=near_ids, near_scores=near_scores)

    q = queries.select("vec_id", "v").mapInPandas(bound, "vec_id long, v array<double>, low double, near_ids array<long>, near_scores array<double>")
    q = staged(q, "ann-queries")
    known = q.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("near_ids", "near_scores")).alias("x"))
    known = known.select("query_id", F.col("x.near_ids").alias("vec_id"), F.col("x.near_scores").alias("score"))
    q = q.select("vec_id", "v", "low")
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"))
    data = vectors.repartitionByRange(blocks, "norm2", "vec_id").withColumn("db", F.spark_partition_id())
    data = staged(data.select("db", "vec_id", "v"), "ann-blocks")
    block_nos = data.select("db").distinct()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(np.int64), _stack(left["v"]), m)
            ids = right["vec_id"].tolist()
            for query_id, (near, scores) in zip(ids, block.search(ids, _stack(right["v"]), right["low"].to_numpy(), k)):
                if len(near):
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": near, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    # Each block of vectors meets each block of queries once.
    left = data.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = _to_all_blocks(q, block_nos)
    found = (left.groupBy("db", "qb").cogroup(right.groupBy("db", "qb"))
             .applyInPandas(run, "query_id long, vec_id long, score double"))

    best = found.unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _to_all_blocks(q: DataFrame, block_nos: DataFrame) -> DataFrame:
    numbers = [r["db"] for r in block_nos.collect()]  # one number per block of BLOCK_ROWS vectors
    return q.withColumn("db", F.explode(F.array(*[F.lit(x) for x in sorted(numbers)])))


def op9_nearest_vectors(spark, sf_dir) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
