"""Approximate nearest neighbours with hash-prefix forests.

A tree is a sorted array of long hash strings, one bit per random hyperplane. A query descends to its longest
prefix match in every tree; the trees then ascend together, one bit at a time, until the entries that share the
prefix suffice. How many suffice is not guessed: a bounded sample of queries is answered both ways and
the least share of rows that reaches the wanted recall is taken. Rows are dealt at random to shards, each with a forest of its
own; queries meet the shards in blocks and their nearest are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions.cluster import settle

SHARES = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)
FOUND = "query_id long, share int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted arrays of 64 bit hash strings over the rows of a matrix."""

    def __init__(self, rows: np.ndarray, trees: int, seed: int):
        self.planes = np.random.default_rng(seed).normal(size=(trees, rows.shape[1], 64))
        keys = self.hash(rows)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hash(self, rows: np.ndarray) -> np.ndarray:
        bits = np.packbits(np.einsum("nd,tdk->tnk", rows, self.planes, optimize=True) > 0, axis=2)
        return bits.view(">u8")[:, :, 0].astype(np.uint64)

    def ranges(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 entry sharing each prefix length 0 to 64: arrays (tree, length, query)."""
        asked = self.hash(rows)
        low = np.empty((len(self.keys), 65, len(rows)), np.int64)
        high = np.empty_like(low)
        for t, keys in enumerate(self.keys):
            for length in range(65):
                rest = np.uint64((1 << (64 - length)) - 1)
                low[t, length] = np.searchsorted(keys, asked[t] & ~rest, "left")
                high[t, length] = np.searchsorted(keys, asked[t] | rest, "right")
        return low, high


def nearest(rows, ids, norms, candidates, query, own, k):
    """The k largest cosines in double precision, ties to smaller ids, among candidate positions."""
    candidates = candidates[ids[candidates] != own]
    if not len(candidates):
        return candidates, np.zeros(0)
    size = np.sqrt((query * query).sum())
    rough = rows[candidates] @ query / (norms[candidates] * size)
    if len(rough) > k:
        close = rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9
        candidates = candidates[close]
    score = (rows[candidates] * query).sum(axis=1) / (norms[candidates] * size)
    order = np.lexsort((ids[candidates], -score))[:k]
    return candidates[order], score[order]


def _search(k: int, trees: int, seed: int, shares: tuple[float, ...], exact: bool):
    """Searches one shard for one block of queries, once per share; share -1 is the exact answer."""

    def work(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query_id": [], "share": [], "vec_id": [], "score": []})
        rows, ids = np.stack(index["vector"].to_numpy()).astype(np.float64), index["vec_id"].to_numpy(np.int64)
        want = np.stack(asked["vector"].to_numpy()).astype(np.float64)
        norms = np.sqrt((rows * rows).sum(axis=1))
        forest = Forest(rows / norms[:, None], trees, seed)
        low, high = forest.ranges(want / np.sqrt((want * want).sum(axis=1))[:, None])
        reach = (high - low).sum(axis=0)
        out = []
        for q, own in enumerate(asked["vec_id"].to_numpy(np.int64)):
            for s, share in enumerate(shares):
                # every row is in each tree once, so trees * share entries hold the share of rows at least
                enough = max(trees * (k + 1), share * len(rows) * trees)
                length = int(np.flatnonzero(reach[:, q] >= min(enough, reach[0, q])).max())
                hit = np.zeros(len(rows), bool)
                for t in range(trees):
                    hit[forest.order[t, low[t, length, q]:high[t, length, q]]] = True
                at, score = nearest(rows, ids, norms, np.flatnonzero(hit), want[q], own, k)
                out.append((np.full(len(at), own), np.full(len(at), s), ids[at], score))
            if exact:
                at, score = nearest(rows, ids, norms, np.arange(len(rows)), want[q], own, k)
                out.append((np.full(len(at), own), np.full(len(at), -1), ids[at], score))
        return pd.DataFrame(dict(zip(("query_id", "share", "vec_id", "score"), (np.concatenate(x) for x in zip(*out)))))

    return work


def _merged(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id", "share").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.96, trees: int = 16, seed: int = 7,
           shard_rows: int = 8192, block_rows: int = 8192, sample: int = 128) -> DataFrame:
    """The k nearest found of each query, both tables (vec_id, vector): query_id, rank, vec_id, score.

    Unusable vectors and rows without a vec_id take no part, and vectors of another length are no candidates. Rows of the
    query's vec_id are its own. Repeated rows count once. `sample` queries (those of least hash) choose the share of rows at which the
    trees stop ascending; the share is the least of SHARES whose measured recall reaches `recall`. Recall of a sample counts
    found scores not below the exact k-th, so ties do not matter.
    """
    def ready(df):
        used = df.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        return used.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim")).distinct()

    rows, asked = settle(ready(vectors)), settle(ready(queries))
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shards)).cast("int"))

    def run(index, asked, shares, exact, blocks):
        left = index.withColumn("block", every(blocks)).groupBy("dim", "shard", "block")
        block = F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(blocks)).cast("int")
        right = asked.withColumn("block", block).withColumn("shard", every(shards)).groupBy("dim", "shard", "block")
        return _merged(left.cogroup(right).applyInPandas(_search(k, trees, seed, shares, exact), FOUND), k)

    few = settle(asked.orderBy(F.xxhash64("vec_id", F.lit(seed + 2)), "vec_id").limit(sample))
    tried = settle(run(index, few, SHARES, True, 1))
    floor = tried.filter("share = -1").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = tried.filter("share >= 0").join(floor, "query_id").filter(F.col("score") >= F.col("least") - 1e-12)
    total = floor.agg(F.sum("n")).head()[0]
    by_share = {r["share"]: r["n"] for r in hits.groupBy("share").agg(F.count("*").alias("n")).collect()}
    chosen = next((s for i, s in enumerate(SHARES) if total and by_share.get(i, 0) >= recall * total), SHARES[-1])
    return run(index, asked, (chosen,), False, blocks).select("query_id", "rank", "vec_id", "score")


def op3_prefix_forest_neighbours(spark, folder) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return search(rows, rows.filter(F.col("vec_id") % 50 == 0))
