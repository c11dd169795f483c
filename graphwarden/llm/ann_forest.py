"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from graphwarden.functions.storage import cut
from graphwarden.llm.streams import rows_like

#: trees of a forest, and bits of the hash string each sorts its vectors by
TREES, BITS = 64, 32
#: vectors of a shard, which is one forest, and queries that visit it together
SHARD, BLOCK = 8192, 4096
#: the search ends when a vector as near as the k-th found is missed by all trees with no more than this probability
MISS = 0.03
NEIGHBOURS = 5

_TREE = np.arange(TREES, dtype=np.uint64) << np.uint64(BITS)
_SHIFT = np.arange(BITS + 1, dtype=np.uint64)[:, None]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near 1.

    Cosines stay what they are, to the bit, but no square overflows, and none vanishes beside nothing larger.
    """
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0.0))[1])


class Forest:
    """Sorted arrays of hash strings, one for each tree, over the vectors of one shard.

    A hash string has one bit for each random direction: whether the vector lies on its positive side.  Vectors that share
    a prefix of length d with a query form one run of a tree's sorted array, found by two binary searches.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], scaled(vectors[order])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], TREES * BITS))
        codes = self.codes(self.vectors).T
        rows = np.argsort(codes, axis=1, kind="stable")
        self.rows = rows.ravel()
        # one sorted array holds those of all trees, one after the other: the tree's number leads the hash string
        self.sorted = (np.take_along_axis(codes, rows, axis=1).astype(np.uint64) + _TREE[:, None]).ravel()

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors @ self.directions > 0).reshape(len(vectors), TREES, BITS)
        return np.packbits(bits, axis=2).view(">u4")[:, :, 0].astype(np.uint32)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, vector, cosine) of the ``k`` nearest found for each query, ties to the smaller id.

        All trees descend to their longest match and ascend together, one bit at a time.  After each step a vector at the
        present k-th similarity has escaped all trees with probability (1 - p**d)**trees, where p is the chance that one
        bit agrees; the ascent ends when that is small enough, or at depth 0 with every vector seen.
        """
        out, queries = [], scaled(queries)
        norms = np.sqrt((queries * queries).sum(1))
        codes = self.codes(queries)
        n = len(self.ids)
        for q in range(len(query_ids)):
            # runs of every prefix length (rows, longest first) in every tree
            start = ((codes[q].astype(np.uint64) >> _SHIFT) << _SHIFT) + _TREE
            low = np.searchsorted(self.sorted, start)
            high = np.searchsorted(self.sorted, start + (np.uint64(1) << _SHIFT))
            grown = np.diff(high - low, axis=0, prepend=0) > 0
            seen = np.zeros(n, bool)
            near_ids, near = np.empty(0, np.int64), np.empty(0)
            for step in np.flatnonzero(grown.any(axis=1)):
                trees = np.flatnonzero(grown[step])
                fresh = np.zeros(n, bool)
                fresh[np.concatenate([self.rows[a:b] for a, b in zip(low[step, trees], high[step, trees])])] = True
                rows = np.flatnonzero(fresh & ~seen)
                seen[rows] = True
                rows = rows[self.ids[rows] != query_ids[q]]
                near_ids = np.concatenate((near_ids, self.ids[rows]))
                # row by row, so that equal vectors tie exactly
                cosine = (self.vectors[rows] * queries[q]).sum(1) / (self.norms[rows] * norms[q])
                near = np.concatenate((near, cosine))
                if len(near) < k:
                    continue
                keep = np.lexsort((near_ids, -near))[:k]
                near_ids, near = near_ids[keep], near[keep]
                agree = 1 - np.arccos(np.clip(near[-1], -1, 1)) / np.pi
                if (1 - agree ** (BITS - step)) ** TREES <= MISS:
                    break
            keep = np.lexsort((near_ids, -near))[:k]
            out += [(int(query_ids[q]), int(i), float(c)) for i, c in zip(near_ids[keep], near[keep])]
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: an id, no null or non-finite component, not zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows_like(vectors, ["vec_id", "embedding"]).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, every: int, k: int = NEIGHBOURS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    Nearest first by cosine in double precision, ties to the smaller id; fewer candidates give fewer rows.  Vectors that
    are null, zero, or hold null or non-finite components take no part; neither do rows with a null id.  Vectors of
    different lengths never meet.  Of rows with equal ids, each one is a candidate (a query's own id is none), and the
    query is the smallest of them.  An empty table gives no rows.

    Every vector is indexed: rows are dealt by hash into shards of a fixed size, and queries into blocks; each shard meets
    each block in a task of its own, where the forest of the shard is built and searched.  The k best of each shard are
    merged per query.
    """
    held = cut(usable(vectors).withColumn("dim", F.size("embedding")), "vectors")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in held.groupBy("dim").agg(
        F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}  # one row per length
    spark = vectors.sparkSession
    grid = spark.createDataFrame(
        [(d, -(-n // shard), -(-q // block)) for d, (n, q) in sizes.items()] or [(0, 1, 1)], "dim int, shards long, blocks long")
    dealt = held.join(F.broadcast(grid), "dim")  # one row for each length of vectors
    data = dealt.where("blocks > 0").withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), "shards")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("dim", "shards", "blocks", "vec_id").agg(
        F.min("embedding").alias("embedding"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        forest = Forest(left["vec_id"].to_numpy(), np.stack(left["embedding"].to_numpy()))
        return pd.DataFrame(
            forest.search(right["q_vec_id"].to_numpy(), np.stack(right["q_embedding"].to_numpy()), k),
            columns=["query_id", "vec_id", "score"])

    cell = ["dim", "shard", "block"]
    # fresh names: both sides come from one table
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in [*cell, "vec_id", "embedding"]])
    found = data.select(*cell, "vec_id", "embedding").groupBy(*cell).cogroup(
        asked.groupBy(*[f"q_{c}" for c in cell])).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
