"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to index shards by their ids, queries to blocks; a task holds one shard and one block, both of bounded
size, so no group of similar vectors makes a task large. In it, each tree has its own strings of bits, the sides of
random hyperplanes on which a row lies, in a sorted array. A query descends in every tree to its longest prefix match
and then ascends in all trees together, a bit at a time, until they have named enough rows, repeats counted. A row
counts by how long its matches are, over all trees; those that count most are scored exactly, and each shard's best
meet in one more shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

#: Trees, bits of a hash string (16 at most), rows of an index shard, queries of a block.
TREES, LENGTH, SHARD, BLOCK = 128, 16, 16384, 8192
#: Rows that are scored for a query: this share of the shard's, and so many times k at least.
SHARE, LEAST = 0.1, 20
#: A query ascends until its trees have named so many times the rows that it may score.
SPREAD = 48


@lru_cache(maxsize=1)
def planes(dim: int, trees: int, length: int, seed: int) -> np.ndarray:
    """The normals of random hyperplanes, one for each bit of each tree, the same in every task. Those of dim bits at a
    time are orthogonal, which spreads them evenly."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-trees * length // dim))]
    return np.concatenate(blocks, axis=1)[:, : trees * length].astype(np.float32)


def strings(x: np.ndarray, normals: np.ndarray, trees: int, length: int) -> np.ndarray:
    """Hash strings of rows of x in each tree, as numbers: the first bit is the highest."""
    sides = (x.astype(np.float32) @ normals > 0).reshape(len(x), trees, length)
    return (sides @ (1 << np.arange(length - 1, -1, -1, dtype=np.int32))).T.astype(np.uint16)


def ascend(index: np.ndarray, query: np.ndarray, length: int, most: int, spread: float = SPREAD) -> Iterator[tuple[int, np.ndarray | None]]:
    """For each query the depth at which its ascent stopped and the rows to score: most at most, or None for all rows.

    index and query: strings, tree by tree."""
    order = np.argsort(index, axis=1, kind="stable").astype(np.int32)
    names = np.take_along_axis(index, order, axis=1).astype(np.int32)
    query = query.astype(np.int32)
    trees, m = query.shape
    first, last, stop = np.zeros((trees, m), dtype=np.int32), np.full((trees, m), index.shape[1], dtype=np.int32), np.zeros(m, dtype=np.int32)
    open_ = np.arange(m)
    for depth in range(length, 0, -1):
        low = query[:, open_] >> length - depth << length - depth
        a = np.stack([np.searchsorted(n, v) for n, v in zip(names, low, strict=True)])
        b = np.stack([np.searchsorted(n, v) for n, v in zip(names, low + (1 << length - depth), strict=True)])
        enough = (b - a).sum(axis=0) >= spread * most
        done = open_[enough]
        first[:, done], last[:, done], stop[done] = a[:, enough], b[:, enough], depth
        open_ = open_[~enough]
        if not len(open_):
            break
    # how many leading bits two strings share, by their exclusive or
    shared = length - np.array([x.bit_length() for x in range(1 << length)], dtype=np.int32)
    for j in range(m):
        if not stop[j] or index.shape[1] <= most:
            yield int(stop[j]), None
            continue
        count = np.zeros(index.shape[1], dtype=np.int32)
        for t, (lo, hi) in enumerate(zip(first[:, j].tolist(), last[:, j].tolist(), strict=True)):
            if lo < hi:
                count[order[t, lo:hi]] += shared[names[t, lo:hi] ^ query[t, j]] - (stop[j] - 1)
        named = np.argpartition(-count, most)[:most]
        yield int(stop[j]), named[count[named] > 0]


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows of x with one more component that makes them all equally long, so that the largest product is the least angle."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (x**2).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _tile(k: int, longest: float, trees: int, length: int, share: float, seed: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            ids = rows["vec_id"].to_numpy()
            x = np.array(rows["embedding"].tolist(), dtype=np.float64)
            # equal vectors once, each with its smallest ids: no query can take more than k of them and itself
            x, copy = np.unique(x, axis=0, return_inverse=True)
            by = np.argsort(copy.ravel(), kind="stable")
            bounds = np.searchsorted(copy.ravel()[by], np.arange(len(x) + 1))
            q = np.array(queries["embedding"].tolist(), dtype=np.float64)
            normals = planes(x.shape[1] + 1, trees, length, seed)
            zero = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
            met = ascend(strings(_lifted(x, longest), normals, trees, length), strings(zero, normals, trees, length), length, max(LEAST * k, round(share * len(x))))
            for own, v, (_, rows_met) in zip(queries["vec_id"].to_numpy().tolist(), q, met, strict=True):
                near = x if rows_met is None else x[rows_met]
                rough = near @ v
                # all that rounding might put among the best
                edge = np.partition(rough, -(k + 1))[-(k + 1)] - 1e-9 * (1 + abs(rough).max()) if len(rough) > k + 1 else -np.inf
                best = np.flatnonzero(rough >= edge)
                scores = (near[best] * v).sum(axis=1)
                named = best if rows_met is None else rows_met[best]
                pairs = [(-s, int(i)) for s, d in zip(scores.tolist(), named.tolist(), strict=True) for i in ids[by[bounds[d] : min(bounds[d + 1], bounds[d] + k + 1)]] if i != own]
                found += [(own, i, -s) for s, i in sorted(set(pairs))[:k]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(v: Column) -> Column:
    """Vectors that take part: not null, without null, NaN or infinite components, not all zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(d, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, length: int = LENGTH, shard: int = SHARD, block: int = BLOCK, share: float = SHARE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found, by inner product, ties to smaller vec_id.

    rows and queries have vec_id and embedding; both may have other columns. A query never finds its own vec_id.
    Vectors that usable() refuses, rows without an id and vectors of another length than most rows have take no part.
    Repeated rows count once; of queries with one id, that with the least vector is asked. Every shard of rows meets
    every block of queries, so the work grows as rows times queries do, a tenth of it in exact products; tables of up to
    20 k rows are searched whole."""
    fit = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, queries = fit(rows), fit(queries)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    shapes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n, longest = (shapes["dim"], shapes["n"], shapes["longest"]) if shapes else (0, 0, 1.0)
    rows = rows.where(F.size("embedding") == dim)
    queries = queries.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards, blocks = max(1, -(-n // shard)), max(1, -(-queries.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("vec_id", "embedding", deal(shards).alias("shard"), every(blocks).alias("block"))
    queries = queries.select("vec_id", "embedding", every(shards).alias("shard"), deal(blocks).alias("block"))
    tile = _tile(k, longest, trees, length, share, seed)
    found = rows.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
