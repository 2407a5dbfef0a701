"""Approximate vector search: points in cells around centroids, queries in the few cells nearest to them.

Centroids are fitted on a bounded sample and every point is assigned. How many cells a query probes is calibrated: a
bounded set of rows is searched exactly once, and the fewest cells are taken that hold the wanted share of its
neighbours. Scores within cells are exact; dense_search() stays the exact mode.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridspark.functions.numbers import norm
from hybridspark.operators import dense
from hybridspark.operators.dense import dense_search
from hybridspark.operators.sparse import can_be_first, metadata_test, top_per_query
from hybridspark.sources.store import shared_folder, stored

#: Rows that centroids are fitted on at most, rows that the number of probes is calibrated on, cells at most.
SAMPLE, CALIBRATED, MOST_CELLS = 20_000, 100, 4096
#: Share of the neighbours that the probed cells shall hold: above 0.9, so that other queries keep that.
RECALL = 0.95


@dataclass(frozen=True)
class Cells:
    """points (cell, ...), where -1 holds those without a direction; centroids of length 1; cells that a query probes."""

    points: DataFrame
    centroids: np.ndarray
    probes: int
    key: str
    vector: str


def _sound(vector: Column) -> Column:
    """Neither null nor without length, and all numbers finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & (norm(vector) > 0), F.lit(False))


def _nearest(centroids: np.ndarray, n: int):
    """A column function: the n nearest cells of a sound vector, nearest first."""

    @F.pandas_udf("array<int>")
    def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            if not (len(vectors) and len(centroids)):
                yield pd.Series([np.empty(0, np.int32)] * len(vectors))
                continue
            far = -np.stack(list(vectors)) @ centroids.T
            # the first of all needs no order of the others; numbers that overflow come last, as in the order
            found = np.argmin(np.where(np.isnan(far), np.inf, far), axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
            yield pd.Series(list(found.astype(np.int32)))

    return near


def fit_cells(points: DataFrame, key: str = "point_id", vector: str = "vector", cells: int | None = None, sample: int = SAMPLE, calibrated: int = CALIBRATED, top_k: int = 20, recall: float = RECALL, folder: str | None = None, seed: int = 7) -> Cells:
    """Cells of all points: about as many as the root of their number, if not given. Everything but the centroids is over all rows.

    The sample is the sample rows with the least hashes of their keys, and the first of them calibrate the probes."""
    spark = points.sparkSession
    rows = points.where(_sound(F.col(vector)))
    n = rows.count()
    k = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    some = stored(rows.select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(sample))
    if k > 1 and n:
        unit = some.select(array_to_vector(F.transform("v", lambda x: x / norm(F.col("v")))).alias("features"))
        found = np.array(KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(unit).clusterCenters())
    else:  # one cell holds whatever there is
        found = np.array([r["v"] for r in some.limit(1).collect()] or np.empty((0, 0)))
    centroids = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    path = folder or shared_folder(spark)
    placed = rows.withColumn("cell", F.get(_nearest(centroids, 1)(F.col(vector).cast("array<double>")), 0))
    placed = placed.unionByName(points.where(~_sound(F.col(vector))).withColumn("cell", F.lit(-1)))
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    kept = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)).parquet(path)
    asked = some.orderBy(F.xxhash64(key), key).limit(calibrated).select(F.col(key).alias("query_id"), F.col("v").alias("vector"))
    truth = dense_search(kept.where("cell >= 0").select(key, "cell", vector), asked, top_k + 1, key=key, vector=vector).where(F.col(key) != F.col("query_id"))
    order = asked.select("query_id", _nearest(centroids, len(centroids))(F.col("vector")).alias("__cells"))
    ranks = truth.join(order, "query_id").select(F.array_position("__cells", F.col("cell")).alias("r"))
    need = ranks.agg(F.percentile("r", recall).alias("r")).first()["r"] if n else 1
    return Cells(kept, centroids, max(1, int(np.ceil(need or 1))), key, vector)


class _Shards:
    """Cells dealt to shards of about as many points, in their order; a cell of more points than that lies in several."""

    def __init__(self, sizes: dict[int, int], dim: int, cores: int) -> None:
        n = sum(sizes.values())
        self.number = max(1, -(-n * dim // dense.SHARD), min(2 * cores, n * dim // (dense.SHARD // 16)))
        most = max(1, -(-n // self.number))
        self.slices = np.zeros(max(sizes, default=-1) + 1, dtype=np.int64)
        for c, size in sizes.items():
            self.slices[c] = -(-size // most)
        self.first = np.cumsum(self.slices) - self.slices
        share = np.repeat([sizes.get(c, 0) / max(1, s) for c, s in enumerate(self.slices)], self.slices)
        self.shard = ((np.cumsum(share) - share / 2) // most).astype(np.int32)

    def of_points(self):
        """A column function: the shard of a point from its cell and a hash of its key."""

        @F.pandas_udf("int")
        def at(cell: pd.Series, key: pd.Series) -> pd.Series:
            c = cell.to_numpy()
            return pd.Series(self.shard[self.first[c] + np.mod(key.to_numpy(), self.slices[c])])

        return at

    def of_queries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard, with those of the query's cells that lie in the shard."""
        for batch in batches:
            rows, shards, cells = [], [], []
            for i, own in enumerate(batch["__cells"].to_pylist()):
                own = np.array([c for c in own if c < len(self.slices)], dtype=np.int64)
                n = self.slices[own]
                slots = np.repeat(self.first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                at, own = self.shard[slots], np.repeat(own, n)
                for s in np.unique(at):
                    rows.append(i)
                    shards.append(s)
                    cells.append(np.unique(own[at == s]).astype(np.int32))
            taken = batch.drop_columns(["__cells"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shards, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=[*taken.schema.names, "__shard", "__cells"])


def _within(k: int, dim: int, margin: float, key: str):
    """A shard's points that can be among the first k of each query of a block, of points in the query's cells alone.

    As in dense.py rough products in floats choose, exact ones in doubles score; a cell's points meet its queries only."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[(key, "ascending")], null_placement="at_start"))
        p, q = (dense.Vectors(t["__vector"].combine_chunks(), dim) for t in (left, right))
        kinds, cell = np.unique(left["cell"].to_numpy(), return_inverse=True)
        lists = right["__cells"].combine_chunks()
        by, asked = np.repeat(np.arange(len(right)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        there = np.isin(asked, kinds)
        probed = np.zeros((len(right), len(kinds)), dtype=bool)
        probed[by[there], np.searchsorted(kinds, asked[there])] = True
        found = []

        def add(by: np.ndarray, at: np.ndarray, score: np.ndarray, null: np.ndarray | None = None) -> None:
            null = np.zeros(len(by), dtype=bool) if null is None else null
            kept = can_be_first(k, margin, by, at, score, null)
            found.append((by[kept], at[kept], score[kept], null[kept]))

        order = np.argsort(cell, kind="stable")
        order = order[p.sound[order]]
        ends = np.searchsorted(cell[order], np.arange(len(kinds) + 1))
        unit = (p.rows[order] / p.sizes[order, None]).astype(np.float32)
        slack = np.float32(4 * (dim + 8) * 2.0**-24 + margin)
        # queries of the same cells side by side, so that a step meets few cells where queries probe few
        whole = np.flatnonzero(q.sound & probed.any(axis=1))
        whole = whole[np.argsort(np.argmax(probed[whole], axis=1), kind="stable")] if len(whole) else whole
        step = max(1, dense.TILE // max(1, len(unit)))
        for lo in range(0, len(whole) if len(unit) else 0, step):
            these = whole[lo : lo + step]
            near = (q.rows[these] / q.sizes[these, None]).astype(np.float32)
            met = np.flatnonzero(probed[these].any(axis=0))
            columns = np.concatenate([np.arange(ends[c], ends[c + 1]) for c in met])
            rough, at = np.full((len(these), len(columns)), -np.inf, dtype=np.float32), 0
            for c in met:
                own, n = np.flatnonzero(probed[these, c]), ends[c + 1] - ends[c]
                rough[own, at : at + n] = near[own] @ unit[ends[c] : ends[c + 1]].T
                at += n
            edge = np.partition(rough, len(columns) - k, axis=1)[:, len(columns) - k] if len(columns) > k else np.full(len(these), -np.inf, dtype=np.float32)
            i, j = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
            i, j = these[i], order[columns[j]]
            add(i, j, dense._score(p.rows[j], q.rows[i], p.sizes[j] * q.sizes[i]))
        every = np.flatnonzero(p.sound)
        for j in np.flatnonzero(~p.sound):  # of lengths that floats can't hold
            these = np.flatnonzero(probed[:, cell[j]])
            add(these, np.full(len(these), j), *p.against(j, q, these))
        for i in np.flatnonzero(~q.sound):
            these = every[probed[i, cell[every]]]
            add(np.full(len(these), i), these, *q.against(i, p, these))
        by, at, score, null = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
        kept = can_be_first(k, margin, by, at, score, null)
        at, by = pa.array(at[kept], pa.int64()), pa.array(by[kept], pa.int64())
        return pa.table([right["query_id"].take(by), left[key].take(at), left["cell"].take(at), pa.array(score[kept], pa.float64(), mask=null[kept])], names=["query_id", key, "cell", "score"])

    return run


def cell_search(index: Cells, queries: DataFrame, top_k: int = 20, filters: Mapping[str, object] | None = None, probes: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, rank, score, *columns of points) of the nearest points found for each query (query_id, vector), by cosine.

    Filters hold within the probed cells, before the best are taken. Queries without a direction find nothing. Of the
    stored points only probed cells are read. Cells are dealt to shards of bounded size, which large cells are split among,
    and queries to blocks; a task holds one of each, multiplies matrices and hands on what can be among a query's first, so
    that no row for a query and a point is made. The products grow as queries times the points in the cells they probe."""
    spark = queries.sparkSession
    asked = queries.where(_sound(F.col("vector"))).select("query_id", F.col("vector").cast("array<double>").alias("__vector"))
    routed = stored(asked.withColumn("__cells", _nearest(index.centroids, probes or index.probes)(F.col("__vector"))))
    wanted = [r[0] for r in routed.select(F.explode("__cells").alias("cell")).distinct().collect()]  # as many as there are cells at most
    rows = index.points.where(F.col("cell").isin(wanted)).where(metadata_test(filters or {}))
    kind = "array<float>" if index.points.schema[index.vector].dataType.simpleString() == "array<float>" else "array<double>"
    dim = max(1, index.centroids.shape[1])
    shards = _Shards({r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}, dim, spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-routed.count() // dense.BLOCK))
    near = rows.select(index.key, "cell", F.col(index.vector).cast(kind).alias("__vector"), shards.of_points()(F.col("cell"), F.xxhash64(index.key)).alias("__shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    schema = T.StructType([*routed.drop("__cells").schema, T.StructField("__shard", T.IntegerType()), T.StructField("__cells", T.ArrayType(T.IntegerType()))])
    dealt = routed.mapInArrow(shards.of_queries, schema).withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    found = T.StructType([routed.schema["query_id"], rows.schema[index.key], T.StructField("cell", T.IntegerType()), T.StructField("score", T.DoubleType())])
    margin = 10.0**-digits if digits is not None else 0.0
    scored = near.groupBy("__shard", "__block").cogroup(dealt.groupBy("__shard", "__block")).applyInArrow(_within(top_k, dim, margin, index.key), found)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    best = top_per_query(scored, top_k, F.desc("score"), F.col(index.key))
    return best.join(rows.drop("query_id", "rank", "score"), [index.key, "cell"]).drop("cell")
