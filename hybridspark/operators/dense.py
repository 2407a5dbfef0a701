"""Vector retrieval: exact cosine search over a DataFrame of points."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridspark.functions.text import query_prefix, tokens
from hybridspark.operators.sparse import can_be_first, metadata_test, top_per_query


def point_id(document: Column, chunk_index: Column) -> Column:
    """The same id each time a chunk is indexed."""
    return F.sha2(F.concat_ws(":", document.cast("string"), chunk_index.cast("string")), 256)


def index_points(chunks: DataFrame, vector: Column, document: str = "document_id", chunk_index: str = "chunk_index") -> DataFrame:
    """chunks with point_id and vector, ready to be appended to a collection's table."""
    return chunks.withColumns({"point_id": point_id(F.col(document), F.col(chunk_index)), "vector": vector})


#: Components of the points of a shard, queries of a block (a task holds one of each), products that it holds at a time.
SHARD, BLOCK, TILE = 4_194_304, 16_384, 4_000_000


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first component to the last as dot() does, so that scores are the same."""
    with np.errstate(all="ignore"):
        total = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
        for j in range(a.shape[-1]):
            total += a[..., j] * b[..., j]
    return total


def _score(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where((sizes > 0) | np.isnan(sizes), in_order(a, b) / sizes, 0.0)


class Vectors:
    """Vectors as rows of a matrix, and their lengths; null, one with a null and one of another size are rows of zeros.

    sound: those of this size, finite, whose length is far from what a double can hold. none: null or with a null."""

    def __init__(self, column: pa.Array, dim: int) -> None:
        n, sizes = len(column), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        values = column.flatten()  # without what null vectors may hold
        flat, starts = values.to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
        self.none = pc.is_null(column).to_numpy(zero_copy_only=False)
        if values.null_count:
            gone = np.concatenate([[0], np.cumsum(pc.is_null(values).to_numpy(zero_copy_only=False))])
            self.none = self.none | (gone[starts[1:]] > gone[starts[:-1]])
        self.fits = (sizes == dim) & ~self.none
        self.rows = np.zeros((n, dim))
        self.rows[self.fits] = flat[np.repeat(self.fits, sizes)].reshape(-1, dim)
        wide = np.asfortranarray(self.rows)  # a component of all vectors side by side
        self.sizes = np.sqrt(in_order(wide, wide))
        self.others = {i: flat[starts[i] : starts[i + 1]] for i in np.flatnonzero(~self.fits & ~self.none)}
        for i, v in self.others.items():
            self.sizes[i] = np.sqrt(in_order(v, v))
        self.sound = self.fits & (self.sizes > 1e-100) & (self.sizes < 1e100)

    def against(self, i: int, other: Vectors, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the vector i and these others, of any kind, as the column functions give them, and which are null."""
        with np.errstate(all="ignore"):
            sizes = self.sizes[i] * other.sizes[these]
        none = self.none[i] | other.none[these]
        score = np.where(none, 0.0, _score(self.rows[i], other.rows[these], sizes))
        unlike = ~none & ~(self.fits[i] & other.fits[these]) & ((sizes > 0) | np.isnan(sizes))
        if i in self.others:
            for t, j in enumerate(these):
                if j in other.others and len(other.others[j]) == len(self.others[i]):
                    score[t], unlike[t] = _score(self.others[i], other.others[j], sizes[t]), False
        return score, unlike


def _nearest(k: int, dim: int, margin: float, key: str):
    """A shard's points that can be among the first k of each query of a block: rough products in floats choose, exact ones in doubles score."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[(key, "ascending")], null_placement="at_start"))
        p, q = (Vectors(t["__vector"].combine_chunks(), dim) for t in (left, right))
        sound, found = np.flatnonzero(p.sound), []

        def add(by: np.ndarray, at: np.ndarray, score: np.ndarray, null: np.ndarray | None = None) -> None:
            null = np.zeros(len(by), dtype=bool) if null is None else null
            kept = can_be_first(k, margin, by, at, score, null)
            found.append((by[kept], at[kept], score[kept], null[kept]))

        whole = np.flatnonzero(q.sound)
        unit = (p.rows[sound] / p.sizes[sound, None]).astype(np.float32)
        # twice what products may be off by, as they and the vectors are rounded to floats
        slack = np.float32(4 * (dim + 8) * 2.0**-24 + margin)
        step = max(1, TILE // max(1, len(unit)))
        for lo in range(0, len(whole) if len(unit) else 0, step):
            these = whole[lo : lo + step]
            rough = (q.rows[these] / q.sizes[these, None]).astype(np.float32) @ unit.T
            edge = np.partition(rough, len(unit) - k, axis=1)[:, len(unit) - k] if len(unit) > k else np.full(len(these), -np.inf, dtype=np.float32)
            i, j = np.nonzero(rough >= (edge - slack)[:, None])
            i, j = these[i], sound[j]
            add(i, j, _score(p.rows[j], q.rows[i], p.sizes[j] * q.sizes[i]))
        # null vectors and those without length have one score with all sound queries, so their first k will do
        flat = np.flatnonzero(p.none | (p.sizes == 0))[:k]
        if len(whole) and len(flat):
            add(np.repeat(whole, len(flat)), np.tile(flat, len(whole)), np.zeros(len(whole) * len(flat)))
        for j in np.flatnonzero(~p.sound & ~p.none & (p.sizes != 0)) if len(whole) else ():
            add(whole, np.full(len(whole), j), *p.against(j, q, whole))
        every = np.arange(len(left))
        for i in np.flatnonzero(~q.sound):
            add(np.full(len(every), i), every, *q.against(i, p, every))
        by, at, score, null = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
        kept = can_be_first(k, margin, by, at, score, null)
        names = left[key].take(pa.array(at[kept], pa.int64()))
        return pa.table([right["query_id"].take(pa.array(by[kept], pa.int64())), names, pa.array(score[kept], pa.float64(), mask=null[kept])], names=["query_id", key, "score"])

    return run


def dense_search(points: DataFrame, queries: DataFrame, top_k: int = 20, filters: Mapping[str, object] | None = None, key: str = "point_id", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """(query_id, rank, score, *columns of points) of the nearest points of each query (query_id, vector), by cosine.

    Filters come before the search. Points and queries are counted and dealt to shards and blocks of bounded size; a task
    holds one of each and hands on what can be among a query's first, so that memory is bounded; the products grow as
    points times queries. A vector that is null, has a null or no length scores 0; of unlike sizes, null."""
    rows = points.where(metadata_test(filters or {}))
    as_numbers = lambda df, name: F.col(name) if df.schema[name].dataType.simpleString() == "array<float>" else F.col(name).cast("array<double>")
    # the search itself sees keys and vectors alone
    near = rows.select(key, as_numbers(rows, vector).alias("__vector"))
    asked = queries.select("query_id", as_numbers(queries, "vector").alias("__vector"))
    shape = near.agg(F.count("*").alias("n"), F.mode(F.size("__vector")).alias("dim")).first()
    dim, cores = max(1, shape["dim"] or 1), points.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-shape["n"] * dim // SHARD), min(2 * cores, shape["n"] * dim // (SHARD // 16)))
    blocks = max(1, -(-asked.count() // BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    near = near.select(key, "__vector", deal(key, shards).alias("__shard"), every(blocks).alias("__block"))
    asked = asked.select("query_id", "__vector", deal("query_id", blocks).alias("__block"), every(shards).alias("__shard"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("score", T.DoubleType())])
    margin = 10.0**-digits if digits is not None else 0.0
    scored = near.groupBy("__shard", "__block").cogroup(asked.groupBy("__shard", "__block")).applyInArrow(_nearest(top_k, dim, margin, key), schema)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return top_per_query(scored, top_k, F.desc("score"), F.col(key)).join(rows.drop("query_id", "rank", "score"), key)


def remove_document(points: DataFrame, document_id: object, column: str = "document_id") -> DataFrame:
    return points.where(~F.col(column).eqNullSafe(F.lit(document_id)))


def query_embedding(query: Column, embed: Callable[[Column], Column] | None = None, model: str = "", family: str = "bge", prefix: str = "") -> Column:
    """The vector of a query: models of an asymmetric family get the prefix before it, passages never do."""
    return (embed or hashed_embedding)(query_prefix(query, F.lit(model), family, prefix))


def hashed_embedding(text: Column, dim: int = 256) -> Column:
    """A deterministic stand-in for an embedding model: token counts by hashed place, of length 1.

    Any pandas or Arrow UDF from string to array<float> can take its place."""

    @F.arrow_udf("array<float>")
    def embed(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        places, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(lists), dim), dtype=np.float32)
        step = max(1, TILE // dim)
        for lo in range(0, len(lists), step):
            hi = min(lo + step, len(lists))
            at = np.repeat(np.arange(hi - lo) * dim, sizes[lo:hi]) + places[starts[lo] : starts[hi]]
            v = np.bincount(at, minlength=(hi - lo) * dim).reshape(hi - lo, dim).astype(np.float32)
            squares = np.einsum("ij,ij->i", v, v)
            size = np.sqrt(squares)
            for i in np.flatnonzero(squares >= 2**24):  # sums up to there are whole and exact in any order
                size[i] = np.linalg.norm(v[i])
            np.divide(v, size[:, None], out=out[lo:hi], where=size[:, None] > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dim, pa.int32()), pa.array(out.ravel()))

    return embed(F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim))))
