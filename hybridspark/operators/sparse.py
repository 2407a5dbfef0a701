"""Keyword retrieval: a BM25 index as plain DataFrames, searched by joining tokens."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hybridspark.functions.text import once, tokens
from hybridspark.sources.store import shared_folder, spread, stored

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Bm25Index:
    """postings (doc, token, tf, dl), vocabulary (token, df, idf), stats (n, avgdl)."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame


def _counted(sorted_tokens: Column) -> Column:
    """(token, tf) of each distinct token, from where its run begins and the next one's does: no shuffle is needed."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        size = lambda f, k: F.coalesce(F.get(f, k + 1), F.size(s)) - F.get(f, k)
        return once(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("token"), size(f, k).cast("long").alias("tf"))))

    return once(sorted_tokens, runs)


def build_bm25(chunks: DataFrame, key: str = "doc_id", text: str = "text", epsilon: float = EPSILON, folder: str | None = None) -> Bm25Index:
    """The index of chunks. Chunks without tokens count towards n and the mean length.

    A token in over half the chunks would have a negative weight; it gets epsilon times the mean of all raw weights. The
    texts are read once: postings and vocabulary are written to folder (a new one, if none is given), see read_bm25()."""
    folder = folder or shared_folder(chunks.sparkSession)
    listed = spread(chunks.select(F.col(key).alias("doc"), F.col(text).alias("text"))).select("doc", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    postings = listed.select("doc", F.size("tokens").cast("long").alias("dl"), F.explode(_counted(F.sort_array("tokens"))).alias("t"))
    postings = stored(postings.select("doc", "dl", "t.token", "t.tf"), f"{folder}/postings")
    counts = postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    n = chunks.select(F.count("*").alias("n"))
    raw = counts.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = stored(raw.select("token", "df", "total", "raw"), f"{folder}/raw")
    floor = raw.agg((F.avg("raw") * epsilon).alias("floor"))
    vocabulary = raw.join(F.broadcast(floor)).select("token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    size = raw.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("size"))
    stats = n.join(F.broadcast(size)).select("n", F.when(F.col("n") > 0, F.col("size") / F.col("n")).alias("avgdl"))
    return Bm25Index(postings, stored(vocabulary, f"{folder}/vocabulary"), stored(stats.coalesce(1), f"{folder}/stats"))


def read_bm25(spark: SparkSession, folder: str) -> Bm25Index:
    """An index that build_bm25() has written."""
    return Bm25Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "vocabulary", "stats")))


def metadata_test(filters: Mapping[str, object]) -> Column:
    """All keys must match: a list means one of its values, anything else equality; a null or missing value never matches."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in filters.items()]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False)) if tests else F.lit(True)


#: Queries that are broadcast together.
QUERY_BLOCK = 2000


def query_blocks(queries: DataFrame, most: int = QUERY_BLOCK) -> list[DataFrame]:
    """queries in parts of about most rows, each small enough to be broadcast; they are counted first."""
    blocks = max(1, -(-queries.count() // most))
    if blocks == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]


def top_per_query(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def can_be_first(k: int, margin: float, by: np.ndarray, at: np.ndarray, score: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Which of these can be among the first k of their query: within margin of the k-th, of equal scores the first k."""
    rank = np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))
    order = np.lexsort((at, -rank, by))
    by, rank = by[order], rank[order]
    place = np.arange(len(by))
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = by[1:] != by[:-1]
    begin = np.maximum.accumulate(np.where(fresh, place, 0))
    edge = rank[np.minimum(begin + k - 1, len(by) - 1)] if len(by) else rank
    run = fresh.copy()
    run[1:] |= rank[1:] != rank[:-1]
    copies = place - np.maximum.accumulate(np.where(run, place, 0))
    return order[(copies < k) & ((place - begin < k) | (rank >= edge - margin))]


#: More queries than this are scored by shards of documents; documents of a shard, queries of a block that meets it.
MANY, DOCUMENTS, BLOCK = 200, 16_384, 65_536
#: Words that are broadcast to the postings; the postings of more are shuffled.
WORDS = 1_000_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, dl, words, tfs) of (doc, dl, no, tf): a row for each run of a document's postings, which lie side by side in an index."""
    for batch in batches:
        doc, dl = batch.column("doc"), batch.column("dl")
        first = np.ones(len(doc), dtype=bool)
        for c in (doc, dl):
            first[1:] &= pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        first[1:] = ~first[1:]
        start = np.flatnonzero(first)
        ends = pa.array(np.append(start, len(doc)), pa.int32())
        lists = (pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("no", "tf"))
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(start)), dl.take(pa.array(start)), *lists], names=["doc", "dl", "words", "tfs"])


def _best(k: int, margin: float, avgdl: float, k1: float, b: float):
    """Of a shard's documents (doc, dl, words, tfs) and a block's queries (query_id, words, times, idfs): what can be among a query's first k."""

    def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        column = column.combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(column.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return column.dictionary.take(pa.array(order)), place[column.indices.to_numpy()]

    flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy()
    sizes = lambda t, c: pc.list_value_length(t[c].combine_chunks()).to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, at = coded(left["doc"])
        asked, times, ids = flat(right, "words"), flat(right, "times"), right["query_id"]
        idf = np.zeros(int(asked.max(initial=-1)) + 2)
        known = np.zeros(len(idf), dtype=bool)
        idf[asked], known[asked] = flat(right, "idfs"), True
        # postings of the words that are asked for, by word
        word, length = flat(left, "words"), sizes(left, "words")
        word = np.minimum(word, len(idf) - 1)
        some = np.flatnonzero(known[word])
        some = some[np.argsort(word[some], kind="stable")]
        word, row = word[some], np.repeat(np.arange(left.num_rows), length)[some]
        ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(idf)))])
        tf = flat(left, "tfs")[some].astype(np.float64)
        with np.errstate(all="ignore"):
            norm = k1 * (1 - b + b * left["dl"].to_numpy() / avgdl)
            part = idf[word] * tf * (k1 + 1) / (tf + norm[row])
        at, found = at[row], []
        starts = np.concatenate([[0], np.cumsum(sizes(right, "words"))]).tolist()
        for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            lists = [slice(ends[t], ends[t + 1]) for t in asked[lo:hi].tolist()]
            score = np.bincount(np.concatenate([at[:0], *(at[x] for x in lists)]), weights=np.concatenate([part[:0], *(f * part[x] for f, x in zip(times[lo:hi].tolist(), lists, strict=True))]))
            best = np.flatnonzero(score > 0)
            if len(best) > k:
                best = best[score[best] >= np.partition(score[best], -k)[-k] - margin]
            if len(best):
                found.append((np.full(len(best), i), best, score[best]))
        q, d, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        kept = can_be_first(k, margin, q, d, s, np.zeros(len(q), dtype=bool))
        return pa.table([ids.take(pa.array(q[kept], pa.int64())), docs.take(pa.array(d[kept], pa.int64())), pa.array(s[kept], pa.float64())], names=["query_id", "doc", "score"])

    return run


def _by_shards(index: Bm25Index, asked: DataFrame, queries: int, top_k: int, digits: int | None, k1: float, b: float) -> DataFrame:
    """(query_id, doc, score) that can be among the first top_k: scores are added within a task that holds a shard of
    documents, so no row for a posting and a query is ever made or shuffled.

    What queries ask for is written when this is called. Words get numbers, which are broadcast, and a document's postings
    of such words are packed into one row where they are read: that row alone is moved to its shard."""
    stats = index.stats.first()
    n, cores = stats["n"], asked.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(1, -(-n // DOCUMENTS), min(2 * cores, n // 1024)), -(-queries // BLOCK)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = stored(asked)
    words = asked.select("token").distinct().join(index.vocabulary, "token").select("token", "idf")
    words = stored(words.coalesce(1).select("token", "idf", F.monotonically_increasing_id().cast("int").alias("no")))
    numbers = words.select("token", "no")
    postings = index.postings.join(F.broadcast(numbers) if numbers.count() <= WORDS else numbers, "token")
    kind = index.postings.schema["doc"].dataType
    left = postings.select("doc", "dl", "no", F.col("tf").cast("int").alias("tf")).mapInArrow(_packed, f"doc {kind.simpleString()}, dl long, words array<int>, tfs array<int>")
    left = left.select("*", deal("doc", shards).alias("__shard"), every(blocks).alias("__block"))
    lists = F.array_sort(F.collect_list(F.struct("no", "qtf", "idf"))).alias("w")
    right = asked.join(words, "token").groupBy("query_id").agg(lists).select("query_id", F.col("w.no").alias("words"), F.col("w.qtf").alias("times"), F.col("w.idf").alias("idfs"))
    right = right.select("*", deal("query_id", blocks).alias("__block"), every(shards).alias("__shard"))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc", kind), T.StructField("score", T.DoubleType())])
    run = _best(top_k, 10.0**-digits if digits is not None else 0.0, stats["avgdl"] or 1.0, k1, b)
    return left.groupBy("__shard", "__block").cogroup(right.groupBy("__shard", "__block")).applyInArrow(run, schema)


def bm25_search(index: Bm25Index, chunks: DataFrame | None, queries: DataFrame, top_k: int = 20, filters: Mapping[str, object] | None = None, key: str = "doc_id", query: str = "query", k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """(query_id, rank, key, score, *columns of chunks) of the best chunks of each query (query_id, query).

    A token that a query repeats counts as often. Scores of 0 or less never match. Filters choose among the scored
    chunks and leave the corpus statistics alone. Ties go to the smaller key. digits rounds scores before ranking. Without
    chunks the index alone is asked: no filters, no columns, and no join that tests whether rows exist. Queries are
    counted; many at once, without filters, are written and meet shards of documents."""
    asked = queries.select("query_id", F.explode(tokens(F.col(query))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # filters choose after the scores, so that they need all of them
    if not filters and (n := queries.count()) > MANY:
        scored = _by_shards(index, asked, n, top_k, digits, k1, b)
    else:
        hits = asked.join(index.vocabulary, "token").join(index.postings, "token").join(F.broadcast(index.stats.select("avgdl")))
        scored = hits.groupBy("query_id", "doc").agg(F.sum(F.col("qtf") * weight).alias("score")).where("score > 0")
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return fetched(scored.withColumnRenamed("doc", key), chunks, key, filters, top_k)


def fetched(scored: DataFrame, rows: DataFrame | None, key: str, filters: Mapping[str, object] | None, top_k: int) -> DataFrame:
    """(query_id, rank, score, *columns of rows) of scored (query_id, key, score): the best of each query.

    Only keys and the columns of the filters meet the scores, and only if there are filters, as scores are of rows; texts
    and all else are fetched for what is left."""
    if rows is None:
        if filters:
            raise ValueError("filters need the rows whose columns they name")
        return top_per_query(scored, top_k, F.desc("score"), F.col(key)).select("query_id", "rank", "score", key)
    rows = rows.drop("score", "query_id", "rank")
    allowed = scored.join(rows.where(metadata_test(filters)).select(key), key) if filters else scored
    best = top_per_query(allowed, top_k, F.desc("score"), F.col(key))
    return best.select("query_id", "rank", "score", key).join(rows.where(metadata_test(filters or {})), key) if set(rows.columns) - {key} else best


def append(chunks: DataFrame, more: DataFrame) -> DataFrame:
    return chunks.unionByName(more, allowMissingColumns=True)


def remove_document(chunks: DataFrame, document_id: object, column: str = "document_id") -> DataFrame:
    """Without the chunks of a document; chunks that name no document stay."""
    return chunks.where(~F.col(column).eqNullSafe(F.lit(document_id)))
