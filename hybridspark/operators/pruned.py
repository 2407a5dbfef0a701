"""Keyword search that leaves out what cannot matter: postings in blocks with their greatest weight.

The chunks of a corpus are dealt to blocks, the same for all tokens. A block's row has a token's postings in it and the
greatest weight among them, so the sum of those over a query's tokens bounds every score in the block. A first pass
scores the blocks with the greatest bounds in full; its k-th score is a threshold, and a second pass scores only blocks
whose bound reaches it. A frequent word on its own seldom does, so most of its list is never opened. Results are those
of bm25_search(), not near them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.functions.text import tokens
from hybridspark.operators.sparse import B, K1, Bm25Index, top_per_query
from hybridspark.sources.store import parts_for, shared_folder, stored

#: Chunks of a block, and folders that blocks are dealt to.
BLOCK_CHUNKS, PARTS = 64, 32


@dataclass(frozen=True)
class BlockIndex:
    """blocks (token, block, most, postings, part), vocabulary (token, df, idf), stats (n, avgdl); weights are those of k1 and b."""

    blocks: DataFrame
    vocabulary: DataFrame
    stats: DataFrame


def _weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def build_blocks(index: Bm25Index, folder: str | None = None, block_chunks: int = BLOCK_CHUNKS, parts: int = PARTS, k1: float = K1, b: float = B) -> BlockIndex:
    """The blocks of an index, written once. Their number follows the corpus, so a block has some block_chunks chunks at any size.

    Postings are moved once: dealt by blocks, so that a task has whole blocks of few folders, of about as many rows at any size."""
    spark = index.postings.sparkSession
    folder = folder or shared_folder(spark)
    sized = F.broadcast(index.stats.select("avgdl", F.greatest(F.ceil(F.col("n") / block_chunks), F.lit(1)).cast("long").alias("__blocks")))
    rows = index.postings.crossJoin(sized)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("__blocks")))
    buckets = parts * -(-parts_for(spark, index.postings.count()) // parts)
    # blocks of one bucket have one part
    rows = rows.withColumn("__bucket", F.pmod("block", F.lit(buckets)).cast("int")).repartition(buckets, "__bucket")
    rows = rows.select("token", "block", "__bucket", F.struct("doc", _weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b).alias("weight")).alias("p"))
    found = rows.groupBy("__bucket", "token", "block").agg(F.max("p.weight").alias("most"), F.collect_list("p").alias("postings"))
    found = found.drop("__bucket").withColumn("part", F.pmod("block", F.lit(parts)).cast("int"))
    # in the order of tokens, so that files and pages of other tokens are passed over
    found.sortWithinPartitions("part", "token", "block").write.partitionBy("part").parquet(f"{folder}/blocks")
    stored(index.vocabulary, f"{folder}/vocabulary")
    stored(index.stats.coalesce(1), f"{folder}/stats")
    return read_blocks(spark, folder, index.postings.schema["doc"].dataType.simpleString())


def read_blocks(spark: SparkSession, folder: str, kind: str = "long") -> BlockIndex:
    """Blocks that build_blocks() has written for chunks whose keys are of this kind."""
    blocks = spark.read.schema(f"token string, block long, most double, postings array<struct<doc:{kind},weight:double>>, part int")
    return BlockIndex(blocks.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/vocabulary"), spark.read.parquet(f"{folder}/stats"))


def _scored(index: BlockIndex, picks: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, doc, score) of all chunks in the picked (query_id, block); only folders that a pick lies in are listed."""
    parts = [r[0] for r in picks.select("part").distinct().collect()]
    blocks = index.blocks.where(F.col("part").isin(parts))
    # the few asked tokens first, as the picks times the tokens would seem too many to Spark and all blocks were shuffled
    hits = blocks.join(asked, "token").join(picks.select("query_id", "block"), ["query_id", "block"])
    each = hits.select("query_id", F.explode("postings").alias("p"), (F.col("qtf") * F.col("idf")).alias("__w"))
    return each.groupBy("query_id", F.col("p.doc").alias("doc")).agg(F.sum(F.col("__w") * F.col("p.weight")).alias("score"))


def pruned_passes(index: BlockIndex, queries: DataFrame, top_k: int = 20, query: str = "query", digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bounds (query_id, block, part, bound), those of blocks that are opened, and (query_id, doc, score) of what is in them."""
    asked = queries.select("query_id", F.explode(tokens(F.col(query))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    asked = stored(asked.join(index.vocabulary.select("token", "idf"), "token"))
    # a negative weight can only lower a score, so it has no part in a bound
    up = F.greatest(F.col("qtf") * F.col("idf") * F.col("most"), F.lit(0.0))
    bounds = stored(index.blocks.select("token", "block", "most", "part").join(asked, "token").groupBy("query_id", "block", "part").agg(F.sum(up).alias("bound")))
    first = top_per_query(bounds, top_k, F.desc("bound"), F.col("block")).drop("rank")
    early = stored(_scored(index, first, asked))
    kth = top_per_query(early.where("score > 0"), top_k, F.desc("score")).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # scores are added in another order than bounds, and rounding may make equals of near ones
    slack = 1e-9 + (10.0**-digits if digits is not None else 0.0)
    enough = F.when(F.col("n") >= top_k, F.col("least") - F.lit(slack) * (1 + F.abs("least")))
    rest = bounds.join(kth.select("query_id", enough.alias("least")), "query_id", "left").join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
    rest = stored(rest.where((F.col("bound") > 0) & (F.col("least").isNull() | (F.col("bound") >= F.col("least")))).select("query_id", "block", "part", "bound"))
    return bounds, first.select("query_id", "block", "part", "bound").unionByName(rest), early.unionByName(_scored(index, rest, asked))


def pruned_search(index: BlockIndex, queries: DataFrame, top_k: int = 20, key: str = "doc_id", query: str = "query", digits: int | None = None) -> DataFrame:
    """(query_id, rank, score, key) as bm25_search() has them without filters."""
    scored = pruned_passes(index, queries, top_k, query, digits)[2].where("score > 0")
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    scored = scored.withColumnRenamed("doc", key)
    return top_per_query(scored, top_k, F.desc("score"), F.col(key)).select("query_id", "rank", "score", key)
