"""Reciprocal rank fusion, re-ranking and context assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.functions.numbers import rrf_term
from hybridspark.functions.text import identity_key, snippet, tokens
from hybridspark.operators.sparse import top_per_query

#: Retrievers in the order in which their results count as first.
RETRIEVERS = ("dense", "sparse", "graph")
WEIGHTS = {"dense": 0.4, "sparse": 0.3, "graph": 0.3}
K, CUT = 60, 20
RULE = "\n\n---\n\n"
_ENTRIES = "array<struct<key:string,value:string>>"


def rrf(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = K, top_k: int = CUT, digits: int | None = None) -> DataFrame:
    """(query_id, rank, text, score, metadata, sources) of ranked (query_id, retriever, rank, text, metadata).

    metadata is a map. Results are one if their texts start alike; each occurrence adds its term, repeats within a list
    too. Text comes from the first occurrence by retriever and rank; of each metadata key the first that has it counts.
    Blank texts are left out but keep their rank. A weight of 0 or None means the default. Ties go to the result that
    came first."""
    given = {r: (weights or {}).get(r) or WEIGHTS[r] for r in RETRIEVERS}
    number = F.array_position(F.array(*map(F.lit, RETRIEVERS)), F.col("retriever")).cast("int")
    weight = F.element_at(F.array(*(F.lit(float(given[r])) for r in RETRIEVERS)), number)
    rows = ranked.withColumns({"key": identity_key(F.col("text")), "at": F.struct(number.alias("retriever"), F.col("rank").alias("rank")), "term": rrf_term(F.col("rank"), weight, k or K)}).where("key <> ''")
    # one row without a name for the occurrence itself and one for each of its metadata keys: both go through partial
    # aggregates, so a text that stands in any number of rows is never gathered
    given_entries = F.coalesce(F.map_entries("metadata"), F.array().cast(_ENTRIES))
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = rows.withColumn("entries", given_entries).select("query_id", "key", "at", "term", "text", "entries", F.explode(F.concat(none, F.col("entries"))).alias("e"))
    itself = F.col("e.key").isNull()
    parts = rows.groupBy("query_id", "key", F.col("e.key").alias("name")).agg(
        F.sum(F.when(itself, F.col("term"))).alias("score"),
        F.min("at").alias("first"),
        F.min_by(F.when(itself, F.col("text")), "at").alias("text"),
        F.min_by(F.col("e.value"), F.struct("at", "entries")).alias("value"),
        F.collect_set("at.retriever").alias("numbers"),
    )
    named = F.when(F.col("name").isNotNull(), F.struct(F.struct("first", "name").alias("order"), F.col("name").alias("key"), F.col("value").alias("value")))
    groups = parts.groupBy("query_id", "key").agg(
        F.max("score").alias("score"),
        F.min("first").alias("first"),
        F.first("text", ignorenulls=True).alias("text"),
        F.array_sort(F.collect_list(named)).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"),
    )
    merged = F.map_from_entries(F.transform("all", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    sources = F.transform("numbers", lambda i: F.element_at(F.array(*map(F.lit, RETRIEVERS)), i))
    fused = groups.select("query_id", "text", (F.round("score", digits) if digits is not None else F.col("score")).alias("score"), merged.alias("metadata"), sources.alias("sources"), "first")
    return top_per_query(fused, top_k or CUT, F.desc("score"), F.col("first")).drop("first")


def lexical_score(query: Column, text: Column) -> Column:
    """The share of a query's distinct tokens that a text has: the default in place of a cross-encoder."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(0.0)


def rerank(fused: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score, top_k: int = 5) -> DataFrame:
    """fused by the scorer's score; the fused one becomes original_score. Ties keep the fused order.

    scorer(query, text) is any column function, a pandas UDF of a model among them; it sees fused results alone."""
    rows = fused.join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumnsRenamed({"score": "original_score", "rank": "__rank"}).withColumn("score", scorer(F.col("query"), F.col("text")))
    return top_per_query(rows, top_k, F.desc("score"), F.col("__rank")).drop("__rank", "query")


def context(results: DataFrame) -> DataFrame:
    """(query_id, context, sources): the whole texts in order, joined by a rule, and their snippets."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "text", "score")))
    return results.groupBy("query_id").agg(listed.alias("all")).select(
        "query_id",
        F.array_join(F.transform("all", lambda x: x["text"]), RULE).alias("context"),
        F.transform("all", lambda x: F.struct(x["rank"].alias("rank"), snippet(x["text"]).alias("text"), x["score"].alias("score"))).alias("sources"),
    )


def streamed_context(results: DataFrame) -> DataFrame:
    """As context(), from the cut snippets: what a streamed answer sees."""
    return context(results.withColumn("text", snippet(F.col("text"))))


def ranked_list(found: DataFrame, retriever: str, metadata: Column, rank: str = "rank", text: str = "text") -> DataFrame:
    """The columns that rrf() takes."""
    return found.select("query_id", F.lit(retriever).alias("retriever"), F.col(rank).alias("rank"), F.col(text).alias("text"), metadata.alias("metadata"))
