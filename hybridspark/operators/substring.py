"""Substring search by trigrams: candidates share the rarest trigrams of what is asked, then the texts themselves decide.

Only what has fewer than three letters in a row is looked for by a scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridspark.functions.text import once
from hybridspark.operators.sparse import query_blocks, top_per_query
from hybridspark.sources.store import dealt, parts_for, stored

#: Trigrams of a query, the rarest ones, that candidates must have.
RAREST = 4


@dataclass(frozen=True)
class Trigrams:
    """postings (gram, id) and counts (gram, df); counts may be absent, as they only choose among a query's trigrams."""

    postings: DataFrame
    counts: DataFrame | None = None


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for null and for fewer than three characters."""

    def of(letters: Column) -> Column:
        three = lambda c, i: F.concat(c, F.coalesce(F.get(letters, i + 1), F.lit("")), F.coalesce(F.get(letters, i + 2), F.lit("")))
        return F.array_distinct(F.slice(F.transform(letters, three), F.lit(1), F.greatest(F.size(letters) - 2, F.lit(0))))

    return once(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != ""), of)


def _grams(fields: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.coalesce(fields, F.array().cast("array<string>")), trigrams)))


def trigrams_of(rows: DataFrame, key: str, fields: Column) -> Trigrams:
    """The trigrams of an array of texts for each row, worked out when they are asked for."""
    return Trigrams(rows.select(F.explode(_grams(fields)).alias("gram"), F.col(key).alias("id")))


def build_trigrams(rows: DataFrame, key: str, fields: Column) -> Trigrams:
    """The index, written once: lists in the order of trigrams, so that a search passes over the others, and their lengths.

    The texts of a key are gathered before they are cut, so that no trigram stands twice, and letters are counted: the
    partitions are as many as lists of that length need."""
    letters = F.aggregate(F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda t: F.coalesce(F.length(t), F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(letters), F.lit(0)).alias("letters")).first()
    whole = dealt(rows.select(F.col(key).alias("__key"), fields.alias("__texts")), "__key", rows=size["n"]).groupBy("__key").agg(F.flatten(F.collect_list("__texts")).alias("__texts"))
    lists = trigrams_of(whole, "__key", F.col("__texts")).postings
    postings = stored(lists.repartitionByRange(parts_for(rows.sparkSession, size["letters"]), "gram", "id").sortWithinPartitions("gram", "id"))
    return Trigrams(postings, stored(postings.groupBy("gram").agg(F.count("*").alias("df"))))


def _literal(pattern: Column, ilike: bool) -> Column:
    """The parts of a pattern that stand for themselves."""
    return F.split(pattern, r"[%_\\]+") if ilike else F.array(pattern)


def candidates(index: Trigrams, asked: DataFrame, ilike: bool = False, rarest: int = RAREST) -> DataFrame:
    """(query_id, id) of rows that have the trigrams of asked (query_id, query); queries without any have no candidates.

    Trigrams of a block of queries are broadcast, as a frequent one's list is as long as the table and must not meet in a
    task; what they find is dealt by row, over as many partitions as the lists' lengths need."""
    return reduce(DataFrame.unionByName, [_candidates(index, q, ilike, rarest) for q in query_blocks(asked)])


def _candidates(index: Trigrams, asked: DataFrame, ilike: bool, rarest: int) -> DataFrame:
    grams = asked.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(_literal(F.col("query"), ilike), trigrams)))).alias("gram"))
    if index.counts is not None:
        found = grams.join(index.counts, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        grams = top_per_query(found, rarest, F.col("df"), F.col("gram")).select("query_id", "gram")
        grams = stored(grams)
    size = grams.join(index.counts, "gram").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] if index.counts is not None else index.postings.count()
    grams = grams.withColumn("__n", F.count("*").over(Window.partitionBy("query_id")))
    hits = dealt(index.postings.join(F.broadcast(grams), "gram"), "id", rows=size)
    # a built index has a trigram of a row once
    same = F.count("*") if index.counts is not None else F.count_distinct("gram")
    return hits.groupBy("query_id", "id", "__n").agg(same.alias("__m")).where("__m = __n").select("query_id", "id")


def substring_matches(rows: DataFrame, queries: DataFrame, test: Column, key: str, fields: Column | None = None, index: Trigrams | None = None, ilike: bool = False) -> DataFrame:
    """(query_id, query, *columns of rows) where test holds, an expression of query and rows that implies that a text of fields has the query.

    ilike: queries are patterns, % and _ wildcards. With neither index nor fields every row meets every query. Without
    an index each row meets the queries whose last trigram it has: rows stay where they are and none is gathered."""
    asked, ok = queries.select("query_id", "query"), F.coalesce(test, F.lit(False))
    parts = []
    if index is None and fields is None:
        short = asked
    else:
        long = F.exists(F.transform(_literal(F.lower("query"), ilike), lambda p: F.length(p)), lambda n: n >= 3)
        short = asked.where(~F.coalesce(long, F.lit(False)))
        if index is None:
            last = F.try_element_at(F.flatten(F.transform(_literal(F.col("query"), ilike), trigrams)), F.lit(-1))
            met = rows.withColumn("__gram", F.explode(_grams(fields)))
            parts += [met.join(F.broadcast(q.withColumn("__gram", last)), "__gram").where(ok).select("query_id", "query", *rows.columns) for q in query_blocks(asked.where(long))]
        else:
            for q in query_blocks(asked.where(long)):
                # the queries are broadcast, as many candidates may have one query; no table of rows is, however well its file is packed
                some = candidates(index, q, ilike).join(F.broadcast(q), "query_id").withColumnRenamed("id", key)
                parts.append(some.join(rows.hint("merge"), key).where(ok).select("query_id", "query", *rows.columns))
    if not parts or not short.isEmpty():
        parts += [rows.join(F.broadcast(q), ok).select("query_id", "query", *rows.columns) for q in query_blocks(short)]
    return reduce(DataFrame.unionByName, parts)
