"""Expiry, two-step lookups, intervals, entries of maps, status counts, and graphs from nested rows and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.functions.numbers import in_minutes, key_count
from hybridspark.operators import chunking, graph, relational
from hybridspark.operators.dense import hashed_embedding
from hybridspark.plans.registry import query, table

_AS_OF = "2024-01-15 00:00:00"


@query(f"SELECT event_id FROM events WHERE ts + INTERVAL 15 MINUTE < TIMESTAMP '{_AS_OF}'")
def expired_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("expires_at", in_minutes(F.col("ts"), 15))
    return relational.expired(rows, "expires_at", F.lit(_AS_OF).cast("timestamp")).select("event_id")


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def two_step_lookup(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    asked = customers.where("c_mktsegment = 'BUILDING'").select("c_name")
    return relational.lookup(asked, customers, table(spark, d, "orders"), "c_name", "c_custkey", "o_custkey").select("c_name", "o_orderkey")


@query("SELECT event_id, len(json_keys(props))::INT AS n, list_aggregate(list_sort(json_keys(props)), 'string_agg', ',') AS names FROM events")
def map_key_counts(spark: SparkSession, d: str) -> DataFrame:
    entries = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", key_count(entries).alias("n"), F.array_join(F.sort_array(F.map_keys(entries)), ",").alias("names"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def section_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.status_counts(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""SELECT DISTINCT 's' || l_suppkey AS src, 'cert-' || l_linestatus AS dst, 'HOLDS' AS type FROM lineitem
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber, 'HAS_REQUIREMENT' FROM lineitem""")
def member_and_requirement_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    members = lines.groupBy("l_suppkey").agg(F.collect_set(F.concat(F.lit("cert-"), "l_linestatus")).alias("certifications"))
    members = members.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("name"), "certifications")
    key = F.concat_ws("-", F.concat(F.lit("l"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"))
    needs = lines.select(key.alias("id"), F.lit("line").alias("text"), F.col("l_returnflag").alias("category"), F.lit("medium").alias("priority"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("tender_id"))
    return graph.member_edges(members).unionByName(graph.requirements_of(needs)[1]).select("src", "dst", "type")


@query("""SELECT 'p' || p_partkey AS src, p_brand AS dst, 'FOR_CLIENT' AS type FROM part UNION ALL SELECT 'p' || p_partkey, p_type, 'HAS_CATEGORY' FROM part
UNION ALL SELECT 'p' || p_partkey, 'ISO-' || p_size, 'REQUIRES_CERT' FROM part UNION ALL SELECT 'm' || p_partkey, 'p' || p_partkey, 'DELIVERED' FROM part
UNION ALL SELECT DISTINCT 'n' || p_size, 'ISO-' || p_size, 'HOLDS' FROM part""")
def extracted_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a model, prose around the JSON, become nodes and edges."""
    s = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    person = F.struct(s("m", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("lead").alias("role"))
    project = F.struct(s("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("client"), F.array(s("ISO-", "p_size")).alias("certifications"), F.array(person).alias("team_members"))
    member = F.struct(s("n", "p_size").alias("name"), F.array(s("ISO-", "p_size")).alias("certifications"))
    answer = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.array(project).alias("projects"), F.array(member).alias("team_members"))), F.lit(" - done."))
    return graph.extracted(table(spark, d, "part").select(answer.alias("answer"))).edges.select("src", "dst", "type")


@query()
def chunk_by_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Semantic chunks with vectors from a pandas UDF; a test holds them against a loop."""
    chunks = chunking.chunk(table(spark, d, "documents").select("doc_id", "text"), embed=hashed_embedding)
    return chunks.select("doc_id", "chunk_index", F.length("text").alias("size"), F.md5("text").alias("chunk_md5"))
