"""Keyword, vector and graph retrieval, fusion and re-ranking.

Scores are rounded before ranking so that engines that add in another order agree. The pairing of embeddings with
documents (vec_id = doc_id) is an assumption of these queries, not of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.functions.text import snippet, tokens
from hybridspark.operators import fusion, graph
from hybridspark.operators.cells import cell_search, fit_cells
from hybridspark.operators.dense import dense_search
from hybridspark.operators.engine import Corpus, HybridEngine, health, render_prompts
from hybridspark.operators.pruned import build_blocks, pruned_search
from hybridspark.operators.segments import SegmentedIndex
from hybridspark.operators.sparse import append, bm25_search, build_bm25, remove_document
from hybridspark.plans.registry import ORACLES, query, table, token_list
from hybridspark.sources.snapshots import Points, Snapshots
from hybridspark.sources.store import shared_folder, stored

ASKED = {1: "the license of the software and its terms", 2: "contact the support team by email or phone", 3: "der und die von erber der"}


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASKED.items()), "query_id int, query string")


_tokens = token_list
_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED.items()) + ") t(query_id, query))"
_INDEX = f"""listed AS (SELECT doc_id, {_tokens('text')} AS tk FROM documents),
lengths AS (SELECT doc_id, len(tk) AS dl FROM listed),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
postings AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS token FROM listed) GROUP BY 1, 2),
raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings, stats GROUP BY 1),
vocabulary AS (SELECT token, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw)"""


def _bm25(where: str = "TRUE", k: int = 20) -> str:
    return f"""qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('query')}) AS token FROM asked) GROUP BY 1, 2),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM qt JOIN vocabulary USING (token) JOIN postings USING (token) JOIN lengths USING (doc_id), stats GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id) WHERE score > 0 AND {where}) WHERE rank <= {k})"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d)


@query(f"WITH {_INDEX} SELECT doc_id, dl::BIGINT AS dl, coalesce(list_distinct(tk).len(), 0)::BIGINT AS kinds FROM listed JOIN lengths USING (doc_id)")
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("dl"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))


@query(f"WITH {_INDEX} SELECT token, df FROM vocabulary")
def postings_df(spark: SparkSession, d: str) -> DataFrame:
    return build_bm25(table(spark, d, "documents")).vocabulary.select("token", "df")


@query(f"WITH {_INDEX} SELECT token, round(idf, 6) AS idf FROM vocabulary")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return build_bm25(table(spark, d, "documents")).vocabulary.select("token", F.round("idf", 6).alias("idf"))


@query(f"WITH {_ASKED}, {_INDEX}, {_bm25()} SELECT query_id, rank::INT AS rank, doc_id, score FROM sparse")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_search(build_bm25(table(spark, d, "documents")), None, asked(spark), digits=6).select("query_id", "rank", "doc_id", "score")


@query(ORACLES["bm25_topk"])
def bm25_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same results from blocks of postings, most of which stay closed."""
    blocks = build_blocks(build_bm25(table(spark, d, "documents")))
    return pruned_search(blocks, asked(spark), digits=6).select("query_id", "rank", "doc_id", "score")


_SOME = "lang IN ('de', 'fr') AND source = 'src1'"


@query(f"WITH {_ASKED}, {_INDEX}, {_bm25(_SOME)} SELECT query_id, rank::INT AS rank, doc_id, score FROM sparse")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = bm25_search(build_bm25(docs), docs.select("doc_id", "lang", "source"), asked(spark), filters={"lang": ["de", "fr"], "source": "src1"}, digits=6)
    return found.select("query_id", "rank", "doc_id", "score")


@query(f"WITH asked AS (SELECT 1 AS query_id, 'license license software' AS query), {_INDEX}, {_bm25()} SELECT query_id, rank::INT AS rank, doc_id, score FROM sparse")
def bm25_dup_query_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    twice = spark.createDataFrame([(1, "license license software")], "query_id int, query string")
    return bm25_search(build_bm25(docs), docs.select("doc_id"), twice, digits=6).select("query_id", "rank", "doc_id", "score")


@query("""WITH c AS (SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src3' UNION ALL SELECT doc_id + 1000000 FROM documents WHERE source = 'src5')
SELECT count(*) AS chunks, sum(doc_id)::BIGINT AS ids FROM c""")
def corpus_append_remove(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    more = docs.where("source = 'src5'").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return append(remove_document(docs, "src3", "source"), more).agg(F.count("*").alias("chunks"), F.sum("doc_id").alias("ids"))


_GROWN = """documents AS (SELECT doc_id, CASE WHEN source = 'src1' THEN text || ' license terms' ELSE text END AS text FROM main.documents WHERE source IS DISTINCT FROM 'src3')"""


@query(f"WITH {_GROWN}, {_ASKED}, {_INDEX}, {_bm25()} SELECT query_id, rank::INT AS rank, doc_id, score FROM sparse")
def bm25_segments(spark: SparkSession, d: str) -> DataFrame:
    """An index grown in four changes: two loads that make up the table, a source taken out, a source's texts replaced."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    index = SegmentedIndex(Snapshots(spark, shared_folder(spark)), "doc_id", "doc_id")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.add(docs.where(english))
    index.add(docs.where(~english))
    index.remove(docs.where("source = 'src3'"))
    index.add(docs.where("source = 'src1'").withColumn("text", F.concat("text", F.lit(" license terms"))))
    return index.search(asked(spark), digits=6).select("query_id", "rank", "doc_id", "score")


@query("""WITH again AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linenumber <= 2)
SELECT l_orderkey || ':' || l_linenumber AS point_id, max(CASE WHEN k IS NULL THEN '' ELSE 'again ' END || l_returnflag) AS text
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN again ON k = l_orderkey
WHERE o_orderstatus IS DISTINCT FROM 'P' AND (k IS NULL OR l_linenumber <= 2) GROUP BY 1""")
def points_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents and their lines as points: all are stored, the closed ones come again with two lines at most, pending ones go."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), "o_orderstatus")
    rows = lines.select(F.col("l_orderkey").alias("document_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("point_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_returnflag").alias("text"))
    points = Points(Snapshots(spark, shared_folder(spark)))
    points.replace(rows)
    again = rows.where("chunk_index <= 2").join(orders.where("o_orderstatus = 'F'"), "document_id", "left_semi")
    points.replace(again.withColumn("text", F.concat(F.lit("again "), "text")))
    points.delete(orders.where("o_orderstatus = 'P'"))
    return points.read().select("point_id", "text")


_COS = "round(list_dot_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"


def _dense(where: str = "TRUE", queries: str = "vec_id < 3", k: int = 20) -> str:
    return f"""dense AS (SELECT * FROM (SELECT q.vec_id + 1 AS query_id, p.vec_id AS doc_id, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, p.vec_id) AS rank FROM embeddings p, (SELECT * FROM embeddings WHERE {queries}) q WHERE {where}) WHERE rank <= {k})"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return points, points.where("doc_id < 3").select((F.col("doc_id") + 1).cast("int").alias("query_id"), "vector")


def _many(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All points, and those whose id is divisible by 20 as queries."""
    points, _ = _vectors(spark, d)
    return points, points.where("doc_id % 20 = 0").select((F.col("doc_id") + 1).alias("query_id"), "vector")


_MANY = "vec_id % 20 = 0"


@query(f"WITH {_dense(queries=_MANY)} SELECT query_id, rank::INT AS rank, doc_id, score FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    points, queries = _many(spark, d)
    return dense_search(points, queries, key="doc_id", digits=6).select("query_id", "rank", "doc_id", "score")


@query(f"WITH {_dense('p.label IN (1, 3)', _MANY)} SELECT query_id, rank::INT AS rank, doc_id, score FROM dense")
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    points, queries = _many(spark, d)
    return dense_search(points, queries, filters={"label": [1, 3]}, key="doc_id", digits=6).select("query_id", "rank", "doc_id", "score")


@query()
def dense_cells(spark: SparkSession, d: str) -> DataFrame:
    """dense_topk by cells; a test holds its recall against the exact search."""
    points, queries = _many(spark, d)
    return cell_search(fit_cells(points, "doc_id"), queries, digits=6).select("query_id", "rank", "doc_id", "score")


@query(ORACLES["dense_topk"])
def dense_topk_many(spark: SparkSession, d: str) -> DataFrame:
    return dense_topk(spark, d)


@query(ORACLES["dense_filtered"])
def dense_filtered_many(spark: SparkSession, d: str) -> DataFrame:
    return dense_filtered(spark, d)


def _corpus(spark: SparkSession, d: str) -> tuple[Corpus, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    points, queries = _vectors(spark, d)
    points = points.join(docs, "doc_id")
    return Corpus(docs, "doc_id", points, build_bm25(docs), metadata=("lang", "source")), asked(spark).join(queries, "query_id")


_RULE = "concat(chr(10), chr(10), '---', chr(10), chr(10))"
_KEY = r"left(lower(regexp_replace(text, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g')), 200)"
_FUSED = f"""hits AS (SELECT query_id, 1 AS no, rank, doc_id, 0.4 AS w FROM dense JOIN documents USING (doc_id) UNION ALL SELECT query_id, 2, rank, doc_id, 0.3 FROM sparse),
keyed AS (SELECT b.*, text, lang, {_KEY} AS k, row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY no, rank) AS nth FROM hits b JOIN documents USING (doc_id)),
grp AS (SELECT query_id, k, round(sum(w::DOUBLE / (60 + rank)), 6) AS score, string_agg(DISTINCT CASE no WHEN 1 THEN 'dense' ELSE 'sparse' END, ',' ORDER BY CASE no WHEN 1 THEN 'dense' ELSE 'sparse' END) AS sources FROM keyed WHERE k <> '' GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT g.query_id, g.score, g.sources, f.text, f.lang, row_number() OVER (PARTITION BY g.query_id ORDER BY g.score DESC, f.no, f.rank) AS rank FROM grp g JOIN keyed f ON f.query_id = g.query_id AND f.k = g.k AND f.nth = 1) WHERE rank <= 20)"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "score", F.array_join("sources", ",").alias("sources"), F.md5("text").alias("text_md5"), F.element_at("metadata", "lang").alias("lang"))


_DENSE = _dense("EXISTS (FROM documents x WHERE x.doc_id = p.vec_id)")


@query(f"WITH {_ASKED}, {_INDEX}, {_bm25()}, {_DENSE}, {_FUSED} SELECT query_id::INT AS query_id, rank::INT AS rank, score, sources, md5(text) AS text_md5, lang FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    return _flat(HybridEngine(corpus, digits=6).search(queries, top_k=20, rerank=False))


_LEX = f"""lex AS (SELECT f.*, CASE WHEN len(list_distinct({_tokens('query')})) > 0 THEN len(list_intersect(list_distinct({_tokens('query')}), {_tokens('text')})) / len(list_distinct({_tokens('query')})) ELSE 0 END AS lexical FROM fused f JOIN asked USING (query_id)),
reranked AS (SELECT * FROM (SELECT query_id, text, sources, score AS original_score, lexical AS score, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, rank) AS rank FROM lex) WHERE rank <= 5)"""
_HYBRID = f"WITH {_ASKED}, {_INDEX}, {_bm25()}, {_DENSE}, {_FUSED}, {_LEX}"


@query(f"{_HYBRID} SELECT query_id::INT AS query_id, rank::INT AS rank, round(score, 9) AS score, original_score, sources, md5(text) AS text_md5 FROM reranked")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    found = HybridEngine(corpus, digits=6).search(queries)
    return found.select("query_id", "rank", F.round("score", 9).alias("score"), "original_score", F.array_join("sources", ",").alias("sources"), F.md5("text").alias("text_md5"))


_ASKED_MANY = "asked AS (SELECT doc_id + 1 AS query_id, left(text, 80) AS query FROM documents WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))"
_DENSE_MANY = _dense("EXISTS (FROM documents x WHERE x.doc_id = p.vec_id)", f"{_MANY} AND vec_id IN (SELECT doc_id FROM documents)")


@query(f"WITH {_ASKED_MANY}, {_INDEX}, {_bm25()}, {_DENSE_MANY}, {_FUSED}, {_LEX} SELECT query_id, rank::INT AS rank, round(score, 9) AS score, original_score, sources, md5(text) AS text_md5 FROM reranked")
def hybrid_search_many(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks with its vector and the start of its document."""
    corpus, _ = _corpus(spark, d)
    texts = table(spark, d, "documents").where("doc_id % 20 = 0").select((F.col("doc_id") + 1).alias("query_id"), F.left("text", F.lit(80)).alias("query"))
    found = HybridEngine(corpus, digits=6).search(stored(texts.join(_many(spark, d)[1], "query_id")))
    return found.select("query_id", "rank", F.round("score", 9).alias("score"), "original_score", F.array_join("sources", ",").alias("sources"), F.md5("text").alias("text_md5"))


@query(f"""{_HYBRID} SELECT query_id::INT AS query_id, md5(string_agg(text, {_RULE} ORDER BY rank)) AS context_md5,
md5(string_agg(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, {_RULE} ORDER BY rank)) AS streamed_md5 FROM reranked GROUP BY 1""")
def context_snippets(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    found = HybridEngine(corpus, digits=6).search(queries)
    whole = fusion.context(found).select("query_id", F.md5("context").alias("context_md5"))
    return whole.join(fusion.streamed_context(found).select("query_id", F.md5("context").alias("streamed_md5")), "query_id")


@query(f"""WITH ranked AS (SELECT 1 AS query_id, 'dense' AS retriever, 1 AS no, rank, text FROM (SELECT text, doc_id + 1 AS rank FROM documents)
UNION ALL SELECT 1, 'sparse', 2, rank, text FROM (SELECT text, 100000000 - doc_id AS rank FROM documents)),
keyed AS (SELECT *, {_KEY} AS k FROM ranked), grp AS (SELECT k, round(sum(CASE no WHEN 1 THEN 0.4 ELSE 0.3 END::DOUBLE / (60 + rank)), 9) AS score, min(no * 1000000000 + rank) AS first, count(*) AS n FROM keyed WHERE k <> '' GROUP BY 1)
SELECT rank::INT AS rank, score, md5(k) AS key_md5 FROM (SELECT *, row_number() OVER (ORDER BY score DESC, first) AS rank FROM grp) WHERE rank <= 100""")
def rrf_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Both orders of the whole corpus: its copies meet within each list and across the two."""
    from hybridspark.functions.text import identity_key

    docs = table(spark, d, "documents").withColumn("query_id", F.lit(1))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    # ranks of a whole corpus come from its ids alone; as in the SQL, the second holds for ids below 100,000,000
    ranks = {"dense": F.col("doc_id") + 1, "sparse": 100_000_000 - F.col("doc_id")}
    lists = [fusion.ranked_list(docs.withColumn("rank", r), name, none) for name, r in ranks.items()]
    return fusion.rrf(lists[0].unionByName(lists[1]), top_k=100, digits=9).select("rank", "score", F.md5(identity_key(F.col("text"))).alias("key_md5"))


def _graph(spark: SparkSession, d: str) -> graph.Graph:
    part, supplier, customer = (table(spark, d, t) for t in ("part", "supplier", "customer"))
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    projects = part.select(key("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.col("p_type").alias("category"), F.col("p_size").cast("string").alias("year"))
    members = supplier.select(key("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("title"), F.col("s_nationkey").alias("years_experience"), F.array(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"))).alias("skills"))
    none = F.lit(None).cast("string").alias("role")
    delivered = lines.groupBy("l_suppkey", "l_partkey").agg(F.min("l_returnflag").alias("role")).select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("DELIVERED").alias("type"), "role")
    first = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.min("o_custkey").alias("c_custkey")).join(customer.hint("merge"), "c_custkey")  # customers are not broadcast
    client = first.select(key("p", "l_partkey").alias("src"), F.col("c_name").alias("dst"), F.lit("FOR_CLIENT").alias("type"), none)
    certs = part.where("p_size % 2 = 0").select(key("p", "p_partkey").alias("src"), F.concat(F.lit("ISO-"), F.col("p_size").cast("string")).alias("dst"), F.lit("REQUIRES_CERT").alias("type"), none)
    return graph.Graph(projects, members, client.unionByName(certs).unionByName(delivered))


_WANTED = {1: "supplier", 2: "nation1", 3: "Brand#1"}
_WANTED_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _WANTED.items()) + ") t(query_id, query))"
_EDGES_SQL = """dv AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(l_returnflag) AS role FROM lineitem GROUP BY 1, 2),
fc AS (SELECT 'p' || l_partkey AS src, any_value(c_name) AS client FROM (SELECT l_partkey, min(o_custkey) AS ck FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) JOIN customer ON ck = c_custkey GROUP BY 1)"""
_PROJECTS_SQL = """ph AS (SELECT * FROM (SELECT query_id, 'p' || p_partkey AS id, p_name, p_brand, p_type, p_size, row_number() OVER (PARTITION BY query_id ORDER BY 'p' || p_partkey) AS n FROM part, w
WHERE contains(lower(p_name), lower(query)) OR contains(lower(p_brand), lower(query)) OR contains(lower(p_type), lower(query))) WHERE n <= 10),
team AS (SELECT dst, string_agg(DISTINCT s_name || ' (' || coalesce(role, 'None') || ')', ', ' ORDER BY s_name || ' (' || coalesce(role, 'None') || ')') AS t FROM dv JOIN supplier ON src = 's' || s_suppkey GROUP BY 1),
projects AS (SELECT query_id, id AS entity_id, 1.0::DOUBLE AS score, 'Project: ' || p_name || chr(10) || 'Description: ' || p_brand || chr(10) || 'Category: ' || p_type || chr(10) || 'Client: ' || coalesce(client, 'N/A') || chr(10) || 'Year: ' || p_size || chr(10) ||
'Team: ' || coalesce(t, '') || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Certifications: ISO-' || p_size ELSE '' END AS text FROM ph LEFT JOIN fc ON fc.src = id LEFT JOIN team ON team.dst = id)"""
_MEMBERS_SQL = """mh AS (SELECT * FROM (SELECT query_id, 's' || s_suppkey AS id, s_name, s_nationkey, row_number() OVER (PARTITION BY query_id ORDER BY 's' || s_suppkey) AS n FROM supplier, w
WHERE contains(lower(s_name), lower(query)) OR contains('supplier', lower(query)) OR contains('nation' || s_nationkey, lower(query))) WHERE n <= 10),
done AS (SELECT src, string_agg(DISTINCT p_name || ' (' || coalesce(role, 'None') || ')', ', ' ORDER BY p_name || ' (' || coalesce(role, 'None') || ')') AS t FROM dv JOIN part ON dst = 'p' || p_partkey GROUP BY 1),
members AS (SELECT query_id, id AS entity_id, 0.9::DOUBLE AS score, 'Team Member: ' || s_name || chr(10) || 'Title: supplier' || chr(10) || 'Experience: ' || s_nationkey || ' years' || chr(10) || 'Projects: ' || coalesce(t, '') AS text FROM mh LEFT JOIN done ON done.src = id)"""


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_WANTED.items()), "query_id int, query string")


@query(f"WITH {_WANTED_SQL}, {_EDGES_SQL}, {_PROJECTS_SQL} SELECT query_id, entity_id, score, text FROM projects")
def graph_project_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_projects(_graph(spark, d), _wanted(spark)).select("query_id", "entity_id", "score", "text")


@query(f"WITH {_WANTED_SQL}, {_EDGES_SQL}, {_MEMBERS_SQL} SELECT query_id, entity_id, score, text FROM members")
def graph_member_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_members(_graph(spark, d), _wanted(spark)).select("query_id", "entity_id", "score", "text")


@query(f"""WITH {_WANTED_SQL}, {_EDGES_SQL}, {_PROJECTS_SQL}, {_MEMBERS_SQL} SELECT query_id, rank::INT AS rank, entity_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank
FROM (SELECT * FROM projects UNION ALL SELECT * FROM members)) WHERE rank <= 10""")
def graph_union_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_search(_graph(spark, d), _wanted(spark)).select("query_id", "rank", "entity_id", "score")


@query(ORACLES["graph_union_topk"])
def graph_indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same results from trigrams that are written once."""
    return graph.graph_search(graph.indexed(_graph(spark, d)), _wanted(spark)).select("query_id", "rank", "entity_id", "score")


@query(f"""{_HYBRID}, c AS (SELECT query_id, string_agg(text, {_RULE} ORDER BY rank) AS context FROM reranked GROUP BY 1)
SELECT query_id, 'general_qa' AS template, md5('Answer from the context alone. Say so if it does not hold the answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10) || query || chr(10)) AS prompt_md5 FROM asked LEFT JOIN c USING (query_id)""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    contexts = fusion.context(HybridEngine(corpus, digits=6).search(queries))
    return render_prompts(asked(spark).withColumn("mode", F.lit("qa")), contexts).select("query_id", "template", F.md5("prompt").alias("prompt_md5"))


@query("SELECT count(*) AS chunks, TRUE AS dense, TRUE AS sparse, FALSE AS graph FROM documents")
def engine_health(spark: SparkSession, d: str) -> DataFrame:
    """Whether there is an index is known without one being built: an empty one in the same folder form is enough."""
    docs, points = table(spark, d, "documents").select("doc_id", "text"), _vectors(spark, d)[0]
    log = Snapshots(spark, shared_folder(spark))
    return health(Corpus(docs, "doc_id", points, SegmentedIndex(log, "doc_id", "doc_id").index()))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS snippet_md5 FROM documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(snippet(F.col("text"))).alias("snippet_md5"))
