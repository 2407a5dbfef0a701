"""Values of single rows: keys, prefixes, bands, defaults and times; prompts and model answers; both indexes of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.functions import numbers as N
from hybridspark.functions import text as X
from hybridspark.operators import relational as R
from hybridspark.operators.dense import hashed_embedding
from hybridspark.operators.engine import index_chunks, remove_documents
from hybridspark.operators.models import Memo, Model
from hybridspark.plans.documents import FIXED_SQL, STRIP_SQL
from hybridspark.plans.registry import query, table, token_list
from hybridspark.sources.files import extraction_prompts, ingest_text
from hybridspark.sources.schemas import DEFAULTS
from hybridspark.sources.snapshots import Snapshots
from hybridspark.sources.store import Collections, shared_folder


@query(r"""SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS extension, regexp_extract(url, '([^/]*)$', 1) AS basename,
'tenders/' || page_id || '/' || regexp_extract(url, '([^/]*)$', 1) AS key, regexp_replace(replace(url, '/', '_'), '^([^_]*)_', '\1 ') AS title FROM pages""")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", X.extension(url).alias("extension"), X.basename(url).alias("basename"), X.object_key(F.col("page_id"), url).alias("key"), X.first_underscore(F.replace(url, F.lit("/"), F.lit("_"))).alias("title"))


@query("""SELECT event_id, CASE WHEN contains(lower(event_type), 'sea') THEN 'search: ' || event_type ELSE event_type END AS prompt,
CASE WHEN contains(kind, 'dense') THEN 'dense' || CASE WHEN contains(kind, 'sparse') THEN ',sparse' ELSE '' END WHEN contains(kind, 'sparse') THEN 'sparse' ELSE 'dense' END AS badges
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'dense' WHEN 1 THEN 'sparse+dense' WHEN 2 THEN 'sparse' ELSE 'none' END AS kind FROM events)""")
def prefixes_and_badges(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Dense", "Sparse+dense", "sparse", "none")))
    source = F.get(kinds, (F.col("event_id") % 4).cast("int"))
    prompt = X.query_prefix(F.col("event_type"), F.col("event_type"), "sea", "search: ")
    return table(spark, d, "events").select("event_id", prompt.alias("prompt"), F.array_join(X.source_badges(source), ",").alias("badges"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 10 > 0.85 THEN 'high' WHEN l_discount * 10 > 0.7 THEN 'medium' ELSE 'low' END AS band,
CASE WHEN l_tax <> 0 THEN l_tax ELSE 0.5 END AS tax, round(l_quantity / sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 6) AS unit FROM lineitem""")
def bands_and_units(spark: SparkSession, d: str) -> DataFrame:
    unit = N.normalized(F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.band(F.col("l_discount") * 10).alias("band"), N.or_default(F.col("l_tax"), 0.5).alias("tax"), F.round(F.get(unit, 0), 6).alias("unit"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS tags, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS usage_count, 0.0::DOUBLE AS quality_rating, 'draft' AS status FROM part""")
def entity_defaults(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.when(size % 3 == 0, F.array("p_brand")).alias("tags"), F.when(size % 2 == 0, size.cast("long")).alias("usage_count"))
    rows = R.with_defaults(R.with_defaults(rows, DEFAULTS["content_blocks"]), {"status": DEFAULTS["tenders"]["status"]})
    return rows.withColumn("tags", F.array_join("tags", "|"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS said, strftime(ts, '%Y-%m-%d') AS day, TRUE AS back, TRUE AS midnight, TRUE AS wrong FROM events")
def times_as_text(spark: SparkSession, d: str) -> DataFrame:
    said, ts = N.iso_time(F.col("ts")), F.col("ts").cast("timestamp")
    back = N.from_iso(said) == F.date_trunc("second", ts)
    midnight = N.from_iso(F.left(said, F.lit(10))) == F.date_trunc("day", ts)
    return table(spark, d, "events").select("event_id", said.alias("said"), F.left(said, F.lit(10)).alias("day"), back.alias("back"), midnight.alias("midnight"), N.from_iso(F.concat(F.lit("x"), said)).isNull().alias("wrong"))


@query("SELECT o_orderkey, o_custkey, 'open' AS stage, o_orderstatus FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One row by its key; a column that the table lacks comes with its default, one that it has stays."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    rows = R.with_column_if_missing(R.with_column_if_missing(orders, "stage", "string", "open"), "o_orderstatus", "string", "none")
    return R.where_given(rows, equal={"o_orderkey": last})


_ASK = "Name the projects and team members in this document as one JSON object.' || chr(10) || chr(10) || '"


@query(f"SELECT doc_id, md5('{_ASK}' || left(text, 4000)) AS prompt_md5 FROM documents WHERE {STRIP_SQL.format('text')} <> ''")
def extraction_gate(spark: SparkSession, d: str) -> DataFrame:
    """Prompts for a kind of document that names people, and none for one that doesn't."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    asked = extraction_prompts(texts, "cv").unionByName(extraction_prompts(texts, "tender"))
    return asked.select("doc_id", F.md5("prompt").alias("prompt_md5"))


@query(FIXED_SQL.replace("SELECT doc_id, (unnest(range(0", "SELECT doc_id AS document_id, 'general' AS doc_type, (unnest(range(0"))
def raw_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = ingest_text(table(spark, d, "documents").select("doc_id", "text"), mode="fixed")
    return chunks.select("document_id", "doc_type", "chunk_index", F.md5("text").alias("chunk_md5"))


def _digests():
    import hashlib

    return lambda texts: [hashlib.sha256(t.encode()).hexdigest() for t in texts]


@query("SELECT conv_id, turn, sha256(text) AS answer, NULL::VARCHAR AS error FROM conversations")
def memoized_answers(spark: SparkSession, d: str) -> DataFrame:
    """A model that answers with a digest: first the users' turns are asked, then all, of which those are known by then."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))
    memo, model = Memo(Snapshots(spark, shared_folder(spark))), Model("digests", _digests)
    memo.answers(turns.where("role = 'user'"), model)
    return memo.answers(turns, model).select("conv_id", "turn", "answer", "error")


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' neu' ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src2')
SELECT count(*) AS points, count(*) AS rows, sum(len({token_list('text')}))::BIGINT AS tokens, sum(length(text))::BIGINT AS letters FROM c""")
def dual_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks go to vectors and words together, those of a language again with another text, a source out."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text", "lang", "source")
    collections = Collections(spark, shared_folder(spark))
    write = lambda rows: index_chunks(collections, "documents", rows, hashed_embedding(F.col("text"), 32))
    write(docs)
    write(docs.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" neu"))))
    points, index = remove_documents(collections, "documents", docs.where("source = 'src2'"))
    sizes = index.stats.select(F.col("n").alias("rows"), F.round(F.col("n") * F.col("avgdl")).cast("long").alias("tokens"))
    return points.agg(F.count("*").alias("points"), F.sum(F.length("text")).alias("letters")).crossJoin(sizes)
