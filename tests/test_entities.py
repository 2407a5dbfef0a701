import pytest
from pyspark.sql import functions as F

from hybridspark.functions.numbers import cosine
from hybridspark.functions.text import sentences
from hybridspark.operators import chunking as C
from hybridspark.operators import engine as E
from hybridspark.operators import graph as G
from hybridspark.operators.dense import hashed_embedding, query_embedding
from hybridspark.operators.sparse import bm25_search, build_bm25
from hybridspark.sources.store import Collections, shared_folder

TEXT = "Red cats sleep all day. Red cats sleep all night. Engines burn diesel fuel quickly. Engines burn fuel. Tall trees."


def test_semantic_chunks_with_a_pandas_udf_agree_with_a_loop(spark):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, "One sentence."), (3, None), (4, " ")], "doc_id long, text string")
    got = C.chunk(df, embed=hashed_embedding, min_size=1).collect()
    parts = df.where("doc_id = 1").limit(1).select(F.posexplode(sentences(F.col("text"))).alias("i", "s")).withColumn("v", hashed_embedding(F.col("s")))
    pairs = parts.alias("a").join(parts.alias("b"), F.expr("b.i = a.i + 1")).select("b.i", "b.s", cosine(F.col("a.v"), F.col("b.v")).alias("c")).orderBy("i").collect()
    want = [TEXT.split(". ")[0] + "."]
    for p in pairs:
        want = [*want, p.s] if p.c < 0.5 else [*want[:-1], want[-1] + " " + p.s]
    assert len(want) > 1
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in got) == sorted([(1, i, t) for i, t in enumerate(want)] * 2 + [(2, 0, "One sentence.")])


def test_collections_and_dual_index(spark):
    collections = Collections(spark, shared_folder(spark), "test_")
    chunks = spark.createDataFrame([(1, 0, "alpha beta words"), (1, 1, "gamma delta words"), (2, 0, "epsilon zeta words"), (3, 0, "eta theta words")], "document_id long, chunk_index int, text string")
    for _ in range(2):  # the second time nothing is added
        points, index = E.index_chunks(collections, "documents", chunks, hashed_embedding(F.col("text")))
    assert points.count() == 4
    asked = spark.createDataFrame([(1, "gamma")], "query_id int, query string")
    assert [r.text for r in bm25_search(index, points, asked, key="point_id").collect()] == ["gamma delta words"]
    collections.ensure("documents", "x int")
    assert collections.read("documents").count() == 4


def test_a_failing_part_is_left_out(spark):
    chunks = spark.createDataFrame([(i, f"common word number{i}") for i in range(5)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "number3", [1.0])], "query_id int, query string, vector array<double>")

    @F.pandas_udf("double")
    def broken(q, t):
        raise RuntimeError("no model")

    corpus = E.Corpus(chunks, "doc_id", points=chunks, index=build_bm25(chunks))  # points have no vectors
    got = E.HybridEngine(corpus, scorer=broken, isolate=True).search(asked).collect()
    assert [r.text for r in got] == ["common word number3"] and got[0].sources == ["sparse"]
    with pytest.raises(Exception):  # noqa: B017
        E.HybridEngine(corpus, scorer=broken).search(asked).collect()
    assert E.HybridEngine(E.Corpus(chunks, "doc_id", points=chunks), isolate=True).search(asked).count() == 0


def test_extraction_to_graph(spark):
    answers = ['Sure: {"projects": [{"name": "P", "client": "C", "team_members": [{"name": "Ann", "role": "lead"}], "certifications": ["ISO"]}], "team_members": [{"id": "a", "name": "Ann", "certifications": ["PMP", null]}]} ok', "none", None]
    g = G.extracted(spark.createDataFrame([(a,) for a in answers], "answer string"))
    assert [r.id for r in g.projects.collect()] == ["P"] and [r.id for r in g.members.collect()] == ["a"]
    assert sorted((r.src, r.dst, r.type, r.role) for r in g.edges.collect()) == [("Ann", "P", "DELIVERED", "lead"), ("P", "C", "FOR_CLIENT", None), ("P", "ISO", "REQUIRES_CERT", None), ("a", "PMP", "HOLDS", None)]


def test_composed_model_calls(spark):
    q = spark.createDataFrame([(1, "q", "req", "section")], "query_id int, query string, requirements string, section_content string")
    contexts = spark.createDataFrame([(1, "ctx")], "query_id int, context string")
    r = E.compliance(q, contexts, lambda p: F.when(p.contains("req") & p.contains("ctx"), F.lit('{"status": "met", "gaps": []}'))).first()
    assert r.status == "met"
    rows = E.requirement_rows(q, lambda p: F.lit('[{"text": "a", "category": "c", "priority": "high"}, {"text": "b"}]')).collect()
    assert [(x.query_id, x.text, x.priority) for x in rows][0] == (1, "a", "high") and len(rows) == 2
    assert E.section_text(q, contexts, lambda p: F.lit("one\n\ntwo")).first().text == "one\n\ntwo"


def test_query_embedding_has_the_prefix(spark):
    echo = lambda c: F.array(F.length(c).cast("double"))
    r = spark.range(1).select(query_embedding(F.lit("ab"), echo, "bge-base", "bge", "xyz").alias("a"), query_embedding(F.lit("ab"), echo, "other", "bge", "xyz").alias("b")).first()
    assert (r.a, r.b) == ([5.0], [2.0])
