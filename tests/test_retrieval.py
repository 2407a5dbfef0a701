import math
import random

import pytest
from pyspark.sql import functions as F

from hybridspark.operators import fusion
from hybridspark.operators.dense import dense_search, hashed_embedding, index_points
from hybridspark.operators.engine import Corpus, HybridEngine, echo, health, render_prompts
from hybridspark.operators.sparse import bm25_search, build_bm25, remove_document, top_per_query

from .test_text import plain_tokens


def plain_bm25(texts, query, k1=1.5, b=0.75, eps=0.25):
    docs = {i: plain_tokens(t) for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {}
    for d in docs.values():
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = eps * sum(raw.values()) / len(raw) if raw else 0
    out = {}
    for i, d in docs.items():
        s = sum((raw[w] if raw[w] >= 0 else floor) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / mean)) for w in plain_tokens(query) if w in raw)
        if s > 0:
            out[i] = s
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return {i: " ".join(f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(0, 40))) for i in range(40)}


def test_bm25_agrees_with_the_formula(spark, corpus):
    df = spark.createDataFrame(list(corpus.items()), "doc_id int, text string")
    asked = {1: "t1 t2 t9", 2: "t0 t0 t25", 3: "nothing here", 4: "the"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    found = {}
    for r in bm25_search(build_bm25(df), df, queries, top_k=100).collect():
        found.setdefault(r.query_id, {})[r.doc_id] = r.score
    for i, q in asked.items():
        want = plain_bm25(corpus, q)
        assert set(found.get(i, {})) == set(want) and all(abs(found[i][d] - s) < 1e-9 for d, s in want.items())


@pytest.mark.parametrize(("n", "hits"), [(0, 0), (1, 0), (2, 0), (3, 1)])
def test_tiny_corpora_have_no_sparse_hits(spark, n, hits):
    df = spark.createDataFrame([(i, "needle OMEGA-X99" if i == 0 else "straw hay") for i in range(n)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "omega-x99")], "query_id int, query string")
    assert bm25_search(build_bm25(df), df, queries).count() == hits


def test_filters_leave_statistics_alone(spark, corpus):
    df = spark.createDataFrame([(i, t, ["a", "b", None][i % 3]) for i, t in corpus.items()], "doc_id int, text string, kind string")
    queries = spark.createDataFrame([(1, "t1 t5")], "query_id int, query string")
    every = {r.doc_id: r.score for r in bm25_search(build_bm25(df), df, queries, 100).collect()}
    some = {r.doc_id: r.score for r in bm25_search(build_bm25(df), df, queries, 100, {"kind": ["a"]}).collect()}
    assert some == {i: s for i, s in every.items() if i % 3 == 0}
    assert remove_document(df, "a", "kind").where("kind is null").count() > 0


def test_many_queries_by_shards(spark, corpus, monkeypatch):
    """The same rows as by a join, over several shards and blocks, without a join of queries and postings."""
    from hybridspark.operators import sparse

    df = spark.createDataFrame([*corpus.items(), *((1000 + i, "t1 t1 t2") for i in range(40))], "doc_id int, text string")
    queries = spark.createDataFrame([(i, f"t{i % 9} t{i % 5} t{i % 5} nowhere") for i in range(30)] + [(30, ""), (31, None)], "query_id int, query string")
    index = build_bm25(df)
    plain = lambda found: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())
    want = plain(bm25_search(index, None, queries, 7, digits=6))
    monkeypatch.setattr(sparse, "MANY", 3)
    monkeypatch.setattr(sparse, "DOCUMENTS", 16)
    monkeypatch.setattr(sparse, "BLOCK", 10)
    found = bm25_search(index, None, queries, 7, digits=6)
    assert "FlatMapCoGroups" in found._jdf.queryExecution().executedPlan().toString()
    assert plain(found) == want and len(want) > 100


@pytest.mark.parametrize(("words", "order"), [(10**6, None), (10**6, "token"), (3, None)])
def test_many_queries_move_no_postings(spark, corpus, monkeypatch, words, order):
    """A document's postings go to its shard in one row; they may also lie apart, or ask for too many words to broadcast."""
    from hybridspark.operators import sparse

    df = spark.createDataFrame([*corpus.items(), *((1000 + i, "t1 t1 t2") for i in range(40)), (None, "t3 t4"), (None, "t4 t5 t5")], "doc_id int, text string")
    queries = spark.createDataFrame([(i, f"t{i % 9} t{i % 5} t{i % 5} nowhere") for i in range(30)] + [(30, ""), (31, None), (None, "t4 t7")], "query_id int, query string")
    index = build_bm25(df)
    if order:
        index = sparse.Bm25Index(index.postings.repartition(3, order).sortWithinPartitions(order), index.vocabulary, index.stats)
    plain = lambda found: sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)
    want = plain(bm25_search(index, None, queries, 7, digits=6))
    for name, value in {"MANY": 3, "DOCUMENTS": 16, "BLOCK": 10, "WORDS": words}.items():
        monkeypatch.setattr(sparse, name, value)
    found = bm25_search(index, None, queries, 7, digits=6)
    assert plain(found) == want and len(want) > 100
    assert "MapInArrow _packed" in found._jdf.queryExecution().executedPlan().toString()
    if not order:
        batches = index.postings.selectExpr("doc", "dl", "1 no", "cast(tf as int) tf").toArrow().to_batches()
        assert sum(b.num_rows for b in sparse._packed(batches)) <= df.count() + len(batches) < index.postings.count() / 2


def test_dense_search(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], None), (4, [0.0, 0.0], "a")], "point_id int, vector array<double>, kind string")
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "query_id int, vector array<double>")
    assert [(r.point_id, round(r.score, 4)) for r in dense_search(points, queries).orderBy("rank").collect()] == [(1, 1.0), (3, 0.7071), (2, 0.0), (4, 0.0)]
    assert [r.point_id for r in dense_search(points, queries, filters={"kind": "a"}).orderBy("rank").collect()] == [1, 4]
    chunks = spark.createDataFrame([(5, 0, "alpha beta")], "document_id int, chunk_index int, text string")
    p = index_points(chunks, hashed_embedding(F.col("text"), 16)).first()
    assert len(p.point_id) == 64 and abs(sum(x * x for x in p.vector) - 1) < 1e-6


def test_dense_search_agrees_with_the_column_functions(spark, monkeypatch):
    """Copies, null, short, endless and tiny vectors, over several shards and blocks; no product of all rows in one plan."""
    from hybridspark.functions.numbers import cosine
    from hybridspark.operators import dense

    nan, inf, rng = float("nan"), float("inf"), random.Random(3)
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 0.0], [1.0, 2.0], [], [1e-200, 0.0, 0.0], [1e-170, 2e-170, 0.0], [1e160, 1e160, 0.0]]
    sound = [[rng.choice([-1.0, 0.5, 1.0, 3.0]) for _ in range(3)] for _ in range(150)] + [[1.0, 1.0, 1.0]] * 60
    schema = "point_id string, vector array<double>"
    points = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(odd + sound)], schema)
    queries = spark.createDataFrame(list(enumerate(odd + sound[:30])), "query_id long, vector array<double>")
    pairs = points.crossJoin(queries.select("query_id", F.col("vector").alias("v"))).withColumn("score", cosine("vector", "v"))
    plain = lambda rows: sorted((r.query_id, r["rank"], r.point_id, str(r.score)) for r in rows.collect())
    monkeypatch.setattr(dense, "SHARD", 120)
    monkeypatch.setattr(dense, "BLOCK", 16)
    for digits, k in ((None, 5), (6, 20), (1, 7), (6, 500)):
        found = dense.dense_search(points, queries, k, digits=digits)
        want = top_per_query(pairs.withColumn("score", F.round("score", digits)) if digits else pairs, k, F.desc("score"), F.col("point_id"))
        assert plain(found) == plain(want)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, retriever string, rank int, text string, metadata map<string,string>")


def test_fusion(spark):
    long = "same start " * 30
    rows = [(1, "dense", 1, long + "x", {"a": "1"}), (1, "dense", 2, long + "y", {"b": "2"}), (1, "dense", 3, "  ", None), (1, "sparse", 1, "other", None), (1, "sparse", 2, "  " + long.upper(), {"a": "9", "c": None})]
    got = fusion.rrf(ranked(spark, rows)).orderBy("rank").collect()
    assert [r.sources for r in got] == [["dense", "sparse"], ["sparse"]]
    assert abs(got[0].score - (0.4 / 61 + 0.4 / 62 + 0.3 / 62)) < 1e-12 and got[0].text == long + "x"
    assert got[0].metadata == {"a": "1", "b": "2", "c": None} and got[1].metadata == {}
    assert abs(fusion.rrf(ranked(spark, rows), {"sparse": 0, "dense": 1.0}, k=0).orderBy("rank").first().score - (1 / 61 + 1 / 62 + 0.3 / 62)) < 1e-12


def test_ties_keep_their_order_and_blank_lists_are_empty(spark):
    rows = [(1, "sparse", 1, "b", None), (1, "graph", 1, "a", None)]
    assert [r.text for r in fusion.rrf(ranked(spark, rows)).orderBy("rank").collect()] == ["b", "a"]
    assert fusion.rrf(ranked(spark, [(1, "dense", 1, " ", None)])).count() == 0


def test_rerank_and_context(spark):
    fused = spark.createDataFrame([(1, 1, "alpha", 0.3, ["dense"]), (1, 2, "alpha beta " + "z" * 300, 0.2, ["dense"]), (1, 3, "beta alpha", 0.1, ["dense"])], "query_id int, rank int, text string, score double, sources array<string>")
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    got = fusion.rerank(fused, queries, top_k=2).orderBy("rank").collect()
    assert [(r.score, r.original_score) for r in got] == [(1.0, 0.2), (1.0, 0.1)]
    whole, cut = (f(fusion.rerank(fused, queries, top_k=2)).first().context for f in (fusion.context, fusion.streamed_context))
    assert whole == "alpha beta " + "z" * 300 + fusion.RULE + "beta alpha" and "..." in cut and len(cut) < len(whole)


def test_needle_and_limits(spark, corpus):
    chunks = spark.createDataFrame([*corpus.items(), (99, "the certificate OMEGA-X99 is here")], "doc_id int, text string")
    points = chunks.withColumn("vector", hashed_embedding(F.col("text"), 64))
    c = Corpus(chunks, "doc_id", points, build_bm25(chunks))
    queries = spark.createDataFrame([(1, "omega-x99"), (2, "t1")], "query_id int, query string").withColumn("vector", hashed_embedding(F.col("query"), 64))
    engine = HybridEngine(c)
    assert "OMEGA-X99" in engine.search(queries).where("query_id = 1 and rank = 1").first().text
    assert engine.search(queries).where("query_id = 2").count() == 5 and engine.search(queries, 0).where("query_id = 2").count() == 5
    assert engine.search(queries, 50).where("query_id = 2").count() == 20 and engine.search(queries, 1).where("query_id = 2").count() == 1
    answers = engine.answer(queries.withColumn("mode", F.lit("qa")), echo).collect()
    assert {r.template for r in answers} == {"general_qa"} and all(r.answer.startswith("prompt ") for r in answers)
    assert tuple(health(c).first()) == (41, True, True, False)
    with pytest.raises(ValueError):
        HybridEngine(Corpus(chunks)).search(queries)


def test_prompts_by_mode(spark):
    rows = [(1, "q", "write_section", "T", None), (2, "q2", "analyze_reqs", None, None), (3, "q3", "odd", None, None), (4, "q4", "compliance", None, "must")]
    queries = spark.createDataFrame(rows, "query_id int, query string, mode string, section_title string, requirements string")
    contexts = spark.createDataFrame([(1, "ctx")], "query_id int, context string")
    got = {r.query_id: r for r in render_prompts(queries, contexts).collect()}
    assert [got[i].template for i in (1, 2, 3, 4)] == ["proposal_section", "requirement_analyzer", "general_qa", "compliance_checker"]
    assert "Instructions: q\n" in got[1].prompt and "ctx" in got[1].prompt and '{"text": ""' in got[2].prompt and "q2" in got[2].prompt and "must" in got[4].prompt


def test_registered_searches_take_every_twentieth_row_in_blocks(spark, tmp_path):
    from hybridspark.plans import catalog

    n = 41000
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") / n), F.sin(F.col("id") / n)).alias("embedding"), (F.col("id") % 4).cast("int").alias("label"))
    df.where(f"vec_id % 20 = 0 or vec_id >= {n - 20}").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, labels in (("dense_topk_many", {0, 1, 2, 3}), ("dense_filtered_many", {1, 3})):
        rows = catalog.QUERIES[name](spark, str(tmp_path)).select("query_id", "doc_id").collect()
        assert {r.query_id - 1 for r in rows} == set(range(0, n, 20)) and {r.doc_id % 4 for r in rows} <= labels


def test_fusion_does_not_gather_the_copies_of_a_text(spark):
    rows = [(1, "dense", i, "one text", {"a": str(i), f"b{i % 2}": "x"}) for i in range(1, 200)]
    fused = fusion.rrf(ranked(spark, rows))
    got = fused.collect()
    assert [r.metadata for r in got] == [{"a": "1", "b1": "x", "b0": "x"}]
    # what is collected comes after the first aggregate: a row for each key, not for each copy
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(at" not in plan
