import numpy as np
from pyspark.sql import functions as F

from hybridspark.operators.cells import cell_search, fit_cells
from hybridspark.operators.dense import dense_search


def table(spark, n=1500, dim=24):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(30, dim))
    v = middles[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, dim))
    rows = [(i, [float(x) for x in v[i]], "ab"[i % 2]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, [0.0] * dim, "a"), (n + 2, [float("nan")] * dim, "a"), (n + 3, [float("inf")] + [1.0] * (dim - 1), "a")]
    return spark.createDataFrame(rows, "point_id long, vector array<double>, kind string").repartition(4).cache()


def test_recall_and_share(spark):
    df = table(spark)
    index = fit_cells(df)
    assert index.points.count() == df.count() and index.points.where("cell = -1").count() == 4
    queries = df.where("point_id % 20 = 7").where("point_id < 1500").select(F.col("point_id").alias("query_id"), "vector")
    sound = df.where("point_id < 1500")
    exact = {(r.query_id, r.point_id): r.score for r in dense_search(sound, queries).collect()}
    got = {(r.query_id, r.point_id): r.score for r in cell_search(index, queries).collect()}
    assert len(got) == len(exact) and len(set(got) & set(exact)) / len(exact) >= 0.9
    assert all(abs(got[p] - exact[p]) < 1e-9 for p in set(got) & set(exact))
    assert index.probes / len(index.centroids) < 0.5
    # all cells are the exact search
    whole = {(r.query_id, r.rank, r.point_id) for r in cell_search(index, queries, 5, probes=len(index.centroids)).collect()}
    assert whole == {(r.query_id, r.rank, r.point_id) for r in dense_search(sound, queries, 5).collect()}


def test_filters_and_odd_queries(spark):
    df = table(spark, 300)
    index = fit_cells(df, cells=6)
    queries = spark.createDataFrame([(1, [1.0] * 24), (2, [0.0] * 24), (3, None)], "query_id int, vector array<double>")
    got = cell_search(index, queries, 10, {"kind": "b"}, probes=6).collect()
    assert {r.query_id for r in got} == {1} and {r.kind for r in got} == {"b"} and len(got) == 10
    want = dense_search(df.where("point_id < 300"), queries.limit(1), 10, {"kind": "b"})
    assert [r.point_id for r in sorted(got, key=lambda r: r.rank)] == [r.point_id for r in want.orderBy("rank").collect()]


def test_few_and_no_points(spark):
    none = table(spark, 0)
    queries = spark.createDataFrame([(1, [1.0] * 24)], "query_id int, vector array<double>")
    assert cell_search(fit_cells(none), queries).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "point_id int, vector array<double>")
    assert [r.point_id for r in cell_search(fit_cells(one), spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")).collect()] == [1]


def test_no_row_for_a_query_and_a_point(spark, monkeypatch):
    """Results are those of scores row by row, over small shards with a cell split among several; joins make no pairs."""
    from hybridspark.functions.numbers import dot, norm
    from hybridspark.operators import cells, dense
    from hybridspark.operators.sparse import top_per_query

    df = table(spark, 600)
    df = df.unionByName(df.where("point_id < 80").select((5000 + F.col("point_id")).alias("point_id"), F.lit([1.0] * 24).alias("vector"), "kind"))
    index = fit_cells(df, cells=12)
    queries = df.where("point_id % 10 = 7").select(F.col("point_id").alias("query_id"), "vector")
    monkeypatch.setattr(dense, "SHARD", 24 * 64)
    monkeypatch.setattr(dense, "BLOCK", 20)
    monkeypatch.setattr(dense, "TILE", 1000)
    got = cell_search(index, queries, 8, probes=3, digits=6)
    routed = queries.where("query_id < 600 or query_id >= 5000").withColumn("cell", F.explode(cells._nearest(index.centroids, 3)(F.col("vector"))))
    pairs = routed.join(index.points.select("point_id", "cell", F.col("vector").alias("v")), "cell")
    pairs = pairs.withColumn("score", F.round(dot(F.col("v"), F.col("vector")) / (norm(F.col("v")) * norm(F.col("vector"))), 6))
    want = top_per_query(pairs, 8, F.desc("score"), F.col("point_id"))
    rows = lambda x: {(r.query_id, r.rank, r.point_id, r.score) for r in x.collect()}
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate(zip_with" not in plan
