import numpy as np
from pyspark.sql import functions as F

from hybridspark.llm import ann as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        pairs = sorted((-sum(float(a) * float(b) for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in pairs[:k]]
    return out


def test_small_tables_are_exact_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(x) for x in rng.integers(-2, 3, 8).astype(np.float32)] for i in range(400)}
    good = {i: v for i, v in good.items() if any(v)}
    for i in range(100, 160):
        good[i] = good[100]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [float("inf")] * 8), (1100, [1.0] * 3), (None, [1.0] * 8)]
    rows = [(i, v, 0) for i, v in [*good.items(), *bad, (20, good[20])]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = M.nearest(df, df.where("vec_id % 20 = 0"), 20, shard=90, block=7)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute(good, [q for q in good if q % 20 == 0], 20)


def test_recall_over_several_shards_of_isotropic_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((9000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], SCHEMA).withColumns({c: F.lit("x") for c in ("query_id", "rank", "score", "shard", "block", "dim")})
    got = M.nearest(df, df.where("vec_id % 100 = 0"), 20, shard=4500, block=50).collect()
    exact = x[::100].astype(float) @ x.T.astype(float)
    hit = 0
    for n, q in enumerate(range(0, 9000, 100)):
        exact[n, q] = -9
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-exact[n])[:20].tolist()))
    assert hit >= 0.9 * 90 * 20


def test_ascent_stops_where_enough_is_named():
    # a dense cluster and a thin cloud: queries of the cluster stop at deeper levels, and nobody scores more than asked
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((3000, 32)), 4 + rng.standard_normal((3000, 32))])
    normals = M.planes(32, 64, 16, 3)
    s = M.strings(x, normals, 64, 16)
    got = list(M.ascend(s, s[:, ::60], 16, 300))
    depths = [d for d, _ in got]
    assert len(set(depths)) >= 3 and np.mean(depths[50:]) > np.mean(depths[:50])
    assert all(len(rows) <= 300 for _, rows in got)
    assert all(60 * j in rows for j, (_, rows) in enumerate(got))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.nearest(df, df).count() == 0
