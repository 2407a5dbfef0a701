import random
import time

import pytest
from pyspark.sql import functions as F

from hybridspark.operators import chunking as C


def plain_split(text, most):
    out, now, size = [], [], 0
    for w in text.split():
        if now and size + len(w) + 1 > most:
            out.append(" ".join(now))
            now, size = [], 0
        now.append(w)
        size += len(w) + 1
    return out + ([" ".join(now)] if now else [])


def plain_fixed(parts, most, overlap):
    out, now = [], []
    for s in parts:
        if now and sum(map(len, now)) + len(s) > most:
            out.append(" ".join(now))
            now = now[-overlap:] if overlap else now
        now = [*now, s]
    return out + ([" ".join(now)] if now else [])


def plain_semantic(parts, cuts, least, most):
    edges = [0, *cuts, len(parts)]
    segments = [" ".join(parts[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for s in segments[:-1]:
        if out and len(s) < least and len(out[-1]) + 1 + len(s) <= most:
            out[-1] += " " + s
        else:
            out.append(s)
    out.append(segments[-1])
    return [x for c in out for x in (plain_split(c, most) if len(c) > most else [c])]


@pytest.fixture(scope="module")
def parts():
    rng = random.Random(4)
    return [[" ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(2, 15))] for _ in range(80)]


def test_folds_agree_with_loops(spark, parts):
    rng = random.Random(5)
    cuts = [sorted(rng.sample(range(1, len(p)), rng.randrange(0, len(p)))) for p in parts]
    df = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(zip(parts, cuts, strict=True))], "i int, p array<string>, c array<int>")
    p = F.col("p")
    for most, least, overlap in ((60, 30, 1), (100, 20, 2), (30, 10, 0)):
        got = df.select("i", C.fixed_chunks(p, most, overlap).alias("f"), C.semantic_chunks(p, F.col("c"), least, most).alias("s"), C.split_oversize(F.array_join(p, " "), most).alias("w")).collect()
        for r in got:
            if overlap:
                assert r.f == plain_fixed(parts[r.i], most, overlap)
            assert r.s == plain_semantic(parts[r.i], cuts[r.i], least, most)
            assert r.w == plain_split(" ".join(parts[r.i]), most)


def test_boundaries_and_special_texts(spark):
    long = "one sentence without an end " * 100
    rows = [(1, "Alpha beta gamma. Alpha beta delta. Something else entirely. Entirely something else."), (2, long), (3, "  "), (4, None), (5, "Only one.")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in C.chunk(df, min_size=5).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["Alpha beta gamma. Alpha beta delta.", "Something else entirely. Entirely something else."], 2: [long.strip()], 5: ["Only one."]}
    assert C.chunk(df, "fixed", max_size=40).where("doc_id = 1").count() > 1
    with pytest.raises(ValueError):
        C.chunk(df, "other")


def test_term_counts_agree_with_the_pairwise_likeness(spark):
    """Both ways give the same cuts, and a sentence of a hundred thousand kinds of words is counted in seconds."""
    rng = random.Random(9)
    words = ["alpha", "beta", "the", "gamma", "x1", "Alpha", "漢", "-", "d-e"]
    rows = [(i, [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 12))]) for i in range(120)] + [(120, None)]
    df = spark.createDataFrame(rows, "i int, p array<string>")
    pairwise = lambda a, b: C.term_cosine(a, b)
    for r in df.select(C.boundaries(F.col("p")).alias("a"), C.boundaries(F.col("p"), pairwise).alias("b")).collect():
        assert r.a == r.b
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("s"))
    began = time.time()
    assert long.select(C.boundaries(F.array("s", "s", F.lit("other"))).alias("c")).first().c == [2]
    assert time.time() - began < 20


def test_vector_boundaries_need_no_shuffle_and_span_batches(spark):
    """Cuts are those of cosines row by row, over nulls and vectors of several sizes, with batches smaller than a text."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from hybridspark.functions.numbers import cosine
    from hybridspark.functions.text import sentences
    from hybridspark.operators import chunking as C

    @F.pandas_udf("array<double>")
    def embed(texts):
        def one(t):
            n = int(t.strip("s.")) % 11
            return None if n == 3 else [1.0, None] if n == 5 else [0.0, 0.0] if n == 7 else [1.0, 2.0, 3.0] if n in (8, 9) else [1e200, 1.0] if n == 10 else [float(n), 2.0 - n]

        return texts.map(one)

    docs = spark.createDataFrame([(k, " ".join(f"s{(7 * k + i * i) % 101}." for i in range(1 + 9 * k)), "x") for k in range(12)] + [(50, None, "x"), (51, " ", "x")], "doc_id long, text string, other string").repartition(3).cache()
    each = docs.where("doc_id < 50").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("at", "s")).withColumn("v", embed("s"))
    near = each.withColumn("b", F.lag("v").over(Window.partitionBy("doc_id").orderBy("at"))).where(F.col("b").isNotNull() & (cosine(F.col("b"), F.col("v")) < 0.5))
    want = {(r.doc_id, r["at"]) for r in near.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = C.vector_boundaries(docs, embed)
        rows = got.where("doc_id <> 4").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc_id, a) for r in rows for a in r["__cuts"]} == {x for x in want if x[0] != 4} and sorted(r.doc_id for r in rows) == [k for k in range(12) if k != 4]
    assert got.columns == ["doc_id", "text", "other", "__parts", "__cuts"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
