import random

from hybridspark.operators.pruned import build_blocks, pruned_passes, pruned_search
from hybridspark.operators.sparse import bm25_search, build_bm25


def corpus(spark, n=3000):
    """A frequent word in nine of ten texts, some in between, and rare ones."""
    rng = random.Random(3)
    text = lambda i: " ".join(["common"] * rng.randrange(0, 5) * (i % 10 != 0) + [f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(0, 25))])
    return spark.createDataFrame([(i, text(i)) for i in range(n)] + [(n, None), (n + 1, "")], "doc_id long, text string")


def test_results_are_those_of_the_whole_search(spark):
    df = corpus(spark)
    index = build_bm25(df)
    blocks = build_blocks(index, block_chunks=16, parts=8)
    rng = random.Random(9)
    asked = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 6))) + " common" * (i % 3)) for i in range(30)] + [(99, "nothing known"), (98, "common")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    for k, digits in ((1, None), (20, 6), (500, 2)):
        rounded = lambda rows: sorted((r.query_id, r.rank, r.doc_id if digits else 0, round(r.score, 9)) for r in rows)
        want = rounded(bm25_search(index, None, queries, k, digits=digits).collect())
        assert rounded(pruned_search(blocks, queries, k, digits=digits).collect()) == want and want


def test_most_of_a_frequent_words_list_stays_closed(spark):
    blocks = build_blocks(build_bm25(corpus(spark)), block_chunks=16, parts=8)
    queries = spark.createDataFrame([(1, "common w150 w201")], "query_id int, query string")
    bounds, opened, _ = pruned_passes(blocks, queries, 5)
    long = blocks.blocks.where("token = 'common'")
    size = lambda df: df.selectExpr("sum(size(postings))").first()[0]
    share = size(long.join(opened, "block")) / size(long)
    assert 0 < share < 0.35 and opened.count() < bounds.count() / 3


def test_empty(spark):
    blocks = build_blocks(build_bm25(spark.createDataFrame([], "doc_id long, text string")))
    assert pruned_search(blocks, spark.createDataFrame([(1, "x y")], "query_id int, query string")).count() == 0


def test_blocks_are_not_shuffled_to_be_searched(spark):
    """Picks times tokens are more than Spark broadcasts; asked tokens and picks on their own are few."""
    from hybridspark.operators.pruned import _scored
    from hybridspark.sources.store import stored

    blocks = build_blocks(build_bm25(corpus(spark, 500)), block_chunks=4, parts=8)
    assert blocks.blocks.groupBy("token", "block").count().where("count > 1").isEmpty()
    asked = stored(blocks.vocabulary.where("token in ('common', 'w3')").selectExpr("1 AS query_id", "token", "idf", "1L AS qtf"))
    picks = stored(blocks.blocks.where("token = 'common'").selectExpr("1 AS query_id", "block", "part").distinct())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = _scored(blocks, picks, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
