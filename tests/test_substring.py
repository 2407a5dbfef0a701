import random

from pyspark.sql import functions as F

from hybridspark.operators.substring import build_trigrams, candidates, substring_matches, trigrams


def rows(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("aAbBcé 漢%_") for _ in range(rng.randrange(0, 30)))
    found = [(i, None if i % 17 == 0 else text(), text()) for i in range(300)]
    return found, spark.createDataFrame(found, "id long, a string, b string")


def test_matches_agree_with_a_loop(spark):
    found, df = rows(spark)
    rng = random.Random(2)
    asked = {i: (found[i][2] or "xyz")[k : k + rng.randrange(1, 7)] for i, k in ((j, rng.randrange(0, 8)) for j in range(60))} | {97: "", 98: "nowhere", 99: None}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    test = F.lower("a").contains(F.lower("query")) | F.lower("b").contains(F.lower("query"))
    want = sorted((q, i) for q, t in asked.items() if t is not None for i, a, b in found if t.lower() in (a or "\0").lower() or t.lower() in b.lower())
    fields = F.array("a", "b")
    for how in ({"fields": fields}, {"index": build_trigrams(df, "id", fields)}, {}):
        got = substring_matches(df, queries, test, "id", **how)
        assert sorted((r.query_id, r.id) for r in got.collect()) == want
        assert got.columns == ["query_id", "query", "id", "a", "b"]


def test_patterns_agree_with_ilike(spark):
    _, df = rows(spark)
    asked = ["%abc%", "%a_bc%", "%b%c%a%", "a%", "%", "%ab%bc ab%", r"%\%a%", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    test = F.expr("b ILIKE query")
    got = substring_matches(df, queries, test, "id", fields=F.array("b"), ilike=True)
    want = df.crossJoin(queries).where(test)
    assert sorted((r.query_id, r.id) for r in got.collect()) == sorted((r.query_id, r.id) for r in want.collect())


def test_no_nested_loop_for_three_letters(spark):
    _, df = rows(spark)
    queries = spark.createDataFrame([(1, "abc"), (2, "bcabc")], "query_id int, query string")
    got = substring_matches(df, queries, F.lower("b").contains(F.lower("query")), "id", F.array("b"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trigrams_and_candidates(spark):
    df = spark.createDataFrame([(1, "AbCabc"), (2, "ab"), (3, None), (4, "é漢xé漢x")], "id int, t string")
    assert {r.id: r.g for r in df.select("id", trigrams(F.col("t")).alias("g")).collect()} == {1: ["abc", "bca", "cab"], 2: [], 3: [], 4: ["é漢x", "漢xé", "xé漢"]}
    index = build_trigrams(df, "id", F.array("t"))
    asked = spark.createDataFrame([(1, "CAB"), (2, "zzz"), (3, "漢xé")], "query_id int, query string")
    assert sorted(map(tuple, candidates(index, asked).collect())) == [(1, 1), (3, 4)]


def test_no_frequent_trigram_meets_in_one_task(spark, monkeypatch):
    """Lists are joined to a broadcast of the asked trigrams, and what they find is dealt by row over partitions by its number."""
    from pyspark.sql import functions as F

    from hybridspark.operators import substring as S
    from hybridspark.sources import store

    rows = spark.createDataFrame([(i % 90, f"common part {i}", None if i % 2 else "brass") for i in range(100)] + [(200, None, None)], "id int, name string, kind string")
    index = S.build_trigrams(rows, "id", F.array("name", "kind"))
    want = {(r.id, g) for r in rows.collect() for t in (r.name, r.kind) if t for g in (t[i : i + 3] for i in range(len(t) - 2))}
    assert sorted((r.id, r.gram) for r in index.postings.collect()) == sorted(want)
    asked = spark.createDataFrame([(1, "common"), (2, "brass"), (3, "zzz")], "query_id int, query string")
    monkeypatch.setattr(store, "ROWS", 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = S.candidates(index, asked)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {(r.query_id, r.id) for r in got.collect()} == {(1, i) for i in range(90)} | {(2, r.id) for r in rows.where("kind is not null").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, plan
    assert ", 10), REPARTITION_BY_NUM" in plan and "hashpartitioning(id" in plan, plan
