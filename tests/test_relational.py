from pyspark.sql import functions as F

from hybridspark.operators import relational as R


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_listing(spark):
    df = spark.createDataFrame([(1, "draft", "A 10% cut", ["x"], None), (2, "won", "a_b", ["y"], 5), (3, "draft", "axb", None, 9), (4, None, None, [], 9)], "id int, status string, title string, tags array<string>, at int")
    assert rows(R.page(df, "at", "id"), "id") == [(1,), (3,), (4,), (2,)]
    assert rows(R.page(df, "at", "id", skip=1, limit=2), "id") == [(3,), (4,)]
    assert rows(R.where_given(df, equal={"status": "draft", "id": None}), "id") == [(1,), (3,)]
    assert rows(R.where_given(df, like={("title", "status"): "A_B"}), "id") == [(2,), (3,)]
    assert rows(R.where_given(df, tags={"tags": "y"}), "id") == [(2,)]
    assert R.total(df).first().total == 4


def test_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, 2, "b"), (1, None, "a"), (1, 1, "c")], "parent int, order int, title string")
    got = R.with_children(parents, children, "id", "parent", ["order"], ["title"], "sections").orderBy("id").collect()
    assert [[s.title for s in r.sections] for r in got] == [["a", "c", "b"], []] and [r.sections_count for r in got] == [3, 0]


def test_patches_can_write_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, name string, v double")
    patches = spark.createDataFrame([(1, None, True, 9.0, False), (2, "z", True, None, True)], "id int, name string, set_name boolean, v double, set_v boolean")
    assert sorted(rows(R.apply_patch(df, patches, "id", ["name", "v"]), "id", "name", "v"), key=str) == [(1, None, 1.0), (2, "z", None), (3, "c", 3.0)]


def test_changes(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (None, 7)], "id int, n int")
    events = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert sorted(rows(R.add_counts(df, events, "id", "id", "n"), "n")) == [(2,), (5,), (7,)]
    left = R.delete_cascade(df, df.where("id = 1"), "id", {"events": (events, "id")})
    assert sorted(rows(left["parents"], "n")) == [(5,), (7,)] and rows(left["events"], "id") == [(9,)]
    kept, deleted = R.delete_where(df, F.col("id") == 1)
    assert kept.count() == 2 and deleted.first().deleted == 1
    assert sorted(r.id for r in R.insert(df.where("id is not null"), spark.createDataFrame([(None, 8)], "id int, n int"), "id").collect()) == [1, 2, 3]
    assert R.with_column_if_missing(df, "x", "int", 3).first().x == 3


def test_insert_numbers_in_order(spark):
    df = spark.createDataFrame([(7, "old", None)], "id long, name string, n long")
    values = [(None, None if i % 10 == 0 else "same" if i % 3 else f"v{i:03}", i % 5) for i in range(900)]
    new = spark.createDataFrame(values, "id long, name string, n long").repartition(6)
    got = sorted((r.id, r.name, r.n) for r in R.insert(df, new, "id").collect())
    assert [g[0] for g in got] == list(range(7, 908)) and got[0] == (7, "old", None)
    assert [g[1:] for g in got[1:]] == sorted((v[1:] for v in values), key=lambda v: (v[0] is not None, v[0] or "", v[1]))
    assert R.insert(df, new.limit(0), "id").count() == 1


def test_indicators(spark):
    df = spark.createDataFrame([("draft",), ("won",), ("won",), ("lost",), ("odd",)], "status string").withColumn("due", F.lit("2024-01-12").cast("timestamp"))
    k = R.kpis(df, "status", "due", F.lit("2024-01-10").cast("timestamp"), ["draft"], "won", "lost").first()
    assert (k.active, k.won, k.decided, k.pending, k.win_rate) == (1, 2, 3, 5, 67)
    assert R.kpis(df.limit(0), "status", "due", F.lit("2024-01-10").cast("timestamp"), ["draft"], "won", "lost").first().win_rate == 0
    assert sorted(rows(R.by_status(df, "status", ["draft", "review"]), "position", "status", "n")) == [(0, "draft", 1), (1, "review", 0)]
