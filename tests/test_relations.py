import pytest

from hybridspark.operators.relational import insert_unique
from hybridspark.operators.relations import Relation, Relations
from hybridspark.sources.schemas import KEYS, REFERENCES


def tables(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "users": make([(1,), (2,)], "id long"),
        "tenders": make([(10, 1), (11, 2), (12, None)], "id long, created_by long"),
        "proposals": make([(100, 10), (101, 10), (102, 11), (103, None), (104, 99)], "id long, tender_id long"),
        "sections": make([(1000, 100, 2), (1001, 100, 1), (1002, 101, None), (1003, 102, 0)], "id long, proposal_id long, order int"),
        "requirements": make([(5, 10, None), (6, 11, 1000), (7, None, 1003)], "id long, tender_id long, proposal_section_id long"),
    }


def catalogue():
    return Relations(KEYS, [Relation(*r, order=("order",) if r[0] == "sections" else ()) for r in REFERENCES if r[1] != "assigned_to" and r[:2] != ("proposals", "created_by")])


def ids(df):
    return sorted(r.id for r in df.collect())


def test_deletes_reach_every_level(spark):
    found = tables(spark)
    left = catalogue().delete(found, "tenders", found["tenders"].where("id = 10"))
    assert {k: ids(v) for k, v in left.items()} == {"users": [1, 2], "tenders": [11, 12], "proposals": [102, 103, 104], "sections": [1003], "requirements": [6, 7]}
    # what refers to a deleted row without a cascade stays, and is reported
    lost = [(r.child, r.column, r.value, r.n) for r in catalogue().orphans(left).collect()]
    assert sorted(lost) == [("proposals", "tender_id", "99", 1), ("requirements", "proposal_section_id", "1000", 1)]
    users = catalogue().delete(found, "users", found["users"])
    assert ids(users["users"]) == [] and ids(users["tenders"]) == [10, 11, 12]


def test_details_of_two_levels(spark):
    got = {r.id: r for r in catalogue().detail(tables(spark), "tenders", 2).collect()}
    shape = {i: [(p.id, [s.id for s in p.sections], p.sections_count) for p in r.proposals] for i, r in got.items()}
    assert shape == {10: [(100, [1001, 1000], 2), (101, [1002], 1)], 11: [(102, [1003], 1)], 12: []}
    assert [x.id for x in got[11].requirements] == [6] and got[10].proposals_count == 2 and got[12].requirements_count == 0
    assert catalogue().detail(tables(spark), "tenders", 0).columns == ["id", "created_by"]


def test_a_circle_or_a_table_without_a_key_is_refused(spark):
    with pytest.raises(ValueError):
        Relations({"a": "id", "b": "id"}, [Relation("a", "b_id", "b"), Relation("b", "a_id", "a")])
    with pytest.raises(ValueError):
        Relations({"a": "id"}, [Relation("a", "b_id", "b")])
    assert catalogue().order.index("tenders") < catalogue().order.index("proposals") < catalogue().order.index("sections")


def test_unique_keys_at_write_time(spark):
    known = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    rows = spark.createDataFrame([("a", 3), ("b", 5), ("b", 4), ("c", 6), (None, 7), (None, 7), ("b", 4)], "k string, v int")
    stored, refused = insert_unique(known, rows, "k")
    assert sorted(map(str, map(tuple, stored.collect()))) == ["('a', 1)", "('b', 4)", "('c', 6)", "(None, 2)"]
    assert sorted((r.reason, r.v) for r in refused.collect()) == [("no key", 7), ("no key", 7), ("repeated", 4), ("repeated", 5), ("stored already", 3)]
    assert stored.count() + refused.count() == known.count() + rows.count()


def test_tasks_of_cascades_do_not_grow_with_the_tables(spark, tmp_path, monkeypatch):
    """The joins and counts of both cascades have as many partitions as their tables' rows need, not the session's number."""
    import re

    from hybridspark.plans.listings import cascade_delete, cascade_levels
    from hybridspark.sources import store

    monkeypatch.setattr(store, "ROWS", 100)
    columns = {
        "customer": (50, ["id AS c_custkey", "IF(id % 3 = 0, 'BUILDING', 'x') AS c_mktsegment"]),
        "orders": (400, ["id AS o_orderkey", "id % 50 AS o_custkey", "IF(id % 2 = 0, 'F', 'O') AS o_orderstatus"]),
        "lineitem": (1300, ["id % 400 AS l_orderkey", "id AS l_linenumber", "id AS l_partkey", "id AS l_suppkey"]),
        "part": (10, ["id AS p_partkey"]),
    }
    for name, (n, made) in columns.items():
        spark.range(n).selectExpr(*made).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f, rows in ((cascade_delete, 200 + 200), (cascade_levels, None)):
            got = f(spark, str(tmp_path))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "13" in re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)
            found = got.collect()
            assert rows is None or len(found) == rows
            assert all(r.n == 1 for r in found if r.kind != "line")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
