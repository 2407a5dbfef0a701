import random

import pytest
from pyspark.sql import functions as F

from hybridspark.sources.snapshots import Conflict, Points, Snapshots
from hybridspark.sources.store import shared_folder

KIND = "document_id long, point_id string, text string"


def rows(spark, *found):
    return spark.createDataFrame([(d, f"{d}:{i}", t) for d, i, t in found], KIND)


def held(points, version=None):
    return sorted((r.point_id, r.text) for r in points.read(version).collect())


def test_documents_are_replaced_whole(spark):
    points = Points(Snapshots(spark, shared_folder(spark)), buckets=4)
    first = points.replace(rows(spark, *((d, i, f"old {d} {i}") for d in range(6) for i in range(3))))
    second = points.replace(rows(spark, (2, 0, "new"), (9, 0, "more"), (None, 0, "nobody's"), (None, 1, "nobody's")))
    want = sorted([(f"{d}:{i}", f"old {d} {i}") for d in range(6) for i in range(3) if d != 2] + [("2:0", "new"), ("9:0", "more"), ("None:0", "nobody's"), ("None:1", "nobody's")])
    assert held(points) == want and len(held(points, first)) == 18
    points.replace(rows(spark, (None, 1, "somebody's"), (None, 1, "again")))
    assert dict(held(points))["None:0"] == "nobody's" and dict(held(points))["None:1"] == "somebody's" and len(held(points)) == len(want)
    points.delete(spark.createDataFrame([(d,) for d in [0, 1, 2, 3, 4, 5, None, 77]], "document_id long"))
    assert [k for k, _ in held(points)] == ["9:0", "None:0", "None:1"]
    assert points.log.update(lambda m: m) == points.log.versions()[0] and second == first + 1
    with pytest.raises(ValueError):
        points.read(99)


def test_untouched_buckets_are_shared(spark):
    log = Snapshots(spark, shared_folder(spark))
    points = Points(log, buckets=16)
    points.replace(rows(spark, *((d, 0, "t") for d in range(200))))
    before = log.manifest()[1]["points"]
    points.replace(rows(spark, (3, 0, "u")))
    after = log.manifest()[1]["points"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert log.vacuum(keep=1) == 0 and points.read().count() == 200
    points.replace(spark.createDataFrame([(d, f"{d}:0", "t", 1) for d in range(200)], KIND + ", page int"))
    assert log.vacuum(keep=1) == 2 and points.read().where("page = 1").count() == 200


def test_a_failed_or_half_written_change_leaves_the_old_snapshot(spark):
    log = Snapshots(spark, shared_folder(spark))
    points = Points(log, buckets=2)
    points.ensure(KIND)
    assert points.ensure("x int") == 1 and points.read().count() == 0
    points.replace(rows(spark, (1, 0, "a"), (2, 0, "b")))

    @F.udf("string")
    def broken(t):
        raise RuntimeError("no model")

    with pytest.raises(Exception):  # noqa: B017
        points.replace(rows(spark, (1, 0, "c")).withColumn("text", broken("text")))
    assert held(points) == [("1:0", "a"), ("2:0", "b")] and log.versions() == [2, 1]
    # a writer that died within its manifest
    out = log._files.create(log._paths(f"{log.folder}/manifests/0000000003.json"), False)
    out.write(bytearray(b'{"points": {'))
    out.close()
    assert held(points) == [("1:0", "a"), ("2:0", "b")]
    assert points.replace(rows(spark, (1, 0, "c"))) == 4 and held(points) == [("1:0", "c"), ("2:0", "b")]


def test_two_writers_do_not_overwrite_one_another(spark):
    log = Snapshots(spark, shared_folder(spark))
    points = Points(log, buckets=2)
    points.replace(rows(spark, (1, 0, "a")))

    def slow(m):
        new = points.replaced(m, rows(spark, (1, 0, "slow")))
        Points(Snapshots(spark, log.folder), buckets=2).replace(rows(spark, (1, 0, "fast")))
        return new

    with pytest.raises(Conflict):
        log.update(slow)
    assert held(points) == [("1:0", "fast")]


def test_what_stays_is_not_written_again(spark):
    log = Snapshots(spark, shared_folder(spark))
    points = Points(log, buckets=1)
    points.replace(rows(spark, *((d, 0, "t") for d in range(200))))
    points.replace(rows(spark, (3, 0, "u"), (200, 0, "v")))
    first, second = log.manifest()[1]["points"]["0"]
    assert [spark.read.parquet(f"{p}/rows").count() for p in (first, second)] == [200, 2]
    points.delete(spark.createDataFrame([(3,), (4,)], "document_id long"))
    assert log.manifest()[1]["points"]["0"] == [first, second] and log.vacuum(keep=1) == 0
    assert held(points) == sorted([(f"{d}:0", "t") for d in range(200) if d not in (3, 4)] + [("200:0", "v")])


def test_many_changes_agree_with_a_dictionary_and_leave_few_parts(spark):
    rng = random.Random(4)
    log = Snapshots(spark, shared_folder(spark))
    points, want = Points(log, buckets=3, most=2), {}
    for step in range(9):
        if step % 3 == 2:
            out = {rng.randrange(12) for _ in range(2)}
            points.delete(spark.createDataFrame([(d,) for d in out], "document_id long"))
            want = {k: v for k, v in want.items() if v[0] not in out}
        else:
            new = {f"{d}:{i}": (d, f"{step} {d} {i}") for d in {rng.randrange(12) for _ in range(4)} for i in range(rng.randrange(1, 3))}
            named = {d for d, _ in new.values()}
            new["x"] = (None, f"{step} nobody's")
            # each row comes again with a lesser text, another with none
            points.replace(spark.createDataFrame([(d, k, t) for k, (d, t) in new.items()] + [(d, k, "") for k, (d, _) in new.items()] + [(99, "99:0", None)], KIND))
            want = {k: v for k, v in want.items() if v[0] not in named} | new | {"99:0": (99, None)}
        m = log.manifest()[1]
        assert all(len(p) <= 2 for p in m["points"].values()) and len(m["gone"]) <= 2
    assert held(points) == sorted((k, t) for k, (_, t) in want.items())
