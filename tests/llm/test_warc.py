import io

import pytest

from hybridspark.llm import warc as M
from hybridspark.llm.common import shared_dir

from .conftest import agrees_with_sql


def test_members_and_framing():
    data = [M.record(1, "http://a/ \n", b"x" * 5000), M.record(2, None, b"x" * 5000, 1), M.record(None, None, b"")]
    got = [M.parse(m, "f") for m in M.members(io.BytesIO(b"".join(data)).read, "f")]
    assert [g["headers"]["warc-type"] for g in got] == ["response", "revisit", "response"]
    assert got[0]["payload"] == b"x" * 5000 and got[0]["headers"]["warc-target-uri"] == "http://a/%20%0A"
    small = lambda n: io.BytesIO(b"".join(data)).read
    assert len(list(M.members(lambda n, f=small(0): f(7), "f"))) == 3
    with pytest.raises(ValueError):
        list(M.members(io.BytesIO(b"".join(data)[:-9]).read, "f"))


def test_damage_is_found():
    member = next(M.members(io.BytesIO(M.record(1, None, b"payload")).read, "f"))
    with pytest.raises(ValueError):
        M.parse(member.replace(b"payload", b"Payload"), "f")
    with pytest.raises(ValueError):
        M.parse(member[:-5], "f")


def test_round_trip(spark):
    big = "é" * 800
    rows = [(1, "u1", big), (2, "u2", "small"), (3, "u3", "small"), (9, "u9", big), (5, None, big), (7, "u7", None), (8, "u8", ""), (None, "n", big), (None, None, "z" * 2000), (2, "u2", "small"), (4, "u4", "y" * 1000), (6, "u6", "y" * 1000), (10, "a", "q" * 999), (11, "b", "q" * 999)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = shared_dir(spark)
    archives = M.write(df, folder, roll_bytes=500)
    assert archives.count() > 1
    got = M.read_back(archives, folder).collect()
    assert len(got) == len(rows)
    kind = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert kind[9, 1600] == ("response", None) and kind[1, 1600] == kind[5, 1600] == kind[None, 1600] == ("revisit", 9)
    assert kind[4, 1000] == ("revisit", 6) and kind[10, 999] == kind[11, 999] == ("response", None) and kind[None, 2000] == ("response", None)
    assert next(r for r in got if r.page_id == 9).payload.decode() == big


def test_empty_table(spark):
    folder = shared_dir(spark)
    archives = M.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert M.read_back(archives, folder).count() == 0


def test_agrees_with_sql(spark):
    agrees_with_sql(spark, M.op10_warc_round_trip, M.OP10_SQL)
