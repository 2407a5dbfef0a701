import hashlib
import random
import zlib

from hybridspark.llm import sharding as M

from .conftest import CLASHES


def capacity(sizes, shards):
    def fits(c):
        n, now = 1, 0
        for x in sizes:
            if x > c:
                return False
            if now + x > c:
                n, now = n + 1, 0
            now += x
        return n <= shards

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_capacity_agrees_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "CELLS", 16)
    monkeypatch.setattr(M, "SPLIT", 4)
    rng = random.Random(9)
    for n, shards in ((300, 7), (5, 8), (50, 40), (1, 3)):
        sizes, at, sums = [rng.choice([16, 20, 300, 5000]) for _ in range(n)], 0, []
        for x in sizes:
            sums.append((at := at + x,))
        most, stops = M.minimax_cuts(spark.createDataFrame(sums, "end long"), shards)
        assert most == capacity(sizes, shards)
        assert stops[-1] == at and all(0 <= b - a <= most for a, b in zip([0, *stops], stops, strict=False))


def test_placement(docs, rows, none):
    got = M.shard(docs, 8).collect()
    assert len(got) == len(rows) and M.shard(none).count() == 0
    slots, sizes = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {i: t or "" for i, t, *_ in rows if i is not None}
    where = {}
    for r in got:
        if r.doc_id is not None:
            t = text[r.doc_id]
            assert (r.size, r.text_crc32) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
            assert where.setdefault(t, r.shard) == r.shard
    group = {}
    for _, t, *_ in rows:
        h = hashlib.md5((t or "").encode()).hexdigest()
        group[h] = group.get(h, 0) + len((t or "").encode()) + 16
    assert max(sizes.values()) == capacity([group[h] for h in sorted(group)], 8)


def test_clashing_columns_come_through(docs, rows):
    got = M.shard(docs, 8)
    own = {"size", "text_crc32", "shard", "slot"}
    assert len(got.columns) == len(set(got.columns)) and set(got.columns) == set(docs.columns) - {"text"} | own
    others = [c for c in CLASHES if c not in own]
    assert [tuple(r) for r in got.select(*others).distinct().collect()] == [("x",) * len(others)] and dict(got.dtypes)["shard"] != "string"
